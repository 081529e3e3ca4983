"""What long queues, long keys and many hours may cost."""

import os
from collections import deque

from pyspark.sql import functions as F

from duskwatch.operators import reaction
from duskwatch.operators.handshakes import Fold, Packet, _pieces
from duskwatch.plans import files, queries
from duskwatch.sources import sinks

D = "/root/testdata/sf0.001"


def test_waiting_probes_are_packed_and_come_out_in_order():
    queue, got = reaction.Packed(4), []
    for k in range(30):
        queue.append((k, None if k % 3 else 80, 10 * k))
        if k % 4 == 3:
            got.append(queue.popleft())
    while queue:
        got.append(queue.popleft())
    assert got == [(k, None if k % 3 else 80, 10 * k) for k in range(30)]


def test_what_happens_to_waiting_probes_comes_in_pieces():
    whole, parts = (reaction.Probes(20_000, waiting=reaction.Packed(4)) for _ in range(2))
    for k in range(50):
        for p in (whole, parts):
            p.row(k, None, k, 80)
    got = []
    while some := parts.advance(None, 7):
        assert len(some) <= 8
        got += some
    assert got == whole.advance(None) and len(got) == 50 * 5 - 1


def test_a_phase_that_is_alone_has_no_queue():
    row = lambda k, kind, sport: Packet(1, 2, 3, 1000 * k, k, sport, k, 0, 54321, k, kind, 7, 1000 * k + 5, "")
    fold = Fold()
    for k in range(100):
        fold.add(row(k, "isyn", k // 99 * 98 + k % 99 if k == 99 else k))
    assert sum(isinstance(q, deque) for q in fold._expecting[1].values()) <= 1
    events = fold.closed(None)
    assert [len(p) for p in _pieces(events, 30)] == [30, 30, 30, 10]


def test_an_hour_of_events_is_one_file(spark, tmp_path):
    rows = spark.range(400, numPartitions=4).select((F.col("id") % 10 * 3600).alias("ts"), F.lit("isyn").alias("tag"))
    sinks.write_handshakes(rows, f"{tmp_path}/events")
    found = [sum(f.endswith(".json.gz") for f in names) for at, _, names in os.walk(f"{tmp_path}/events") if "hour=" in at]
    assert found == [1] * 10


def test_counters_that_are_appended_twice_are_counted_once(spark, monkeypatch):
    plans, append = [], sinks.append_contact_types
    monkeypatch.setattr(sinks, "append_contact_types", lambda df, path: (plans.append(df._jdf.queryExecution().toString()), append(df, path)))
    assert files.counter_files(spark, D).count() == 1
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans) and "counter_files" in queries.QUERIES
