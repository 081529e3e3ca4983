"""Targets in flight, pauses and the outcomes of probes, against going through the rows one by one."""

from duskwatch.operators import reaction, reports


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_in_flight_is_per_address_and_kind(spark):
    asked = spark.createDataFrame([(1, 7, 80, True, 0), (2, 7, 22, True, 50), (3, 7, 80, False, 60), (4, 7, 80, True, 100), (5, 7, 23, True, 9999), (6, 8, 80, True, 70), (7, 7, 22, False, 61)], "userid long, daddr long, dport int, irregular boolean, ts_ms long")
    answers = spark.createDataFrame([(1, 100), (1, 300), (6, 71)], "userid long, ts_ms long")
    out = reaction.suppress_in_flight(asked, answers)
    assert out.columns == [*asked.columns, "suppressed"]
    assert {r["userid"]: r["suppressed"] for r in out.collect()} == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True}
    assert "collect_list" not in plan(out)


def test_throttle_of_a_long_stretch(spark):
    df = spark.createDataFrame([("a", t) for t in range(0, 30_000, 7)] + [("a", 0), ("b", None), (None, 3)], "key string, ts_ms long")
    out = reports.throttle(df, "key", "ts_ms", 1000)
    tried = sorted(r["ts_ms"] for r in out.where("attempted").collect())
    assert tried == list(range(0, 30_000, 1001)) and out.count() == df.count()
    assert "collect_list" not in plan(out)


def test_one_probe_is_in_flight_per_address(spark):
    probes = spark.createDataFrame([(1, 7, 53, 0), (2, 7, 53, 1000), (3, 7, 69, 2000), (4, 7, 53, 3000), (5, 8, 53, 0), (6, 9, 53, 0), (7, 9, 53, 10), (8, None, 53, 0)], "probe_id long, addr long, port int, ts_ms long")
    packets = spark.createDataFrame([("udp", 7, 53, 5000), ("udp", 7, 69, 6000), ("icmp", 7, 53, 7000), ("udp", 7, 69, 8000), ("tcp", 8, 53, 10), ("udp", 8, 53, 20000), ("udp", 9, 53, 40000), ("udp", None, 53, 5)], "proto string, saddr long, sport int, ts_ms long")
    out = {r["probe_id"]: r["outcome"] for r in reaction.udp_outcomes(probes, packets).collect()}
    assert out == {1: "answered", 2: "unreachable", 3: "answered", 4: "timeout", 5: "answered", 6: "timeout", 7: "answered", 8: "timeout"}


def test_probes_are_sent_again():
    p = reaction.Probes(20_000)
    assert p.row(0, None, 1, 53) == [(1, "send", 0)] and p.due == 6001
    assert p.row(6000, "udp", None, 9) == []  # another port; what is due at this time comes after it
    assert p.row(6001, None, 2, 54) == [(1, "send", 6000)] and p.due == 12_001
    assert p.row(12_000, "udp", None, 53) == [(1, "answered", 12_000), (2, "send", 12_000)]
    assert p.advance(24_001) == [(2, "send", 18_000), (2, "send", 24_000)] and p.due == 30_001
    assert p.advance(32_000) == [(2, "send", 30_000)] and p.due == 32_001
    assert p.advance(None) == [(2, "timeout", 32_000)] and p.due is None
