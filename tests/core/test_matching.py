"""Keys whose confirmations contend, against a plain walk of each key; and how often rows are shuffled."""

import random

from duskwatch.operators import matching
from duskwatch.plans import queries

D = "/root/testdata/sf0.001"
PACKETS = "userid long, method string, saddr long, daddr long, sport int, dport int, ts_ms long, step int, snum long, rst int"
CONFS = "userid long, method string, saddr long, daddr long, sport int, dport int, ts_ms long"


def test_contended_keys_match_as_a_plain_walk_does(spark):
    rng = random.Random(3)
    packets, confs, want = [], [], []
    for key in range(400):
        method = None if key % 19 == 0 else "tcp-rst"
        userid = None if key % 23 == 0 else key
        times = lambda n: sorted(rng.sample(range(400), n))
        own = [(userid, method, 1, 2, 3, 4, t, k, key * 10 + k, 0) for k, t in enumerate(times(rng.choice((1, 1, 2, 4))))]
        answers = [(userid, method, 2, 1, 4, 3, t) for t in times(rng.choice((0, 1, 2, 5)))]
        packets += own
        confs += answers
        if method is None:
            want += [(p[8], None) for p in own]
        elif userid is not None:
            step = matching.first_free(50)
            hits = [step(r[6], r if len(r) == 10 else None) for r in sorted(own + answers, key=lambda r: (r[6], r[7] if len(r) == 10 else -1))]
            want += [(h[0][8], h[1]) for h in hits if h is not None]
    rng.shuffle(packets)
    p, c = spark.createDataFrame(packets, PACKETS), spark.createDataFrame(confs, CONFS)
    got = matching.match_confirmations(p, c, 50)
    assert got.columns == [*p.columns, "con_ms"]
    assert sorted(map(repr, map(tuple, got.select("snum", "con_ms").collect()))) == sorted(map(repr, want))


def test_a_repeat_is_named_without_a_join_with_the_packets(spark):
    plan = queries.QUERIES["repeat_identity"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_packets_and_confirmations_are_shuffled_once_before_the_walk(spark):
    """By the handshake's key and not by the retransmit's and the confirmation's as well."""
    plan = queries.QUERIES["handshakes_contended"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(userid" not in plan and "Exchange hashpartitioning(saddr" in plan
    assert not any("snum" in line.split("hashpartitioning(")[1].split("), ")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line)
