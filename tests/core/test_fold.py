"""The indexed handshake fold against the plain one on contended keys, and its cost on long keys."""

import random
import time

import pytest

from duskwatch.operators import handshakes
from duskwatch.operators.handshakes import COLUMNS, Fold, Packet, assemble_handshakes
from tests.core import plain_fold

HOUR = 3_600_000


def drawn(rng, n, span, ports=3, numbers=3):
    """Packets of one key in order of time, with few ports and numbers, so that everything contends."""
    rows = []
    for k, ts in enumerate(sorted(rng.randrange(span) for _ in range(n))):
        kind = rng.choice(("isyn", "isyn", "rsyn", "rsyn", "ack", "ack"))
        number = rng.randrange(numbers)
        con = None if kind == "ack" or rng.random() < 0.1 else ts + rng.choice((5, 5, 900, 1500, 4000, 200_000, -900))
        rows.append(Packet(1, 2, 80, ts, k, rng.randrange(ports), number + (kind == "ack"), 0, k % 7, k, kind, number + 1 if kind != "ack" else 0, con, f"{k:02x}"))
    return rows


def walked(fold, rows, again=lambda f: f):
    out = []
    for row in rows:
        out += fold.close(row.ts_ms)
        fold.add(row)
        fold = again(fold)
    return sorted(out + fold.close(None), key=repr)


@pytest.mark.parametrize("span", [20_000, 700_000, HOUR, 4 * HOUR])
def test_indexed_and_plain_folds_agree(span):
    rng = random.Random(span)
    tags = set()
    for _ in range(150):
        rows = drawn(rng, rng.randint(1, 60), span)
        want = walked(plain_fold.Fold(), rows)
        assert walked(Fold(), rows) == want
        assert walked(Fold(), rows, lambda f: Fold.resumed(f.phases(), dict(f.waiting), f._count)) == want
        tags |= {(r[4], r[5]) for r in want}
    assert {t for t, _ in tags} == {"isyn", "isyn (acked)", "rsyn", "rsyn (acked)", "two-phase", "two-phase (no ack)"} and ("rsyn (acked)", True) in tags


def test_a_key_with_very_many_packets():
    rng = random.Random(1)
    for kinds in (("isyn",), ("rsyn",), ("ack",), ("isyn", "rsyn"), ("isyn", "rsyn", "ack")):
        rows = [Packet(1, 2, 80, k * HOUR // 100_000, k, k % 60_000, k, 0, 7, k, rng.choice(kinds), k + 1, k * HOUR // 100_000 + 5, "") for k in range(100_000)]
        start = time.perf_counter()
        walked(Fold(), rows)
        assert time.perf_counter() - start < 10


SCHEMA = "saddr long, daddr long, dport int, ts_ms long, step int, sport int, snum long, anum long, ipid int, userid long, probe_anum long, con_ms long, payload string, rst int, syn int, ack int, ttl int, options string"


def test_keys_with_one_kind_take_the_same_rows(spark):
    rng = random.Random(9)
    rows, want = [], []
    for key in range(80):
        own = [r._replace(saddr=key) for r in drawn(rng, rng.choice((1, 1, 2, 5, 30)), HOUR)]
        if key % 4:
            own = [r for r in own if r.kind == ("isyn", "rsyn", "ack")[key % 3]]
        fold = plain_fold.Fold()
        want += walked(fold, own)
        for r in own:
            d = r._asdict()
            kind = d.pop("kind")
            d |= {"rst": 0, "syn": int(kind != "ack"), "ack": int(kind == "ack"), "ttl": 250 if kind == "isyn" else 64, "options": "mss"}
            rows.append(tuple(d[c.split()[0]] for c in SCHEMA.split(", ")))
    got = assemble_handshakes(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_keys_whose_phases_cannot_contend_are_not_walked():
    """Keys with at most one SYN of each kind, in all orders and at all times, in one batch."""
    rng = random.Random(5)
    rows, want, tags = [], [], set()
    for key in range(3000):
        kinds = rng.sample(("isyn", "rsyn"), rng.choice((1, 1, 2))) + ["ack"] * rng.choice((0, 1, 1, 2, 3))
        rng.shuffle(kinds)
        span = rng.choice((3000, 700_000, HOUR, 3 * HOUR))
        own = []
        for k, ts in enumerate(sorted(rng.randrange(span) for _ in kinds)):
            kind, number = kinds[k], rng.randrange(3)
            con = None if kind == "ack" or rng.random() < 0.1 else ts + rng.choice((5, 900, 1500, 4000, 200_000, -900))
            own.append(Packet(key, 2, 80, ts, k, rng.randrange(2), number + 1, 0, k % 7, key * 10 + k, kind, number + 1 if kind != "ack" else 0, con, f"{k:02x}"))
        rows += own
        if 0 < key < 2999:
            found = walked(plain_fold.Fold(), own)
            want += found
            tags |= {r[4] for r in found}
    batch = handshakes.pa.RecordBatch.from_arrays([handshakes.pa.array(c) for c in zip(*rows)], handshakes.NEEDED)
    finished, waiting = handshakes._apart(batch, 600)
    keys = set(waiting.column("saddr").to_pylist())
    got = [tuple(r.values()) for r in finished.to_pylist()]
    assert sorted(map(repr, got)) == sorted(repr(r) for r in want if r[0] not in keys)
    assert len(tags) == 6 and len(keys) < 900
