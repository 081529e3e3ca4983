"""Prefix trie: given conversations in SQL, made-up ones against a plain trie, and bursts of every size."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from duskwatch.llm import prefix_trie as pt
from tests.llm.oracle import connect, same


@pytest.fixture
def talks_of(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, record string, depth int")


def plain(rows):
    """The contract's rows, one prefix after the other."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        below = [out[k] for k in kids[p]]
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), sum(b[5] for b in below) or 1, own + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def nodes(convs, **options):
    return sorted((tuple(r[c] for c in pt.COLUMNS) for r in pt.trie(convs, **options).collect()), key=repr)


def test_given_conversations_agree_with_sql(spark):
    talks = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert same(pt.trie(pt.rebuilt(pt.turns_of(talks))), connect(conversations=talks), pt.SQL) == 47


def made_up():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(95, 130), 205, 207, 299, 300, 301, -1, -3, -100, -150, 2**62]:
        first = rng.choice(["s", "s", "s", "é😀"])
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, turn, rng.choice(["user", None]), first if turn < 2 else rng.choice(["a", "bb", None, "", "ccc"])))
    return rows + [(7, None, "system", "null first"), (8, 0, "user", "tie"), (8, 0, "user", "tie"), (None, 0, "user", "nobody"), (600, 0, "u", "x" * 300_000), (601, 0, "u", "y"), (601, 9, "u", "z")]


@pytest.mark.parametrize("options", [{}, {"container": 1}, {"container": 5, "piece": 3}, {"container": 1, "most_rounds": 2}])
def test_made_up_conversations_agree_with_a_plain_trie(talks_of, options):
    rows = made_up()
    assert nodes(pt.rebuilt(pt.turns_of(talks_of(rows))), **options) == plain(rows)


def test_made_up_conversations_without_ties_agree_with_sql(talks_of):
    talks = talks_of([r for r in made_up() if r[3] != "tie"])
    assert same(pt.trie(pt.rebuilt(pt.turns_of(talks)), container=3), connect(conversations=talks), pt.SQL) > 100


def test_copies_and_chains(spark):
    """A third are copies; of the others each goes on where the one before ended."""
    convs = spark.range(90).selectExpr("id as conv_id", "if(id % 3 = 0, array(repeat('A', 32) || lpad('2', 16, '0'), lpad('2', 48, '0')), transform(sequence(1, int(id div 3) + 1), k -> repeat('B', 32) || lpad(hex(k), 16, '0'))) as turns")
    want = nodes(convs)
    assert want == nodes(convs, container=27) == nodes(convs, container=4, most_rounds=2, piece=2)
    root = next(n for n in want if n[1] == 0)
    assert (root[0], root[3], root[4], root[5]) == (0, 90, 2, 2)
    copies = next(n for n in want if n[1] == 2 and n[0] == 0)
    assert copies[3] == 30 and copies[7] == hashlib.sha256(",".join(str(i) for i in range(0, 90, 3)).encode()).hexdigest()


def test_empty_tables_and_turnless_conversations(talks_of):
    assert nodes(pt.rebuilt(pt.turns_of(talks_of([])))) == []
    rows = [(next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6), 0, "u", "gone")]
    assert nodes(pt.rebuilt(pt.turns_of(talks_of(rows)))) == plain(rows) and len(plain(rows)) == 1
