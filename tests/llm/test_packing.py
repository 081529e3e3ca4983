"""Best-fit packing: no overfull bin, nothing lost, bins of the smallest length that holds them,
and costs against all assignments and against plain best fit into one length."""

import random
from collections import Counter

import pytest

from duskwatch.llm import packing
from duskwatch.llm.token_counts import encoder, VOCABULARY


def test_bins_are_right_and_tight():
    rng = random.Random(4)
    lengths = [rng.choice((rng.randint(1, 64), rng.randint(1, 900), 1024)) for _ in range(3000)]
    sizes = (128, 256, 512, 1024)
    packed = packing.pack_lengths(lengths, sizes)
    bins = {}
    for n, (b, offset, capacity) in zip(lengths, packed):
        bins.setdefault((b, capacity), []).append((offset, n))
    for (_, capacity), pieces in bins.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert capacity == min(c for c in sizes if c >= at)
    assert len({b for b, _ in bins}) == len(bins)
    assert sum(lengths) / sum(c for _, c in bins) > 0.98


def test_each_piece_goes_to_the_fullest_bin_that_takes_it():
    assert [b for b, _, _ in packing.pack_lengths([600, 500, 400, 300, 100], (1024,))] == [0, 1, 0, 1, 1]


def partitions(items):
    """All ways of dealing items to bins."""
    if not items:
        yield []
        return
    first, *rest = items
    for some in partitions(rest):
        for k in range(len(some)):
            yield [*some[:k], [first, *some[k]], *some[k + 1 :]]
        yield [[first], *some]


def cost_of(bins, sizes, cost):
    """Cost of bins of given contents, each in the smallest size that holds it."""
    return sum(cost(min(c for c in sizes if c >= sum(b))) for b in bins) if all(sum(b) <= max(sizes) for b in bins) else float("inf")


def cost_packed(lengths, sizes, cost):
    bins = {}
    for n, (b, _, c) in zip(lengths, packing.pack_lengths(lengths, sizes, cost)):
        bins.setdefault((b, c), []).append(n)
    return sum(cost(c) for _, c in bins)


def plain_best_fit(lengths, prefer, sizes):
    """Longest first into the fullest bin that takes it; a new bin has the preferred size if that holds it."""
    bins = []
    for n in sorted(lengths, reverse=True):
        room = [b for b in bins if b[0] - sum(b[1]) >= n]
        if room:
            min(room, key=lambda b: b[0] - sum(b[1]))[1].append(n)
        else:
            bins.append((min(c for c in sizes if c >= max(n, prefer)), [n]))
    return [b for _, b in bins]


COSTS = (packing.bin_cost, lambda c: c, lambda c: c * c, lambda c: 5.0 + c)


@pytest.mark.parametrize("cost", COSTS)
def test_costs_against_all_assignments(cost):
    rng, sizes, got, best = random.Random(7), (4, 8, 16), 0.0, 0.0
    for _ in range(120):
        lengths = [rng.randint(1, rng.choice((3, 8, 16))) for _ in range(rng.randint(1, 7))]
        least = min(cost_of(bins, sizes, cost) for bins in partitions(lengths))
        mine = cost_packed(lengths, sizes, cost)
        assert least - 1e-9 <= mine <= 1.5 * least
        got, best = got + mine, best + least
    assert got <= 1.03 * best


@pytest.mark.parametrize("cost", COSTS)
def test_several_lengths_never_cost_more_than_one_of_them(cost):
    rng, sizes = random.Random(8), (128, 256, 512, 1024)
    for _ in range(30):
        top = rng.choice((40, 200, 700, 1024))
        lengths = [rng.randint(1, top) for _ in range(rng.randint(1, 80))]
        mine = cost_packed(lengths, sizes, cost)
        for prefer in sizes:
            assert mine <= cost_of(plain_best_fit(lengths, prefer, sizes), sizes, cost) + 1e-6


def opened(lengths, sizes, cost):
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    return Counter(packing._plan(lengths, order, sizes, None, cost)[2])


def test_what_is_left_decides_which_size_opens():
    sizes = (1024, 2048, 4096, 8192)
    assert opened([1000], sizes, packing.bin_cost) == {1024: 1}
    assert opened([1024] * 40, sizes, packing.bin_cost) == {2048: 20}
    assert opened([1365] * 300, sizes, packing.bin_cost) == {4096: 100}
    assert opened([1638] * 500, sizes, packing.bin_cost) == {8192: 100}
    assert set(opened([3000, 1096, 2048, 8192, 5, 5], sizes, packing.bin_cost)) == {4096, 2048, 8192, 1024}


def test_repeated_rows_are_dealt_to_many_shards(spark):
    for i in (7, None):
        rows = spark.createDataFrame([(i, 100)] * 4000, "doc_id long, n long").repartition(4)
        out = packing.best_fit_pack(rows, "doc_id", "n", shard_pieces=100).selectExpr("bin_id >> 32 as shard").groupBy("shard").count().collect()
        assert len(out) > 30 and sum(r["count"] for r in out) == 4000 and max(r["count"] for r in out) < 200


def test_the_layout_of_the_table_does_not_matter(spark):
    rows = [(i % 700 if i % 9 else None, (i * 7919) % 9000) for i in range(3000)] + [(5, 100)] * 5000
    first = spark.createDataFrame(rows, "doc_id long, n long")
    packed = [sorted((tuple(r) for r in packing.best_fit_pack(df, "doc_id", "n", shard_pieces=500).collect()), key=repr) for df in (first.repartition(4), first.orderBy("n").repartition(9), first.coalesce(1))]
    assert packed[0] == packed[1] == packed[2] and sum(r[3] for r in packed[0]) == sum(n for _, n in rows)


def test_long_null_and_repeated_documents(spark):
    rows = [(1, 2500), (2, None), (2, 0), (None, 10), (None, -4), (3, 1024), (3, 1024)]
    out = packing.best_fit_pack(spark.createDataFrame(rows, "doc_id long, n long"), "doc_id", "n", (256, 1024), shard_pieces=3).collect()
    pieces = sorted((r["start"], r["length"]) for r in out if r["doc_id"] == 1)
    assert pieces == [(0, 1024), (1024, 1024), (2048, 452)]
    assert sum(r["length"] for r in out if r["doc_id"] == 3) == 2048
    assert sorted(r["bin_id"] is None for r in out if r["doc_id"] == 2) == [True, True]
    assert sorted(r["length"] for r in out if r["doc_id"] is None) == [0, 10]
    assert packing.best_fit_pack(spark.createDataFrame([], "doc_id long, n long"), "doc_id", "n").count() == 0


def test_documents_are_packed_by_encoded_length(docs_of):
    texts = [(1, "Hello world"), (2, None), (3, "x" * 50)]
    encode = encoder(VOCABULARY).encode
    got = {r["doc_id"]: r["length"] for r in packing.pack_documents(docs_of(texts)).collect()}
    assert got == {i: len(encode(t)) + 1 if t else 0 for i, t in texts}
