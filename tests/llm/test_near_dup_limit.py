"""The pipeline's near-duplicate stage against brute force at its own limit, 0.80."""

import numpy as np

from corpus_pipeline import STAGES
from duskwatch.llm.near_dup import linked_labels, matches_for
from tests.llm.test_near_dup import corpus, shingles


def kept(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i, _ in sets if find(i) == i}


def test_stage_links_from_four_fifths(spark, docs_of):
    rows = corpus(4, copies=20) + [(6000, " ".join(f"y{i}" for i in range(44))), (6001, " ".join(f"y{i}" for i in range(36)))]
    got = {r["doc_id"] for r in dict(STAGES)["near_duplicates"](spark, docs_of(rows), "").collect()}
    assert 6000 in got and 6001 not in got
    assert got == kept(rows, 80) != kept(rows, 85)


def test_matches_follow_the_limit():
    assert [matches_for(p) for p in (80, 85)] == [26, 30]


def test_very_long_sets_are_held_exactly():
    common, alone = 1_400_012, 247_061
    a, b = np.arange(common), np.r_[np.arange(common), np.arange(alone) + 10**7]
    labels = np.array([1, 2])
    assert 100 * common < 85 * (common + alone) and linked_labels(labels, [a, b], 85) == []
    assert linked_labels(labels, [a, b[:-1]], 85) == [(2, 1)]
