"""Near-duplicates against brute force over full sets of words."""

import random
import re

from duskwatch.llm import near_dup
from duskwatch.llm.near_dup import drop_near_duplicates, near_duplicates
from duskwatch.llm.components import components


def shingles(text, size=5):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, percent=85):
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
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def corpus(seed, bases=12, copies=30, words=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, words))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    rng.shuffle(rows)
    rows += ["", None, " \n\t", "One two", "one TWO", "a b c d e", "a b c d e f", "É é", "é é"]
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def test_agrees_with_brute_force(docs_of):
    rows = corpus(1)
    assert found(near_duplicates(docs_of(rows))) == brute(rows)


def test_large_groups_are_cut_into_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(near_dup, "_LONG_LIST", 5)
    rows = corpus(2, bases=2, copies=120, words=90)
    assert found(near_duplicates(docs_of(rows), block=16)) == brute(rows)


def templated(seed, pages=150, words=200, own=30):
    """Pages of one template, alike to about 0.7, some with near copies: a group that is no component."""
    rng = random.Random(seed)
    frame = [f"t{i}" for i in range(words)]
    rows = []
    for k in range(pages):
        text = [*frame, *[f"p{k}x{i}" for i in range(own)]]
        rows.append(" ".join(text))
        if k % 10 == 0:
            rows.append(" ".join([*text[:-3], "other", "end"]))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_pages_of_a_template_are_listed_by_rare_shingles(docs_of):
    for percent, own in ((85, 30), (85, 36), (80, 50)):
        rows = templated(5, own=own)
        want = brute(rows, percent)
        assert 1 < len({c for _, c, _ in want.values()}) < len(rows)
        assert found(near_duplicates(docs_of(rows), block=8, percent=percent)) == want


def test_exact_mode_and_recall_near_the_limit(docs_of):
    """Pairs of sets at 0.85 to 0.87; the exact mode finds all, the signatures nearly all."""
    rng = random.Random(6)
    rows = []
    for k in range(300):
        n = rng.randint(100, 300)
        text = [f"r{k}w{i}" for i in range(n + 4)]
        cut = int(n * rng.uniform(0.138, 0.15))  # shingles of the second that the first lacks
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[: len(text) - cut]))]
    want = brute_pairs = {2 * k + 1 for k in range(300) if (lambda a, b: 100 * len(a & b) >= 85 * len(a | b))(shingles(rows[2 * k][1]), shingles(rows[2 * k + 1][1]))}
    assert len(brute_pairs) > 150
    gone = lambda df: {r["doc_id"] for r in df.where("not kept").collect()}
    assert gone(near_duplicates(docs_of(rows), exact=True)) == want
    got = gone(near_duplicates(docs_of(rows)))
    assert got <= want and len(got) >= 0.99 * len(want)


def test_exact_mode_agrees_with_brute_force(docs_of):
    rows = corpus(8, bases=6, copies=20)
    assert found(near_duplicates(docs_of(rows), exact=True)) == brute(rows)


def test_null_and_repeated_ids_and_empty_tables(docs_of):
    out = near_duplicates(docs_of([(None, "a b c d e f"), (5, "a b c d e f"), (5, "other words are here now again"), (7, "other words are here now again"), (None, "alone by itself")]))
    rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in out.collect()), key=str)
    assert rows == sorted([(None, 5, False), (5, 5, True), (5, 5, True), (7, 5, False), (None, None, True)], key=str)
    assert near_duplicates(docs_of([])).count() == 0 and near_duplicates(docs_of([]), exact=True).count() == 0


def test_rows_without_ids_are_linked(docs_of):
    base = [f"w{i}" for i in range(100)]
    near, other = [*base[:-1], "x"], [f"o{i}" for i in range(100)]
    rows = [(None, " ".join(near)), (9, " ".join(base)), *[(None, " ".join([*other[: 99 - k % 2], "y", "z"][:100])) for k in range(4)], (None, ""), (None, None), (3, None)]
    out = near_duplicates(docs_of(rows)).collect()
    assert sorted((r["component_id"] for r in out if r["doc_id"] is None and r["n_shingles"] > 50), key=str) == [9, None, None, None, None]
    kept = drop_near_duplicates(docs_of(rows)).collect()
    assert sorted((r["doc_id"] or 0, len(r["text"] or "") > 50) for r in kept) == [(0, False), (0, False), (0, True), (3, False), (9, True)]
    high = near_duplicates(docs_of([(2**62 + 5, "a b c d e f"), (None, "a b c d e f"), (None, "alone by itself")])).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in high), key=str) == sorted([(2**62 + 5, 2**62 + 5), (None, 2**62 + 5), (None, None)], key=str)


def test_dropping_keeps_all_columns(docs_of):
    docs = docs_of([(2, "a b c d e f"), (1, "A  b c D e F"), (3, None)])
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_components_of_a_long_path(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    labels = {r["node"]: r["label"] for r in components(links).collect()}
    assert labels == {i: 0 for i in range(1, n + 1)} | {1001: 1000}
