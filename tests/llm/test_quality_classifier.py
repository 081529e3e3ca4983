"""Quality classifier: labellers by hand and in plain Python, the label model on drawn votes, labelled documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from duskwatch.llm import quality_classifier as q
from duskwatch.llm.common import written
from duskwatch.llm.hashed_words import bounded_sample, train_linear


def votes(*texts):
    return [[c // 3**k % 3 for k in range(len(q.LABELLERS))] for c in q.vote_codes(pa.array(texts)).tolist()]


def test_labellers_see_their_faults():
    plain = " ".join(f"word{i % 40}x{i // 3}" for i in range(70))
    same, loud, signs, short, empty = votes("of " * 80, plain.upper().replace(" ", "!! "), plain.replace(" ", "### "), "a b", None)
    assert votes(plain)[0].count(q.BAD) == 0
    assert same[0] == q.BAD and same[4] == q.BAD and same[5] == q.BAD
    assert loud[1] == q.BAD and loud[2] == q.BAD and signs[3] == q.BAD
    assert set(short) == set(empty) == {q.NONE}


def test_measures_do_not_mix_texts():
    x, n = q.measures(pa.array(["a b c", "a b c", None, "c a b c a b"]))
    assert n.tolist() == [3, 3, 0, 6] and x[:3, 4].tolist() == [0, 0, 0] and x[3, 4] == 1


def drawn(rng, n=20_000, share=0.85):
    """Votes on drawn documents: a bad one has one of four faults, which two or three labellers see."""
    k = len(q.LABELLERS)
    good = rng.random(n) < share
    seen = np.zeros((4, k))
    for fault, labellers in enumerate(((0, 4, 5), (1, 2), (3, 8), (6, 7))):
        seen[fault, list(labellers)] = 0.95
    rate = np.where(good[:, None], 0.001, seen[rng.integers(0, 4, n)] + 0.001)
    votes = (rng.random((n, k)) < rate).astype(int)
    votes[rng.random((n, k)) < 0.1] = q.NONE
    return good, votes


def fitted(votes):
    codes = votes @ 3 ** np.arange(len(q.LABELLERS))
    posterior, shares, rates = q.label_model(dict(zip(*(x.tolist() for x in np.unique(codes, return_counts=True)))))
    return np.array([posterior[c] for c in codes.tolist()]) > 0.5, shares, rates


def test_estimation_recovers_drawn_documents():
    good, votes = drawn(np.random.default_rng(3))
    found, shares, rates = fitted(votes)
    assert np.mean(found == good) > 0.98 and abs(shares[0] - 0.85) < 0.02 and rates[0].max() < 0.02


def test_a_labeller_that_is_often_wrong_is_found_out():
    for noisy in (0, 2, 4, 8):
        rng = np.random.default_rng(noisy)
        good, votes = drawn(rng)
        wrong = (rng.random(len(votes)) < 0.2) & (votes[:, noisy] != q.NONE)
        votes[wrong, noisy] = 1 - votes[wrong, noisy]
        found, _, rates = fitted(votes)
        assert np.mean(found == good) > 0.97
        assert 0.1 < rates[0][noisy] < 0.25 and np.delete(rates[0], noisy).max() < 0.02


def words_of(text):
    return [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    low = words_of(text)
    n = max(1, len(words))
    letters = [c for w in words for c in w if c.isascii() and c.isalpha()]
    wide = sum(len(c.encode()) for w in words for c in w if not c.isascii())
    windows = [tuple(low[i : i + 3]) for i in range(len(low) - 2)]
    twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    symbols = "#*$%&|<>"
    return [
        sum(a == b for a, b in zip(low, low[1:])) / n,
        sum(c.isupper() for c in letters) / max(1, len(letters) + wide),
        sum(w.endswith("!!") for w in words) / n,
        sum(c in symbols for w in words for c in w) / n,
        len(twice) / n,
        1 - len(set(low)) / n,
        sum(len(w.encode()) > 25 for w in words) / n,
        sum(not any(c.isalpha() and c.isascii() or not c.isascii() for c in w) for w in words) / n,
        sum(w[-1] in symbols for w in words) / n,
    ]


def texts(seed, n=60):
    rng = random.Random(seed)
    pool = ["the", "The", "WORLD!!", "a###", "##", "É", "naïve", "x" * 30, "12", "|", "word", "w!", "!!", "other", "more"]
    return [None, "", " \n", *[rng.choice((" ", "\n", "  ")).join(rng.choice(pool[: rng.randint(2, len(pool))]) for _ in range(rng.randint(1, 60))) for _ in range(n)]]


def test_measures_agree_with_plain_python():
    got, n = q.measures(pa.array(texts(1)))
    for row, size, text in zip(got, n, texts(1)):
        assert size == len(words_of(text)) and np.allclose(row, plain_measures(text) if size else [0, 0, 0, 0, 0, 1, 0, 0, 0], atol=1e-12), text


def shape(word):
    kinds = ["A" if c.isascii() and c.isupper() else "a" if c.isascii() and c.islower() else "0" if c.isascii() and c.isdigit() else c if c.isascii() else "é" for c in word]
    return "".join(k for k, before in zip(kinds, [None, *kinds]) if k != before)


def test_features_agree_with_plain_python():
    some = texts(2)
    row, ids, x = q.features(pa.array(some), 1 << 40)  # so many buckets that nothing collides
    by_row = {}
    for r, i, v in zip(row.tolist(), ids.tolist(), x.tolist()):
        by_row.setdefault(r, {})[i] = v
    for r, text in enumerate(some):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        low = words_of(text)
        want = Counter([("w", w) for w in low] + [("s", shape(w)) for w in words])
        same = sum(a == b for a, b in zip(low, low[1:]))
        got = by_row.get(r, {})
        share = lambda v: round(4 * v / len(words), 9)
        assert sorted(round(v, 9) for i, v in got.items() if i < 1 << 40) == sorted(map(share, want.values()))
        assert [round(got.get((1 << 40) + k, 0), 9) for k in (0, 1)] == ([share(len(low) - same), share(same)] if words else [0, 0])


def test_linear_training_agrees_with_plain_steps(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        ids = rng.sample(range(6), rng.randint(0, 4))
        rows.append((ids, [rng.random() for _ in ids], float(2 in ids)))
    got, bias = train_linear(spark.createDataFrame(rows, "ids array<int>, x array<float>, target double"), 6, parts=1, rounds=40)
    w, m, v = [0.0] * 7, [0.0] * 7, [0.0] * 7
    for step in range(1, 41):
        g = [1e-4 * c for c in w[:6]] + [0.0]
        for ids, x, y in rows:
            error = 1 / (1 + math.exp(-w[6] - sum(w[i] * np.float32(c) for i, c in zip(ids, x)))) - y
            for i, c in zip(ids, x):
                g[i] += error * np.float32(c) / len(rows)
            g[6] += error / len(rows)
        for i in range(7):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.999 * v[i] + 0.001 * g[i] ** 2
            w[i] -= 0.2 * (m[i] / (1 - 0.9**step)) / (math.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    assert np.allclose([*got, bias], w, atol=1e-6)


def test_the_sample_is_bounded_whatever_repeats(spark):
    rows = spark.createDataFrame([(None, f"text {i % 500}") for i in range(5000)] + [(7, "same")] * 5000 + [(i, f"t {i}") for i in range(2000)], "doc_id long, text string")
    assert bounded_sample(rows, 12_000, 300).count() < 200
    assert bounded_sample(rows, 12_000, 10**6).count() == 500 + 1 + 2000


def test_labelled_documents_are_told_apart(spark):
    d = "/root/testdata/sf0.01"
    out = written(q.query(spark, d), "kept").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert out.where("quality = 1 and not kept").count() == 0
    assert out.where("quality = 0 and kept").count() <= 0.1 * out.where("quality = 0").count()


def test_nulls_repeats_and_empty_tables(docs_of):
    assert q.classify(docs_of([])).count() == 0
    rows = q.classify(docs_of([(1, None), (None, ""), (2, "some words here"), (2, "some words here")])).collect()
    assert len(rows) == 4 and all(r["kept"] for r in rows)
