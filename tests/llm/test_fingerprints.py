"""Fingerprints against a walk over all rows in one list."""

import hashlib
import random
import unicodedata

from duskwatch.llm import fingerprints as fp


def canon(text):
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split())


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t in rows]
    out = []
    for k, (i, _) in enumerate(rows):
        t, following = texts[k], texts[(k + 1) % len(rows)]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        same = [j for (j, _), x in zip(rows, texts) if canon(x) == canon(t)]
        ids = [j for j in same if j is not None]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), float(canon(t) == canon(new)), float(canon(t) == canon(following)), min(ids) if ids else None, len(same)))
    return sorted(out, key=str)


def found(df):
    names = ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next", "group_id", "group_size")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_made_up_texts(docs_of):
    texts = ["A  b", "a b", "ﬁne", "FINE", "", None, " ", "😀é" * 3, "a b", "x" * 999, "ß", "SS", "long text here"]
    rows = [(7 * k % 31, t) for k, t in enumerate(texts)]
    out = fp.fingerprint_documents(docs_of(rows)).cache()
    assert found(out) == brute(rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in out.collect()}
    ids = {t: i for i, t in rows}
    assert prints[ids["A  b"]] == prints[ids["a b"]] and prints[ids["ﬁne"]] == prints[ids["FINE"]] and prints[ids["ß"]] == prints[ids["SS"]]


def test_null_and_repeated_ids(docs_of):
    rows = [(None, "b"), (None, None), (2, "y"), (2, "x"), (1, "x")]
    got = [r[:5] for r in found(fp.fingerprint_documents(docs_of(rows)))]
    assert got == [r[:5] for r in brute(rows)]
    one = found(fp.fingerprint_documents(docs_of([(5, "abcd")])))
    assert one == brute([(5, "abcd")])
    assert fp.fingerprint_documents(docs_of([])).count() == 0


def test_crowded_ids_and_frequent_digests(docs_of, monkeypatch):
    monkeypatch.setattr(fp, "_OFTEN", 3)
    monkeypatch.setattr(fp, "_PIECE", 4)
    rng = random.Random(1)
    texts = ["same", "Same ", "other", "", None, "x" * 70 + "a", "x" * 70 + "b", "z", *[f"t{i}" for i in range(12)]]
    rows = [(rng.choice((None, None, 7, 7, 7, rng.randint(0, 60))), rng.choice(texts)) for _ in range(300)] + [(9, "same")] * 40
    for parts in (1, 5):
        assert found(fp.fingerprint_documents(docs_of(rows).repartition(parts))) == brute(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(fp.fingerprint_documents(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
