"""Texts of a million characters are read whole by the operators that have no such test of their own."""

import hashlib

import pytest

from duskwatch.llm import fingerprints, licenses, mixing, near_dup, quality_classifier, quality_rules, toxicity

N = 100_000
WORDS = [f"w{k % 9973}" for k in range(N)]
LONG = " ".join(WORDS)


@pytest.fixture(scope="module")
def given(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels")]


@pytest.fixture(scope="module")
def docs(spark, given):
    rows = [(10**6, LONG + " all rights reserved"), (10**6 + 1, LONG + " all rights reserveD."), (10**6 + 2, "x" * 1_000_000), (10**6 + 3, " " * 1_000_000), (10**6 + 4, LONG + " end")]
    own = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return given[0].unionByName(own)


def rows_of(df, *columns):
    return {r["doc_id"] - 10**6: tuple(r[c] for c in columns) for r in df.where("doc_id >= 1000000").collect()}


def test_license_scans(docs):
    got = rows_of(licenses.scan_licenses(docs), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got[0] == got[1] == (N + 3, 1, N, N, "reserved") and got[2] == (1, 0, None, None, "") and got[3] == (0, 0, None, None, "")


def test_quality_rules(docs, given):
    got = rows_of(quality_rules.apply_rules(docs, given[1]), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got[4] == (N + 1, sum(map(len, WORDS)) + 3, 0, 0, N, True) and got[2] == (1, 1_000_000, 0, 0, 0, True) and got[3][:2] == (0, 0)


def test_classifiers(docs, given):
    for df in (quality_classifier.classify(docs), toxicity.score_toxicity(docs, given[1])):
        got = rows_of(df, "score")
        assert len(got) == 5 and all(0 <= s <= 1 for (s,) in got.values())


def test_mixing(docs):
    mixed, names = mixing.mix(docs, rounds=1)
    assert rows_of(mixed, names[3], names[2]) == {0: (N + 3, "law"), 1: (N + 3, "book"), 2: (1, "note"), 3: (0, "note"), 4: (N + 1, "book")}


def test_fingerprints(docs):
    got = rows_of(fingerprints.fingerprint_documents(docs), "n_chars", "fingerprint", "edited_sha256")
    assert got[0][0] == len(LONG) + 20 and len({f for _, f, _ in got.values()}) == 5
    text, following = LONG + " all rights reserved", LONG + " all rights reserveD."
    half = len(text) // 2
    assert got[0][2] == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()


def test_near_duplicates(docs):
    got = rows_of(near_dup.near_duplicates(docs), "n_shingles", "component_id")
    assert got[0][1] == got[1][1] == got[4][1] == 10**6 and got[2] == (1, 10**6 + 2) and got[3][0] == 0
    assert got[4][0] == len({tuple((WORDS + ["end"])[k : k + 5]) for k in range(N - 3)})
