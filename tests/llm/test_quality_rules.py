"""Quality rules: counts against brute force, scores against the formula, labelled documents."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from duskwatch.llm import quality_rules as q
from duskwatch.llm.common import written


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t ", "a", "a a a", "a a a a", "a b c x a b c", "a b a b a b", "x\nx\n\n \nx\ny\r\ny\r", "# | <a> 😀 & % $ é*", "a b c " * 40, "w x y z\n" * 3, " ".join(map(str, range(60)))]


def test_counts_agree_with_brute_force(docs_of):
    docs = docs_of([*enumerate(TEXTS), (None, "a b"), (2, "twice"), (2, "twice")])
    got = sorted((tuple(r) for r in q.surface_counts(docs, "text", ["doc_id"]).collect()), key=str)
    assert got == sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=str)


def test_counts_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in q.surface_counts(docs, "text", ["doc_id"]).collect()}
    assert got == {r["doc_id"]: brute(r["text"]) for r in docs.collect()}


def test_scores_follow_the_formula(docs_of, spark):
    docs = docs_of([(1, "a b a"), (2, "B! WOW!!! ##c"), (3, "a a a"), (4, None)])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    n = 64
    bucket = {}

    def of(*gram):
        if gram not in bucket:
            a = spark.range(1).select(F.pmod(F.xxhash64(*map(F.lit, gram)), F.lit(n))).first()[0]
            bucket[gram] = a
        return bucket[gram]

    def grams(tokens):
        return [of(t) for t in tokens] + [0 if x == y else of(x, y) for x, y in zip(tokens, tokens[1:])]

    tokens = {1: ["a", "b", "a"], 2: ["B!", "\x01", "\x02", "\x02", "c"], 3: ["a", "a", "a"], 4: []}
    raw, good = Counter(g for t in tokens.values() for g in grams(t)), Counter(grams(tokens[1]))
    ratio = lambda b: math.log((good[b] + 1) / (good.total() + n)) - math.log((raw[b] + 1) / (raw.total() + n))
    want = {i: sum(map(ratio, grams(t))) / max(1, len(grams(t))) for i, t in tokens.items()}
    got = {r["doc_id"]: r["score"] for r in q.apply_rules(docs, labels, n=n).collect()}
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_labelled_documents_are_told_apart(spark):
    d = "/root/testdata/sf0.01"
    out = written(q.query(spark, d), "rules").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    assert out.where("quality = 1 and not kept").count() == 0
    assert out.where("quality = 0 and kept").count() == 0


def test_empty_tables(docs_of, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.apply_rules(docs_of([]), labels, n=16).count() == 0
    rows = q.apply_rules(docs_of([(1, None), (2, "x " * 60)]), labels, n=16).collect()
    assert [(r["base_failed"], r["kept"]) for r in sorted(rows)] == [(True, False), (True, False)]


def test_every_good_label_is_trusted(spark):
    labels = spark.range(20_100).selectExpr("id as doc_id", "1 as quality")
    assert q.trusted_ids(labels).count() == 20_100
    docs = spark.range(20_100).selectExpr("id as doc_id", "'a' as text").unionByName(spark.range(900).selectExpr("cast(null as long) as doc_id", "'b' as text"))
    ratios = q.log_ratios(docs, q.trusted_ids(labels))
    want = math.log(20_101 / (20_100 + q.BUCKETS)) - math.log(20_101 / (21_000 + q.BUCKETS))
    assert any(math.isclose(r, want, abs_tol=1e-9) for r in ratios)


def test_both_ways_of_finding_trusted_documents_agree(spark, docs_of, monkeypatch):
    docs = docs_of([*((i, f"word {i % 7} and more") for i in range(60)), *((None, f"none {i}") for i in range(9)), (5, "twice")])
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")
    few = q.log_ratios(docs, trusted)
    monkeypatch.setattr(q, "BROADCAST_IDS", 3)
    assert q.log_ratios(docs, trusted) == few
    assert q.log_ratios(docs, trusted.selectExpr("cast(doc_id as int) as doc_id")) == few
    monkeypatch.setattr(q, "BROADCAST_BLOCKS", 1)  # a filter that rules out little
    assert q.log_ratios(docs, trusted) == few


def test_only_texts_that_may_be_trusted_are_shuffled(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('text of ', id) as text")
    trusted = spark.range(0, 20_000, 100).withColumnRenamed("id", "doc_id")
    blocks = q.blocks_for(200)
    passed = q.with_possible(docs, "doc_id", q.bloom_filter(trusted, "doc_id", blocks), blocks).where("possible")
    assert 200 <= passed.count() < 300 and passed.join(trusted, "doc_id").count() == 200
