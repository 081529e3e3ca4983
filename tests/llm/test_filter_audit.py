"""Filter audit: given documents and hand-made ones in SQL, merges against sets, and a worked example."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duskwatch.llm import filter_audit as fa
from tests.llm.oracle import connect, same

MANY = " ".join(f"w{i}" for i in range(120))
TEXTS = [None, "", " \t\n\x0b\x0c\r", MANY, MANY, MANY + " #", "a " * 150, "A B " * 60, MANY.upper(), MANY.upper(), "w|w", "é é " * 120, "\x00 x", MANY + " ", "x" * 400_000 + " $" * 300_000, "#", "#"]


@pytest.fixture
def labels_of(spark):
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, part string")


def tables(docs_of, spark, rows, langs):
    docs = docs_of(rows)
    return docs.withColumn("lang", fa.F.element_at(fa.F.array(*[fa.F.lit(x) for x in langs]), fa.F.pmod(fa.F.coalesce("doc_id", fa.F.lit(0)), fa.F.lit(len(langs))).cast("int") + 1))


def test_given_documents_agree_with_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    assert same(fa.audit(docs, labels), connect(documents=docs, labels=labels), fa.SQL) == 600 * docs.select("lang").distinct().count()


def test_made_up_documents_agree_with_brute_force(spark, docs_of, labels_of, monkeypatch):
    rows = [*enumerate(TEXTS), (None, MANY), (None, ""), (3, MANY), (3, MANY), (-5, "#"), (40, None)]
    docs = tables(docs_of, spark, rows, ["en", None, "", "fr"])
    labels = labels_of([(0, 1, 0), (3, 1, 1), (3, 0, 1), (4, None, 1), (5, 1, None), (None, 1, 1), (99, 1, 1), (14, 1, 1)])
    con = connect(documents=docs, labels=labels)
    assert same(fa.audit(docs, labels), con, fa.SQL) == 1800
    monkeypatch.setattr(fa, "RANGE", 2)
    assert same(fa.audit(docs, labels), con, fa.SQL) == 1800


def test_repeats_of_common_and_rare_texts(spark):
    rows = spark.range(3000).selectExpr("id as row", "'p' as part", "id", "binary(if(id % 3 = 0, 'hot', concat('t', id div 6))) as digest")
    want = {i for i in range(3000) if i % 3 == 0 and i > 0} | {i for i in range(3000) if i % 3 and any(j // 6 == i // 6 and j % 3 for j in range(i - i % 6, i))}
    for hot in (1, 10, 2000):
        assert {r["row"] for r in fa.repeats(rows, hot).collect()} == want


def test_empty_tables(docs_of, labels_of):
    assert fa.audit(docs_of([]), labels_of([])).count() == 0
    only = fa.audit(docs_of([(1, MANY)]), labels_of([]))
    assert only.count() == 600 and only.where("part <> '' or kept <> 1 or removed + redundant + unique_fails + shapley > 0").count() == 0


def test_worked_example(docs_of, labels_of):
    """One text fails A, B and D; another D only."""
    got = {(r["filter_order"], r["step"]): r for r in fa.audit(docs_of([(1, "# " * 60), (2, MANY + " #")]), labels_of([(1, 1, 0), (2, 0, 1)])).collect()}
    r = got["ADBCE", 2]
    assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]) == (0, 1, 1, 1, 0, 1)
    assert got["ADBCE", 1]["shapley"] == 40 and r["shapley"] == 160


sorted_lists = st.lists(st.lists(st.integers(0, 3000), max_size=900, unique=True).map(sorted).map(lambda x: np.array(x, np.int64)), min_size=1, max_size=5)


@given(sorted_lists)
@settings(max_examples=60, deadline=None)
def test_merges_agree_with_sets(lists):
    sets = [set(x.tolist()) for x in lists]
    assert fa.union(lists).tolist() == sorted(set().union(*sets))
    assert fa.difference(lists[0], lists[-1]).tolist() == sorted(sets[0] - sets[-1])
    assert fa.common_size(lists[0], lists[-1]) == len(sets[0] & sets[-1])
    assert fa.gallop(lists[0], lists[-1]).tolist() == np.searchsorted(lists[-1], lists[0]).tolist()
