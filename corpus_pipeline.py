"""From raw documents to packed sequences: the five stages of the training-data pipeline.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the
last return the columns of ``documents``.  Between stages the documents are written to the shared
folder, so a lost executor repeats part of one stage only; tables that nothing needs any more are
deleted after each stage.  The classifiers' and near-duplicate stages have no SQL form, so there is no
SQL for the whole; tests hold it against brute force.

Defined cases: null and empty texts pass the classifiers (nothing speaks against them), are duplicates
of nothing, and are not sampled by the mixing stage; rows with null ids go through like others, one of
each group of near-duplicates staying; repeated rows of one id stay or go together; labels may be empty;
further columns stay whatever their names; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duskwatch.llm import mixing, near_dup, packing, quality_classifier, toxicity
from duskwatch.llm.common import collected, delete, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_classifier.keep_good(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier finds clean."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked from a similarity of 0.8."""
    return near_dup.drop_near_duplicates(docs, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with collected() as paths:
            docs = written(stage(spark, docs, sf_dir), name)
        delete(spark, before + paths[:-1])
        before = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
