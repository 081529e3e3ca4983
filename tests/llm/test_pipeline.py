"""The pipeline: each stage's decisions against the operator's own table or brute force."""

import corpus_pipeline
from duskwatch.llm import mixing, near_dup, quality_classifier, toxicity
from duskwatch.llm.common import collected, table, written
from tests.llm.test_near_dup import brute

D = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_follow_their_operators(spark):
    docs = table(spark, D, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "toxicity", "near_duplicates", "mixing", "best_fit_packing"]
    stage = dict(corpus_pipeline.STAGES)

    good = written(stage["quality_classifier"](spark, docs, D), "good")
    assert good.columns == docs.columns
    assert ids(good) == ids(quality_classifier.classify(docs).where("kept"))
    labels = table(spark, D, "labels")
    junk = {r["doc_id"] for r in labels.where("quality = 1").collect()} - set(ids(good))
    assert not junk

    clean = written(stage["toxicity"](spark, good, D), "clean")
    assert clean.columns == docs.columns
    assert ids(clean) == ids(toxicity.score_toxicity(good, labels).where("predicted = 0"))

    single = written(stage["near_duplicates"](spark, clean, D), "single")
    assert ids(single) == sorted(i for i, (_, _, kept) in brute([(r["doc_id"], r["text"]) for r in clean.collect()], 80).items() if kept)

    mixed = written(stage["mixing"](spark, single, D), "mixed")
    rows, columns = mixing.mix(single)
    assert mixed.columns == docs.columns and ids(mixed) == ids(rows.where(columns[-1]))

    packed = stage["best_fit_packing"](spark, mixed, D).collect()
    assert sorted({r["doc_id"] for r in packed}) == ids(mixed)
    used = {}
    for r in packed:
        used.setdefault((r["bin_id"], r["capacity"]), []).append((r["bin_offset"], r["length"]))
    for (_, capacity), pieces in used.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_run_leaves_only_what_its_result_needs(spark):
    with collected() as paths:
        rows = corpus_pipeline.run(spark, D).collect()
    docs = {r["doc_id"] for r in table(spark, D, "documents").collect()}
    got = {r["doc_id"] for r in rows}
    assert got and got < docs and all(r["bin_id"] is not None for r in rows if r["length"])
    # The stages' own tables were collected and deleted inside; what is left belongs to the last stage.
    assert [p.rsplit("/", 1)[1].split("-")[0] for p in paths] == ["lengths"]


def test_stages_take_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, votes int, `set_n` int, kept boolean"
    rows = [(None, None, None, None, None, 1, 2, True), (None, "some words are here now", None, None, 3, None, None, None), (None, "some words are here now", None, None, 3, None, None, None), (4, "", "en", "s", 0, 1, 1, False), (5, "some other words are here", "en", "s", 0, 1, 1, False), (5, "some other words are here", "en", "s", 0, 1, 1, False)]
    for some in ([], rows):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "best_fit_packing" or out.columns == docs.columns
            n = out.count()
            assert n == 0 if not some else n == len(rows) - 1 if name == "near_duplicates" else n > 0 or name == "mixing"
