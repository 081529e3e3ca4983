"""Mixing: the whole query against SQL, marginals, and edge cases."""

from duskwatch.llm import mixing
from tests.llm.oracle import connect, same


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mix_kept string, topic string")


def test_given_documents_agree_with_sql(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert same(mixing.query(spark, d), connect(documents=docs), mixing.SQL) == 200


def test_marginals_are_met_where_no_cell_is_full(spark):
    cells = spark.createDataFrame([(f"s{i % 3}", f"l{i // 3 % 2}", f"t{i // 6}", 100 * (i + 3) ** 2) for i in range(12)], "source string, lang string, topic string, tokens long")
    out = [r.asDict() for r in mixing.rake(cells, budget=0.1, rounds=6).collect()]
    total = sum(r["tokens"] for r in out)
    for d in mixing.DIMENSIONS:
        tokens, got = {}, {}
        for r in out:
            tokens[r[d]] = tokens.get(r[d], 0) + r["tokens"]
            got[r[d]] = got.get(r[d], 0) + r["tokens"] * r["probability"]
        z = sum(t**mixing.ALPHA for t in tokens.values())
        assert all(abs(got[k] - 0.1 * total * tokens[k] ** mixing.ALPHA / z) < 1e-4 * total for k in tokens)


def rows_of(raked):
    return {(r["dimension"], r["value"]): r.asDict() for r in mixing.residuals(raked).collect()}


def test_given_targets_are_met_and_what_cannot_be_is_reported(spark):
    cells = spark.createDataFrame([(s, l, t, 1000 * (i + 1)) for i, (s, l, t) in enumerate((s, l, t) for s in "ab" for l in "xy" for t in "pq")], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 3, "b": 1}, "lang": {"x": 1, "y": 1, "absent": 5}, "topic": {"p": 2, "q": 3}}
    got = rows_of(mixing.rake(cells, targets=targets, budget=0.05, rounds=6))
    assert len(got) == 6
    for d, own in targets.items():
        z = sum(w for v, w in own.items() if v != "absent")
        for v, w in own.items():
            if v != "absent":
                r = got[d, v]
                assert abs(r["target"] - 36_000 * 0.05 * w / z) < 1e-6 and abs(r["expected"] - r["target"]) < 1e-3 * r["target"] and abs(r["gap"]) < 1e-3
    # Source a has 10,000 tokens and should give 32,400: all of it is taken and the gap says so.
    got = rows_of(mixing.rake(cells, targets={"source": {"a": 9, "b": 1}}, budget=1.0, rounds=3))
    assert got["source", "a"]["expected"] <= 10_000 + 1e-6 and got["source", "a"]["gap"] < -0.6
    # A value that the targets do not name gets nothing.
    got = rows_of(mixing.rake(cells, targets={"lang": {"x": 1}}, budget=0.1, rounds=1))
    assert got["lang", "y"]["expected"] == 0 and got["lang", "y"]["gap"] is None


def test_topics_are_read_from_words(spark):
    texts = [("plain words", "note"), ("License and Copyright http", "law"), ("write to a@b, Telephone", "contact"), ("Software on a server", "computing"), ("a@b on a server", "contact"), ("a | b | c | d", "table"), ("w " * 2000, "book"), (None, "note")]
    docs = spark.createDataFrame(texts, "text string, want string").withColumn("n", mixing.n_words("text"))
    assert mixing.with_topic(docs, "topic", "text", "n").where("topic <> want").count() == 0


def test_nulls_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, None, None, 0, "a", "b"), (None, "x y", "en", None, 0, None, None), (2, "word " * 150, "en", "s", 0, "a", "b"), (2, "word " * 150, "en", "s", 0, "a", "b")]
    docs = made(spark, rows)
    mixed, names = mixing.mix(docs, rounds=1)
    got = [r.asDict() for r in mixed.collect()]
    assert len(got) == 4 and names[-1] == "_mix_kept"
    assert [r["mix_probability"] for r in got if r["text"] is None] == [0.0]
    twice = [r["_mix_kept"] for r in got if r["doc_id"] == 2]
    assert twice[0] == twice[1]
    assert mixing.sample(docs, rounds=1).columns == docs.columns
    assert mixing.sample(made(spark, []), rounds=1).count() == 0
