"""Token counts: histogram, suffix sums and limits against plain sums over encoded texts."""

from duskwatch.llm import token_counts as tc


def lengths(docs):
    encode = tc.encoder(tc.VOCABULARY).encode
    return [len(encode(r["text"])) if r["text"] else 0 for r in docs.select("text").collect()]


def check(table, n):
    rows = {r["length"]: r for r in table.collect()}
    assert sorted(rows) == sorted(set(n))
    for limit, r in rows.items():
        assert r["n_docs"] == n.count(limit) and r["n_tokens"] == limit * n.count(limit)
        assert r["docs_over"] == sum(x > limit for x in n) and r["tokens_over"] == sum(x for x in n if x > limit)
        assert r["truncated_tokens"] == sum(min(x, limit) for x in n)
        assert (r["total_docs"], r["total_tokens"]) == (len(n), sum(n))
        assert abs(r["share_within"] - sum(x <= limit for x in n) / len(n)) < 1e-12


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = lengths(docs)
    table = tc.query(spark, "/root/testdata/sf0.001").cache()
    check(table, n)
    check(tc.context_table(tc.length_histogram(docs, tc.encoded_length("text")), width=7), n)
    for limit in (0, 100, 777, 10**6):
        r = tc.at_limit(table, limit).first()
        assert (r["docs_over"], r["truncated_tokens"]) == (sum(x > limit for x in n), sum(min(x, limit) for x in n))
    assert tc.length_quantile(table, 0.5).first()["length"] == sorted(n)[(len(n) - 1) // 2]


def test_nulls_special_tokens_and_empty_tables(docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "<|endoftext|>"), (3, "a"), (3, "a"), (4, "é" * 2000)])
    check(tc.context_table(tc.length_histogram(docs, tc.encoded_length("text"))), lengths(docs))
    assert tc.context_table(tc.length_histogram(docs_of([]), tc.encoded_length("text"))).count() == 0


def test_long_runs_are_cut_where_the_pattern_cuts():
    whole = tc.Encoder(tc.VOCABULARY, 10**9)
    cut = tc.Encoder(tc.VOCABULARY, 3)
    for blank in (" ", "\n", "\t", "\u3000", " \n", "\x1c"):
        for k in (1, 2, 3, 4, 9):
            for text in (blank * k, blank * k + "a", "a" + blank * k + "1", "b!" + blank * k + "?" + blank * k, "é" + blank * k + " x", "a" + blank * k + "'s"):
                assert cut.encode(text) == whole.encode(text), repr(text)


def test_very_long_texts(docs_of):
    n = 1_000_000
    for text in (" " * n + "a", "\n" * n, "x" + "\n" * n + " y", "a" * n, "ab " * n, "!" * n, " " * (10 * n) + "a", "\n" * (10 * n), "a" * (10 * n)):
        assert len(tc.encoder(tc.VOCABULARY).encode(text)) > 0
    docs = docs_of([(1, " " * n + "a"), (2, "a" * n), (3, "\n" * n)])
    few = tc.encoder(tc.VOCABULARY).encode
    got = sorted(r["length"] for r in tc.length_histogram(docs, tc.encoded_length("text")).collect())
    # Blanks are tokens of their own, also in short runs; letters and newlines repeat with a period.
    assert got == sorted([n - 1 + len(few(" a")), n // 1000 * len(few("a" * 1000)), n // 1000 * len(few("\n" * 1000))])
