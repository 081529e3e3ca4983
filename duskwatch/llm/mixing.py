"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Tokens are summed by cell (source, language, topic).  Each dimension has target weights: those that the
caller gives (``targets``: dimension -> value -> weight), else a value's weight is the ``ALPHA``-th power of
its tokens.  Weights are scaled to a budget of ``BUDGET`` of all tokens.  Raking starts from the cells'
own tokens and scales them to the source, language and topic targets in turn, ``ROUNDS`` times; after
each round no cell may expect more tokens than it has.  What is then still missing from or above each
target is part of the result (``gap_*``: expected / target - 1), since a marginal whose cells are all
taken whole cannot be met.  A document is kept with its cell's probability (expected tokens / tokens),
decided by a hash of its id, so that a repeated run keeps the same documents.

A document's topic is the entry of ``TOPICS`` most of whose word stems it contains; where it has none,
its form stands for it: ``table``, ``note`` (under 100 words), ``article`` (under 1000) or ``book``.

Everything is built from DataFrame functions.  Marginals are grouped sums, so a value with a third of
all cells is summed up on the way; they and the cells are broadcast if they have at most
``BROADCAST_CELLS`` rows, and joined by shuffle beyond.  Defined cases: null source, language and text
are a value of their own (an empty string); a value that given targets do not name gets nothing, and
a target whose value does not occur is left to the others; documents without tokens are not sampled
(probability 0); rows of one id are kept or left together where they share a cell, and a null id hashes
as an empty string; topics of equally many stems go by their order; texts of any length are read whole;
extra columns stay; an empty table gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm.common import fresh, table, written

DIMENSIONS = ("source", "lang", "topic")
ALPHA, BUDGET, ROUNDS = 0.5, 0.5, 6
BROADCAST_CELLS = 50_000
_WORD = r"[^\x20\x09-\x0D]+"
#: Topic -> stems of its words, each counted once; without first letters that may be capitals.
TOPICS = (
    ("law", ("icens", "opyright", "ights reserved")),
    ("contact", ("@", "elephone")),
    ("computing", ("http", "oftware", " server")),
)


def n_words(text: Column | str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def form(text: Column | str, words: Column | str) -> Column:
    """The form of a text with so many words."""
    bars = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\|"))
    return F.when((bars >= 3) & (bars * 20 >= F.col(words)), "table").when(F.col(words) < 100, "note").when(F.col(words) < 1000, "article").otherwise("book")


def with_topic(df: DataFrame, name: str, text: str, words: str, topics=TOPICS) -> DataFrame:
    """Adds ``name``: the topic with most stems in the text, the first of several; the form if there is none."""
    t = F.coalesce(F.col(text), F.lit(""))
    counts = dict(zip(fresh([*df.columns, name], *[f"stems_{k}" for k, _ in topics]), topics))
    counted = df.withColumns({c: reduce(lambda x, y: x + y, [F.contains(t, F.lit(s)).cast("int") for s in own]) for c, (_, own) in counts.items()})
    best = F.greatest(*counts)
    chosen = F.coalesce(*[F.when((F.col(c) > 0) & (F.col(c) == best), F.lit(k)) for c, (k, _) in counts.items()])
    return counted.withColumn(name, F.coalesce(chosen, form(text, words))).drop(*counts)


def chance(doc_id: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the id: its first 52 bits."""
    text = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def _joined(cells: DataFrame, values: DataFrame, dimension: str, small: bool) -> DataFrame:
    """Cells with the columns of their value of a dimension."""
    return cells.join(F.broadcast(values) if small else values, dimension)


def _goals(cells: DataFrame, dimension: str, weights: dict[str, float] | None, alpha: float, tokens: float) -> tuple[DataFrame, bool]:
    """``dimension, g_<dimension>``: the tokens each value should get, and whether the values are few."""
    own = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("t"))
    if weights is None:
        weight = F.when(F.col("t") > 0, F.pow("t", F.lit(alpha))).otherwise(0.0)
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError(f"a target weight of {dimension} is negative")
        given = cells.sparkSession.createDataFrame([(str(v), float(w)) for v, w in weights.items()], f"{dimension} string, w double")
        own = own.join(given, dimension, "left")
        weight = F.when(F.col("t") > 0, F.coalesce("w", F.lit(0.0))).otherwise(0.0)
    own = own.select(dimension, weight.alias("w"))
    sums = own.agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).first()
    return own.select(dimension, (F.col("w") * F.lit(tokens) / F.lit(sums["w"] or 1.0)).alias(f"g_{dimension}")), sums["n"] <= BROADCAST_CELLS


def rake(cells: DataFrame, dimensions=DIMENSIONS, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """One row per cell, from ``dimensions, tokens``: ``dimensions, tokens, probability`` and, for each
    dimension, ``g_<dimension>`` (the tokens its value should get) and ``gap_<dimension>`` (how far
    what it is expected to get is from that, as a share of it; null for a target of 0).

    The driver holds a sum and a count for each dimension.  Each round is one job that sums its marginals one after the
    other and writes the cells to the shared folder, so that no round repeats those before it.
    """
    cells = written(cells.select(*[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in dimensions], "tokens"), "cells")
    total = float(cells.agg(F.sum("tokens").alias("t")).first()["t"] or 0)
    x, small = cells.withColumn("x", F.col("tokens").cast("double")), {}
    for d in dimensions:
        goals, small[d] = _goals(cells, d, (targets or {}).get(d), alpha, budget * total)
        x = _joined(x, goals, d, small[d])
    x = written(x, "goals")

    def marginal(x: DataFrame, d: str) -> DataFrame:
        return _joined(x, x.groupBy(d).agg(F.sum("x").alias("m")), d, small[d])

    for _ in range(rounds):
        for d in dimensions:
            x = marginal(x, d).withColumn("x", F.coalesce(F.try_divide(F.col("x") * F.col(f"g_{d}"), F.col("m")), F.lit(0.0))).drop("m")
        x = written(x.withColumn("x", F.least("x", F.col("tokens").cast("double"))), "raked")
    for d in dimensions:
        x = marginal(x, d).withColumn(f"gap_{d}", F.round(F.try_divide(F.col("m"), F.col(f"g_{d}")) - 1, 6)).drop("m")
    return x.select(*dimensions, "tokens", F.round(F.coalesce(F.try_divide("x", "tokens"), F.lit(0.0)), 9).alias("probability"), *[f"g_{d}" for d in dimensions], *[f"gap_{d}" for d in dimensions])


def residuals(raked: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """``dimension, value, target, expected, gap`` of every marginal of a raked table."""
    one = [raked.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.first(f"g_{d}").alias("target"), F.sum(F.col("tokens") * F.col("probability")).alias("expected"), F.first(f"gap_{d}").alias("gap")) for d in dimensions]
    return reduce(DataFrame.unionByName, one)


def with_cells(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """The documents with helper columns: source, language, topic and number of tokens."""
    names = fresh(docs.columns, "mix_source", "mix_lang", "mix_topic", "mix_tokens")
    out = docs.withColumns({names[0]: F.coalesce("source", F.lit("")), names[1]: F.coalesce("lang", F.lit("")), names[3]: n_words(text)})
    return with_topic(out, names[2], text, names[3]), names


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> tuple[DataFrame, list[str]]:
    """The documents with helper columns source, lang, topic, tokens, the three gaps, probability and kept; their names."""
    rows, names = with_cells(docs, text)
    source, lang, topic, tokens = names
    cells = rows.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(topic).alias("topic")).agg(F.sum(tokens).alias("tokens"))
    raked = written(rake(cells, **options), "mixture")
    p, kept, *more = fresh([*docs.columns, *names], "mix_probability", "mix_kept", "mix_gap_source", "mix_gap_lang", "mix_gap_topic", "cell_source", "cell_lang", "cell_topic")
    gaps, keys = more[:3], more[3:]
    cell = raked.select(*[F.col(d).alias(k) for d, k in zip(DIMENSIONS, keys)], *[F.col(f"gap_{d}").alias(g) for d, g in zip(DIMENSIONS, gaps)], F.col("probability").alias(p))
    if cell.count() <= BROADCAST_CELLS:
        cell = F.broadcast(cell)
    joined = rows.join(cell, (F.col(source) == F.col(keys[0])) & (F.col(lang) == F.col(keys[1])) & (F.col(topic) == F.col(keys[2])), "left").drop(*keys)
    return joined.withColumn(kept, chance(doc_id) < F.col(p)), [*names, *gaps, p, kept]


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The sampled documents, with their own columns."""
    mixed, names = mix(docs, doc_id, text, **options)
    return mixed.where(names[-1]).drop(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, names = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return mixed.select("doc_id", *[F.col(n).alias(a) for n, a in zip(names, (*DIMENSIONS, "n_tokens", *[f"gap_{d}" for d in DIMENSIONS], "probability", "kept"))])


def _sql() -> str:
    steps, last = [], "start"
    for k in range(ROUNDS):
        for d in DIMENSIONS:
            steps.append(f"x{k}_{d} AS MATERIALIZED (SELECT * EXCLUDE x, CASE WHEN sum(x) OVER (PARTITION BY {d}) > 0 THEN x * g_{d} / sum(x) OVER (PARTITION BY {d}) ELSE 0.0 END AS x FROM {last})")
            last = f"x{k}_{d}"
        steps.append(f"x{k} AS MATERIALIZED (SELECT * EXCLUDE x, least(x, CAST(tokens AS DOUBLE)) AS x FROM {last})")
        last = f"x{k}"
    totals = ", ".join(f"sum(tokens) OVER (PARTITION BY {d}) AS t_{d}" for d in DIMENSIONS)
    parts = ", ".join(f"sum(CASE WHEN t_{d} > 0 THEN pow(CAST(t_{d} AS DOUBLE), {ALPHA}) * tokens / t_{d} ELSE 0.0 END) AS z_{d}" for d in DIMENSIONS)
    targets = ", ".join(f"pow(CAST(t_{d} AS DOUBLE), {ALPHA}) * ({BUDGET} * total) / z_{d} AS g_{d}" for d in DIMENSIONS)
    gaps = ", ".join(f"CASE WHEN g_{d} > 0 THEN round(sum(x) OVER (PARTITION BY {d}) / g_{d} - 1, 6) END AS gap_{d}" for d in DIMENSIONS)
    word = r"[^\x20\x09-\x0D]+"
    stems = ", ".join(" + ".join(f"CAST(contains(text, '{s}') AS INTEGER)" for s in own) + f" AS n_{name}" for name, own in TOPICS)
    best = "greatest(" + ", ".join(f"n_{name}" for name, _ in TOPICS) + ")"
    by_stem = " ".join(f"WHEN n_{name} > 0 AND n_{name} = {best} THEN '{name}'" for name, _ in TOPICS)
    return f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text, CAST(len(regexp_extract_all(coalesce(text, ''), '{word}')) AS BIGINT) AS n_tokens FROM documents),
b AS (SELECT *, length(text) - length(replace(text, '|', '')) AS bars, {stems} FROM w),
d AS (SELECT doc_id, source, lang, n_tokens, CASE {by_stem} WHEN bars >= 3 AND bars * 20 >= n_tokens THEN 'table' WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'book' END AS topic FROM b),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
t AS MATERIALIZED (SELECT *, {totals} FROM c),
z AS MATERIALIZED (SELECT sum(tokens) AS total, {parts} FROM t),
start AS MATERIALIZED (SELECT source, lang, topic, tokens, {targets}, CAST(tokens AS DOUBLE) AS x FROM t, z),
{", ".join(steps)},
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN round(x / tokens, 9) ELSE 0.0 END AS probability, {gaps} FROM {last})
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, gap_source, gap_lang, gap_topic, probability,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / {float(1 << 52)!r} < probability AS kept
FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic
"""


SQL = _sql()
