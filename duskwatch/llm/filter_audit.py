"""Filter interaction audit: sorted posting lists of the rows that fail each filter, merged over id ranges.

Every row gets a number, and each filter keeps, for each part and range of ``RANGE`` numbers, the sorted list of
the rows that fail it; labels are lists of the same kind.  What a filter removes after others depends only
on which they are, so for each set of filters the union of their lists, and for each further filter the
difference from that union, are merged within the range; their sizes are summed over ranges.  All
orders of the filters are read from those sums.

* A merge keeps the longer list whole and seeks the other's entries in it, block by block: from where the last
  block ended it gallops (steps double) until it is past the block, and searches only what lies between.
* A range holds at most ``RANGE`` rows, so a part, a text or an id that a third of all rows share is no hot
  group: nothing larger than a range's lists is in one task, and each range sends one row for each set and filter.
* Rows that repeat an earlier text are found by digests (SHA-256).  A digest's rows are counted before the
  join with its smallest id; those of the at most ``HOT`` digests with more than 1/HOT of all rows are joined by
  a broadcast, all others by a shuffle.
* Rows are numbered once, in the table that is written after the texts have been read; a lost task numbers
  its rows again in the same way before its output counts.

Defined cases: a null text is empty (no words: fails A); a null part is ''; a null id is neither smaller nor
larger than others, so its row fails E never and makes no other row fail; rows of the same id and text do not fail E
by each other, and each counts; a label counts if any of an id's rows in ``labels`` has it; texts of any length
are read whole; other columns are not read; an empty table gives no parts and so no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import table, written

RANGE = 65_536
HOT = 2_000
BLOCK = 256
FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: Bits of a posting beyond the filters'.
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
WORD_BREAK = r"[\x20\x09-\x0D]+"


def failures(text: Column | str) -> dict[str, Column]:
    """The filters that a text alone decides: A (few words), B (repeated ones), C (capitals), D (symbols)."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


def gallop(entries: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each of the sorted ``entries``, the place of the first of ``among`` that is not smaller."""
    places, at = np.empty(len(entries), np.int64), 0
    for start in range(0, len(entries), BLOCK):
        block = entries[start : start + BLOCK]
        step = BLOCK
        while at + step < len(among) and among[at + step] < block[-1]:
            step *= 2
        found = at + np.searchsorted(among[at : at + step + 1], block)
        places[start : start + len(block)] = found
        at = int(found[-1])
    return places


def within(entries: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which entries are in the other list."""
    if not len(among):
        return np.zeros(len(entries), bool)
    return among[np.minimum(gallop(entries, among), len(among) - 1)] == entries


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[~within(a, b)]


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    short, long = (a, b) if len(a) < len(b) else (b, a)
    return int(within(short, long).sum())


def union(lists: list[np.ndarray]) -> np.ndarray:
    """All entries of sorted lists, once each: the shorter ones are merged first."""
    merged = np.zeros(0, np.int64)
    for longer in sorted(lists, key=len):
        fresh = difference(merged, longer)
        merged = np.insert(longer, gallop(fresh, longer), fresh)
    return merged


def _sizes(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """``earlier, filter, removed, good, toxic`` for each set of filters and each further one."""
    out = []
    for size in range(len(lists)):
        for chosen in combinations(range(len(lists)), size):
            gone = union([lists[k] for k in chosen])
            for k in set(range(len(lists))) - set(chosen):
                removed = difference(lists[k], gone)
                if len(removed):
                    out.append((sum(1 << c for c in chosen), k, len(removed), common_size(removed, good), common_size(removed, toxic)))
    return out


def sums(postings: DataFrame) -> DataFrame:
    """``part, earlier, filter, removed, good, toxic`` of postings ``part, row, mask``; zeros are left out.

    ``mask`` tells the lists that a row is on; a row may have several postings.
    """
    schema = pa.schema([("part", pa.string()), ("earlier", pa.int32()), ("filter", pa.int32()), ("removed", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        row, mask = (rows.column(c).to_numpy() for c in ("row", "mask"))
        order = np.argsort(row, kind="stable")
        row, mask = row[order], mask[order]
        *lists, good, toxic = [row[mask & (1 << bit) != 0] for bit in range(len(FILTERS) + 2)]
        counted = _sizes(lists, good, toxic)
        columns = list(zip(*counted)) if counted else [()] * 5
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(counted), pa.string()), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]], schema=schema)

    ranged = postings.withColumn("range", F.floor(F.col("row") / RANGE)).groupBy("part", "range")
    by_range = ranged.applyInArrow(merge, "part string, earlier int, filter int, removed long, good long, toxic long")
    return by_range.groupBy("part", "earlier", "filter").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic")])


def repeats(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Those of ``rows`` (``row, part, id, digest``) whose digest a smaller id has too."""
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    first = written(first, "first-ids")
    total = rows.count()
    often = first.where(F.col("n") > F.lit(total / hot))  # at most ``hot`` rows, whatever the table
    rare = first.where(F.col("n") <= F.lit(total / hot))
    later = F.col("id") > F.col("first")
    by_broadcast = rows.join(F.broadcast(often.select("digest", "first")), "digest").where(later)
    by_shuffle = rows.join(F.broadcast(often.select("digest")), "digest", "left_anti").join(rare.select("digest", "first"), "digest").where(later)
    return by_broadcast.select("row", "part").unionByName(by_shuffle.select("row", "part"))


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang", failing: Callable[[Column], dict[str, Column]] = failures) -> DataFrame:
    """One row per part, order of the filters and step; see the module's first lines for how.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: of the step's
    filter, the rows of the part that stay after it, go at it, fail it but went before, fail it and no other, and of
    those that go the ones labelled good and toxic; ``shapley`` sums what the filter removes over all orders.
    """
    fails = failing(F.col(text))
    mask = sum((F.when(fails[f], 1 << k).otherwise(0) for k, f in enumerate(FILTERS[:-1])), F.lit(0))
    read = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"))
    rows = written(read.withColumn("row", F.monotonically_increasing_id()), "audited")
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic")).where("good or toxic")
    labelled = rows.select("row", "part", "id").join(marked, "id").select("row", "part", (F.when(F.col("good"), GOOD).otherwise(0) + F.when(F.col("toxic"), TOXIC).otherwise(0)).alias("mask"))
    repeated = repeats(rows).withColumn("mask", F.lit(1 << FILTERS.index("E")))
    postings = rows.where("mask <> 0").select("row", "part", "mask").unionByName(repeated).unionByName(labelled)
    return orders(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), sums(postings))


def orders(parts: DataFrame, counted: DataFrame) -> DataFrame:
    """The result of ``parts`` (``part, n``) and :func:`sums`: every order and step for each part."""
    steps = [("".join(o), s + 1, sum(1 << FILTERS.index(f) for f in o[:s]), FILTERS.index(o[s])) for o in permutations(FILTERS) for s in range(len(FILTERS))]
    every = F.explode(F.array(*[F.struct(F.lit(e).alias("earlier"), F.lit(f).alias("filter")) for e, f in sorted({s[2:] for s in steps})])).alias("cell")
    cells = parts.select("part", "n", every).select("part", "n", "cell.*").join(counted, ["part", "earlier", "filter"], "left").fillna(0, ["removed", "good", "toxic"])
    own = Window.partitionBy("part", "filter")
    at = lambda earlier: F.max(F.when(F.col("earlier") == earlier, F.col("removed"))).over(own)
    size = F.bit_count("earlier")
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))]), size + 1)
    cells = cells.withColumns({"fails": at(0), "unique_fails": at(F.lit(ALL) - F.call_function("shiftleft", F.lit(1), F.col("filter"))), "shapley": F.sum(F.col("removed") * weight).over(own)})
    placed = cells.join(F.broadcast(parts.sparkSession.createDataFrame(steps, "filter_order string, step int, earlier int, filter int")), ["earlier", "filter"])
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    kept = F.col("n") - F.sum("removed").over(so_far)
    return placed.select("part", "filter_order", "step", kept.alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same by brute force: every row against every order.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, list_filter(string_split_regex(coalesce(text, ''), '{WORD_BREAK}'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT k, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  {{'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)}} AS x
  FROM d LEFT JOIN l USING (doc_id)),
s(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM s a JOIN s b ON b.f <> a.f JOIN s c ON c.f NOT IN (a.f, b.f) JOIN s d ON d.f NOT IN (a.f, b.f, c.f) JOIN s e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
y AS (SELECT part, good, toxic, CAST(x.A AS INT) AS a, CAST(x.B AS INT) AS b, CAST(x.C AS INT) AS c, CAST(x.D AS INT) AS d, CAST(x.E AS INT) AS e, count(*) AS n FROM f GROUP BY ALL),
z AS (SELECT y.*, o, step, a + b + c + d + e AS n_fails, list_transform(string_split(o, ''), lambda q: CASE q WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS v FROM y, o, range(1, 6) r(step)),
g AS (SELECT part, o AS filter_order, step, o[step] AS letter, CAST(sum(n) AS BIGINT) AS n,
  CAST(sum(CASE WHEN list_sum(v[:step]) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN v[step] = 1 AND list_sum(v[:step]) = 1 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN v[step] = 1 AND list_sum(v[:step]) > 1 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN v[step] = 1 AND n_fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN v[step] = 1 AND list_sum(v[:step]) = 1 AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN v[step] = 1 AND list_sum(v[:step]) = 1 AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM z GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g
"""
