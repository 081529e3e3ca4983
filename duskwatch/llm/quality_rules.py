"""Quality rules: surface counts, and a hashed n-gram log-likelihood ratio.

A text is read as tokens: white-space separated, with runs of two or more capitals written as one
mark and runs of symbols or of exclamation marks split off as another.  Its n-grams are
the tokens and the pairs of neighbours; a pair of equal neighbours is one n-gram of its own, whatever
the token.  N-grams are hashed into ``BUCKETS`` buckets, and two multinomials over the buckets are
counted with add-one smoothing: one over trusted documents, one over the whole raw corpus.  A
document's score is the mean log ratio of its n-grams, so length does not matter; a document is
kept if the score reaches a fixed threshold.

Trusted documents are all those labelled good (``trusted_rows`` can bound them, by a hash of the id): their
ids are broadcast if there are at most ``BROADCAST_IDS``.  Beyond that a blocked Bloom filter of the ids is broadcast
(at most 32 MB of bits, whatever their number), and only the texts that it lets pass are shuffled for an exact
join; corpus counts cover every document and never need a join then.  The table of log ratios has one number per bucket.

Everything is built from DataFrame functions, with at most one shuffle of texts, of trusted ones and few others.  Defined cases:
null and empty texts have no words, all counts 0, score 0 and fail the base rules; null or repeated
ids are rows like others, and equal texts have equal scores; a score at the threshold is kept; texts of any
length are read whole.  The folds of tokens fit the junk of the tables at hand (capitals, symbols, repeated
words); without them (``fold``) the threshold wants setting anew; extra columns are not read; an empty table gives none; without labels the
trusted and raw multinomials differ by smoothing only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm.common import table
from duskwatch.llm.url_filters import BROADCAST_BLOCKS, blocks_for, bloom_filter, with_possible

BUCKETS = 1 << 14
MIN_SCORE = -0.5
#: So many trusted ids at most are broadcast (8 MB).
BROADCAST_IDS = 1_000_000
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
_CAPITALS, _MARK = "\x01", "\x02"


def words(text: Column | str) -> Column:
    """The white-space separated words of a text, in order."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def surface_counts(docs: DataFrame, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """``keep`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each row.

    n_repeat_words counts the words that lie in a window of three words found more than once in the
    text: windows are compared by 64-bit hash, sorted with their places, and the places of those
    with an equal neighbour are covered three words each, overlaps once.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select(
        *keep,
        words(text).alias("_w"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    n = F.size("_w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    a = a.select(*keep, n.cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), windows.alias("_h"))
    a = a.withColumn("_sorted", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter("_sorted", lambda x, k: (x["h"] == F.get("_sorted", k - 1)["h"]) | (x["h"] == F.get("_sorted", k + 1)["h"]))
    a = a.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("_at", start, lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    return a.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tokens(text: Column | str, fold: bool = True) -> Column:
    """The tokens of a text as described above; without ``fold`` its white-space separated words."""
    t = F.coalesce(text, F.lit(""))
    if not fold:
        return words(text)
    t = F.regexp_replace(t, r"\p{Lu}{2,}", _CAPITALS)
    t = F.regexp_replace(t, rf"[{SYMBOLS}]+|!{{2,}}", f" {_MARK} ")
    return F.array_remove(F.split(t, SPACE), "")


def _single(w: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(n)).cast("int")


def _pair(x: Column, y: Column, n: int) -> Column:
    return F.pmod(F.when(x == y, F.lit(0).cast("long")).otherwise(F.xxhash64(x, y)), F.lit(n)).cast("int")


def _but_last(tokens: Column | str) -> Column:
    return F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))


def _but_first(tokens: Column | str) -> Column:
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))


def trusted_ids(labels: DataFrame, rows: int | None = None) -> DataFrame:
    """``doc_id`` of the documents labelled good; of about ``rows`` of them, by a hash of the id, if given."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    if rows is None:
        return good
    span = 1 << 31
    return good.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < int(span * min(1.0, rows / max(good.count(), 1))))


def _grams(rows: DataFrame, n: int, fold: bool) -> DataFrame:
    """``bucket`` of each n-gram of ``text``, beside the other columns."""
    own = [c for c in rows.columns if c != "text"]
    marked = rows.select(*own, tokens("text", fold).alias("t"))
    neighbours = marked.select(*own, F.inline(F.arrays_zip(F.col("t").alias("x"), _but_first("t").alias("y"))))
    grams = neighbours.select(*own, F.explode(F.array(_single(F.col("x"), n), F.when(F.col("y").isNotNull(), _pair(F.col("x"), F.col("y"), n)))).alias("bucket"))
    return grams.where("bucket is not null")


def log_ratios(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = BUCKETS, fold: bool = True) -> list[float]:
    """The log ratio trusted : raw of every bucket; n numbers, whatever the corpus."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    number = trusted.count()
    if number <= BROADCAST_IDS:
        marked = rows.join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left").select("good", "text")
        counts = _grams(marked, n, fold).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good"))
    else:
        # Raw counts need no ids; of the texts only those go through a shuffle whose id the filter does not rule out.
        ids = trusted.select(F.col("doc_id").cast(rows.schema["doc_id"].dataType).alias("doc_id"))
        blocks = min(blocks_for(number), BROADCAST_BLOCKS)
        likely = with_possible(rows, "doc_id", bloom_filter(ids, "doc_id", blocks), blocks).where("possible").select("doc_id", "text")
        good = likely.join(ids.hint("merge"), "doc_id", "left_semi").select("text")
        counted = [_grams(df, n, fold).groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).select("bucket", *[(F.col("c") if name == own else F.lit(0)).alias(name) for name in ("raw", "good")]) for own, df in (("raw", rows.select("text")), ("good", good))]
        counts = counted[0].unionByName(counted[1]).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = [0] * n, [0] * n
    for r in counts.collect():  # one row for each bucket
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    all_raw, all_good = sum(raw), sum(good)
    return [math.log((g + 1) / (all_good + n)) - math.log((r + 1) / (all_raw + n)) for r, g in zip(raw, good)]


def ratio_score(tokens: Column | str, ratios: list[float]) -> Column:
    """Mean log ratio of a token array's n-grams (0 without n-grams)."""
    looked_up = F.from_json(F.lit(json.dumps([round(r, 9) for r in ratios])), "array<double>")
    n = len(ratios)
    single = F.aggregate(tokens, F.lit(0.0), lambda s, w: s + F.get(looked_up, _single(w, n)))
    pairs = F.zip_with(_but_last(tokens), _but_first(tokens), lambda x, y: F.get(looked_up, _pair(x, y, n)))
    total = single + F.aggregate(pairs, F.lit(0.0), lambda s, r: s + r)
    return F.when(F.size(tokens) > 0, total / F.greatest(2 * F.size(tokens) - 1, F.lit(1))).otherwise(0.0)


def apply_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", min_score: float = MIN_SCORE, n: int = BUCKETS, trusted_rows: int | None = None, fold: bool = True) -> DataFrame:
    """One row per document: ``doc_id``, the counts, ``base_failed``, ``score`` and ``kept``."""
    ratios = log_ratios(docs, trusted_ids(labels, trusted_rows), doc_id, text, n, fold)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), tokens(text, fold).alias("_t"))
    scored = rows.select("doc_id", "_text", ratio_score("_t", ratios).alias("score"))
    counted = surface_counts(scored, "_text", ["doc_id", "score"])
    failed = base_failed()
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score") >= min_score)).alias("kept"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
