"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Every document is encoded whole.  Documents are then aggregated by encoded length, so that what is
shuffled is one row per distinct length and task, and suffix sums over that histogram answer, for
every context limit L: how many documents are longer, how many tokens there are in all, how many
remain if each document is cut to L tokens, and which share of the documents fits (quantiles).

Null and empty texts have length 0.  Texts of any length are encoded whole; white-space runs longer
than ``LONG_RUN``, which the splitting pattern cannot walk, are cut where the pattern would cut them.
Columns other than the text are never read, so they may have any names and nulls.  Repeated rows
count as often as they occur; texts of equal length share a row.  An empty table gives an empty
histogram.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import table, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this public vocabulary splits text before merging; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space as the pattern's \\s has it; fixed values.
_SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Longer runs of white space are encoded on their own: the pattern's look-ahead would overflow its stack.
LONG_RUN = 100_000


class Encoder:
    """A byte-level BPE encoder of whole texts of any length."""

    def __init__(self, path: str, long_run: int = LONG_RUN):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._split = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._whole = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._long = re.compile(f"[{_SPACES}]{{{long_run},}}")
        self._least = long_run

    def encode(self, text: str) -> list[int]:
        """The tokens of a text; strings of special tokens are ordinary text.

        In a run of white space before a word, the pattern takes all but the last character as one
        piece and leaves that one to the word; at the end of the text it takes the whole run.
        """
        if len(text) < self._least:
            return self._split(text)
        tokens, at = [], 0
        for run in self._long.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            tokens += self._split(text[at : run.start()]) + self._whole(text[run.start() : end])
            at = end
        return tokens + self._split(text[at:])


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a file of ranks, once per worker process."""
    return Encoder(path)


def encoded_length(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text (0 for null); strings of special tokens are ordinary text."""

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return lengths(text)


def length_histogram(df: DataFrame, length: Column | str) -> DataFrame:
    """``length, n_docs``: how many rows have each length (null counts as 0)."""
    length = F.col(length) if isinstance(length, str) else length
    return df.select(F.coalesce(length, F.lit(0)).cast("long").alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def context_table(histogram: DataFrame, width: int = 1024) -> DataFrame:
    """One row per distinct length L, read as a context limit.

    ``length, n_docs, n_tokens``: documents of exactly L tokens and their tokens; ``docs_over,
    tokens_over``: the same for longer ones; ``truncated_tokens``: tokens left if every document is
    cut to L; ``total_docs, total_tokens``: of all; ``share_within``: share of documents of at most
    L tokens.  A limit between two lengths is answered by :func:`at_limit`.

    Suffix sums are taken in two levels, so that no task gets the whole histogram: within ranges of
    ``width`` lengths, and over the ranges' totals (one row per range).
    """
    h = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / width).alias("range"))
    ranges = h.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    after = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.desc("range"))
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(everything).alias("total_docs"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    longer = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    over = h.select(
        "*",
        F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("d_in"),
        F.coalesce(F.sum("n_tokens").over(longer), F.lit(0)).alias("t_in"),
    ).join(ranges, "range")
    docs_over, tokens_over = F.col("d_in") + F.col("d_after"), F.col("t_in") + F.col("t_after")
    return over.select(
        "length",
        "n_docs",
        "n_tokens",
        docs_over.alias("docs_over"),
        tokens_over.alias("tokens_over"),
        (F.col("total_tokens") - tokens_over + docs_over * F.col("length")).alias("truncated_tokens"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - docs_over) / F.col("total_docs")).alias("share_within"),
    )


def at_limit(contexts: DataFrame, limit: int) -> DataFrame:
    """One row ``context_limit, docs_over, truncated_tokens``: what any limit leaves, exactly.

    The tokens of documents longer than the limit are counted as the limit each; the answer comes
    from the histogram, not from the documents.
    """
    over = F.col("length") > limit
    return contexts.agg(
        F.lit(limit).cast("long").alias("context_limit"),
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.when(over, F.col("n_docs") * limit).otherwise(F.col("n_tokens"))), F.lit(0)).alias("truncated_tokens"),
    )


def length_quantile(contexts: DataFrame, share: float) -> DataFrame:
    """One row ``length``: the smallest length that at least this share of documents stays within."""
    return contexts.where(F.col("share_within") >= share).agg(F.min("length").alias("length"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context table of all documents, under the byte-level vocabulary."""
    docs = table(spark, sf_dir, "documents")
    return context_table(written(length_histogram(docs, encoded_length("text")), "lengths"))
