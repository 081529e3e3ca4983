"""Document fingerprints: canonical exact digests and groups of equal documents.

A text is made canonical (Unicode NFKC, case folding, white space runs to one blank, ends trimmed)
and its UTF-8 bytes get a 128-bit xxhash digest.  Rows are grouped by digest; only inside digests
that occur more than once are the canonical bytes themselves compared, by grouping on them, so a
collision of digests cannot join two different documents.  (Rows then find their group by digest and
SHA-256 of the bytes, so that the bytes are shuffled once.)

The operator also compares each document with its successor by id and with an edited text made of
both.  For that, rows are dealt to ranges of (id, beginning of the text), whose bounds come from a
bounded sample; the first document of each range is sent to the range before as well, so no task and no
driver ever sees more than one range, and there is no global sort in one place.  Ids with very many rows
are spread over ranges by their texts, and equal rows of such an id are one row with a count until the
end.  Digests of very many rows are broadcast (at most ``4 * partitions`` are so frequent), others joined.

Defined cases: a null text is empty; a null id sorts before all others; rows of equal ids are
ordered by text (null first); after the last row comes the first, which for a table of one row is
itself; very long texts are read whole; other columns are not read; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.llm.common import spread, table, written

_LOWEST = -(2**63)
#: Rows sampled for each range, characters of a text that order an id's rows, least rows of a crowded
#: id or a frequent digest, and rows made at once of a count.
_SAMPLE, _HEAD, _OFTEN, _PIECE = 50, 64, 1000, 1 << 16


def canonical(text: str) -> str:
    """NFKC, case folded, NFKC again (folding can leave other forms), white space folded."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


@F.pandas_udf(T.StringType())
def canonical_digest(texts: pd.Series) -> pd.Series:
    """Hex digest of the canonical text; null counts as empty."""
    return pd.Series([digest(canonical(t or "").encode()) for t in texts], dtype=object)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def likeness(a: bytes, b: bytes, digest_a: str, digest_b: str) -> float:
    """1.0 if digests and then bytes are equal, else 0.0: exact digests know no degrees."""
    return float(digest_a == digest_b and a == b)


class Ranges:
    """Ranges of (key, beginning of the text), at most ``n``, and which of them a row goes to.

    Only the bounds and the first (key, beginning) of each range are held.
    """

    def __init__(self, rows: DataFrame, n: int, total: int):
        sample = rows.select("key", "head").sample(min(1.0, _SAMPLE * n / max(total, 1)), seed=7).collect() if n > 1 else []
        points = sorted((r["key"], r["head"]) for r in sample)
        self.bounds = bounds = sorted({points[len(points) * i // n] for i in range(1, n)}) if points else []

        @F.pandas_udf("int")
        def own(keys: pd.Series, heads: pd.Series) -> pd.Series:
            return pd.Series([bisect_right(bounds, point) for point in zip(keys, heads)], dtype="int32")

        firsts = sorted((r["b"], (r["first"]["key"], r["first"]["head"])) for r in rows.groupBy(own("key", "head").alias("b")).agg(F.min(F.struct("key", "head")).alias("first")).collect())
        before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

        @F.pandas_udf("array<struct<bucket:int,copy:int>>")
        def deal(keys: pd.Series, heads: pd.Series) -> pd.Series:
            out = []
            for point in zip(keys, heads):
                to = [{"bucket": bisect_right(bounds, point), "copy": 0}]
                if point in before:
                    to.append({"bucket": before[point], "copy": 1})
                out.append(to)
            return pd.Series(out)

        @F.pandas_udf("array<int>")
        def spanned(keys: pd.Series) -> pd.Series:
            return pd.Series([list(range(bisect_left(bounds, (k, "")), bisect_right(bounds, (k, chr(0x10FFFF))) + 1)) for k in keys])

        #: The row's own range and, for the first rows of a range, the one before it (copy 1); all ranges of a key.
        self.deal, self.spanned = deal, spanned


_WALKED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, canon binary, times bigint"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Finish each row when the next one of its range has come; equal rows follow each other."""
    last = None
    flagged = None

    def done(row, text, canon, fp, times):
        _, key, null, own, own_canon, own_fp, keep = row
        new = edited(own, text)
        new_canon = canonical(new).encode()
        new_fp = digest(new_canon)
        return (None if null else key, len(own), hashlib.sha256(new.encode()).hexdigest(), own_fp, new_fp, likeness(own_canon, new_canon, own_fp, new_fp), likeness(own_canon, canon, own_fp, fp), own_canon if keep else None, times)

    for pdf in batches:
        out = []
        for bucket, copy, kind, key, null_id, text, times in zip(pdf["bucket"], pdf["copy"], pdf["kind"], pdf["key"], pdf["null_id"], pdf["text"], pdf["times"]):
            if kind == 0:
                flagged = (bucket, key)
                continue
            if copy and (last is None or last[0] != bucket):
                continue
            text = text or ""
            canon = canonical(text).encode()
            fp = digest(canon)
            if last is not None and last[0] == bucket:
                out.append(done(last, text, canon, fp, 1))
            last = None if copy else (bucket, key, null_id, text, canon, fp, flagged == (bucket, key))
            if not copy and times > 1:
                out.append(done(last, text, canon, fp, times - 1))
        pdf = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "canon", "times"])
        yield pdf.astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": "float64", "near_next": "float64", "times": "int64"})


def _expanded(rows: DataFrame, n: int) -> DataFrame:
    """As many rows as ``times`` says, made in bounded pieces."""
    pieces = rows.where("times > 1").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(times - 1) div {_PIECE}")))).repartition(n, "doc_id", "piece")
    pieces = pieces.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(_PIECE).cast("bigint"), F.col("times") - F.col("piece") * _PIECE)))).drop("k", "piece")
    return rows.where("times = 1").unionByName(pieces).drop("times")


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``:
    see the module; ``group_id``: smallest id among documents of the same canonical bytes (null ids
    last), ``group_size``: how many there are.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("key"), F.col("doc_id").isNull().alias("null_id"), "text")
    n = spread(docs)
    digests = written(rows.select("key", canonical_digest("text").alias("fp")), "digests")
    total = digests.count()
    often = max(_OFTEN, total // (4 * n))

    crowded = digests.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > often).select("key")
    one, no_head = F.lit(1).cast("bigint").alias("times"), F.lit("").alias("head")
    if crowded.isEmpty():
        counted = rows.select("*", one, no_head)
    else:
        crowded = F.broadcast(written(crowded, "crowded"))
        many = rows.join(crowded, "key", "left_semi").groupBy("key", "null_id", "text").agg(F.count(F.lit(1)).alias("times"))
        many = written(many.withColumn("head", F.coalesce(F.substring("text", 1, _HEAD), F.lit(""))), "crowd")
        counted = rows.join(crowded, "key", "left_anti").select("*", one, no_head).unionByName(many)
    ranges = Ranges(counted.select("key", "head"), n, total)

    repeated = written(digests.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "repeated")
    frequent = F.broadcast(repeated.where(F.col("c") > often).select("fp"))
    flags = digests.join(frequent, "fp", "left_semi").unionByName(digests.join(frequent, "fp", "left_anti").join(repeated.select("fp"), "fp", "left_semi"))
    marks = flags.select("key").distinct().select(F.explode(ranges.spanned("key")).alias("bucket"), F.lit(0).alias("copy"), F.lit(0).alias("kind"), "key", F.lit(False).alias("null_id"), F.lit(None).cast("string").alias("text"), F.lit(1).cast("bigint").alias("times"))
    dealt = counted.withColumn("to", F.explode(ranges.deal("key", "head"))).select("to.bucket", "to.copy", F.lit(1).alias("kind"), "key", "null_id", "text", "times")
    walked = dealt.unionByName(marks).repartition(n, "bucket").sortWithinPartitions("bucket", "copy", "key", "kind", F.desc("null_id"), "text").mapInPandas(_walk, _WALKED)
    walked = written(walked, "fingerprints")

    check = F.sha2("canon", 256).alias("check")
    groups = walked.where("canon is not null").groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"), F.sum("times").alias("group_size"))
    groups = groups.select("fingerprint", check, "group_id", "group_size")
    single = walked.where("canon is null").drop("canon").select("*", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"))
    several = walked.where("canon is not null").withColumn("check", check).drop("canon").join(groups, ["fingerprint", "check"]).select(*single.columns)
    return _expanded(single.unionByName(several), n)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
