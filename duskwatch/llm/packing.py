"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the largest permitted length.  Pieces are dealt by hash to
shards of a bounded expected size, and every shard is packed on its own: longest piece first, each
into the open bin that it fills best.  If none has room, a new bin opens.  Its size is chosen for all
permitted lengths jointly from the histogram of what is left to place: for each size the bin is filled
on trial from the histogram (longest piece that fits, again and again) and shrunk to its contents, and
the size of least cost per token opens.  In the end each bin shrinks to the shortest permitted length
that holds its contents.  A shard is also packed with each permitted length preferred throughout, and
the plan of least total cost is kept, so several lengths never cost more than one of them.

The number of shards follows the number of pieces, so no task grows with the table, and the result depends on
the rows alone, not on how the table is cut into files: a lost task is packed again to the same result.
Ties: equal lengths go in the order of id, document length, copy and piece, equal rooms to the bin opened first,
equal costs to the smaller size.

Defined cases: texts of any length are encoded whole and cut into pieces; null, zero and negative
lengths are documents without tokens and get a row without bin; null and repeated ids are packed like
others, each row as a document; rows of equal id and length are alike, so they are counted and numbered, which
spreads them over the shards; other columns are not read; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm.common import spread, table, written
from duskwatch.llm.token_counts import VOCABULARY, encoded_length

CAPACITIES = (1024, 2048, 4096, 8192)


def bin_cost(capacity: int, per_bin: float = 64.0, quadratic: float = 1 / 65536) -> float:
    """Cost of a sequence: its tokens, a share for attention, and a fixed part."""
    return per_bin + capacity * (1.0 + quadratic * capacity)


class _Left:
    """The histogram of lengths that are still to be placed."""

    def __init__(self, lengths: Sequence[int]):
        self.count = Counter(lengths)
        self.kinds = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.count[n], self.kinds[bisect_left(self.kinds, n)]

    def filled(self, room: int) -> int:
        """Tokens that a bin with so much room would get, longest piece first."""
        start, at = room, bisect_right(self.kinds, room) - 1
        while at >= 0:
            n = self.kinds[at]
            room -= min(room // n, self.count[n]) * n
            at = bisect_right(self.kinds, room, 0, at) - 1
        return start - room


def _plan(lengths: Sequence[int], order: Sequence[int], sizes: Sequence[int], prefer: int | None, cost: Callable[[int], float]) -> tuple[float, list[tuple[int, int, int]], list[int]]:
    """Total cost, ``(bin, offset, capacity)`` of each length, and the sizes as opened."""
    left = _Left(lengths)
    rooms: list[int] = []  # distinct free lengths, ascending
    free: dict[int, list[int]] = {}  # free length -> bins, the first opened last
    used: list[int] = []
    opened: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)

    def price(n: int, c: int) -> tuple[float, int]:
        got = n + left.filled(c - n)
        return cost(sizes[bisect_left(sizes, got)]) / got, c

    for i in order:
        n = lengths[i]
        left.take(n)
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = free[room].pop()
            if not free[room]:
                del free[room], rooms[at]
        else:
            fits = sizes[bisect_left(sizes, n if prefer is None else max(n, prefer)) :]
            b, room = len(used), fits[0] if prefer else min(fits, key=lambda c: price(n, c))
            used.append(0)
            opened.append(room)
        out[i] = (b, used[b])
        used[b] += n
        if rest := room - n:
            if rest not in free:
                free[rest] = []
                insort(rooms, rest)
            insort(free[rest], b, key=lambda x: -x)
    final = [sizes[bisect_left(sizes, u)] for u in used]
    return sum(map(cost, final)), [(b, offset, final[b]) for b, offset in out], opened


def pack_lengths(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = bin_cost) -> list[tuple[int, int, int]]:
    """``(bin, offset, capacity)`` for each length; equal lengths are placed in the order given.

    Every length must be between 1 and the largest capacity.
    """
    sizes = sorted(set(capacities))
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    return min((_plan(lengths, order, sizes, prefer, cost)[:2] for prefer in (None, *sizes)), key=lambda plan: plan[0])[1]


def best_fit_pack(df: DataFrame, doc_id: str, length: str, capacities: Sequence[int] = CAPACITIES, shard_pieces: int = 4096, cost: Callable[[int], float] = bin_cost) -> DataFrame:
    """Pack documents of given lengths; one row per piece.

    Returns ``doc_id, piece, start, length, bin_id, capacity, bin_offset``: piece number from 0,
    its first token within the document and its length, its bin, the bin's final length and the
    place within it.  A document without tokens is one row of length 0 without bin (bin_id, capacity
    and bin_offset null).  Ids and lengths are written once, since packing reads them twice.
    """
    top = max(capacities)
    lengths = df.select(F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    counted = written(lengths.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("copies")), "lengths")
    docs = _copies(counted)
    cut = docs.where("n > 0").select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {top} as int)"))).alias("piece"))
    pieces = cut.select("doc_id", "n", "row", "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece").cast("long") * top).alias("length"))
    total = counted.agg(F.sum(F.expr(f"copies * ((n + {top - 1}) div {top})")).alias("pieces")).first()["pieces"] or 0
    shards = max(1, -(-total // shard_pieces))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "row", "piece"), F.lit(shards)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "n", "row", "piece"], ascending=[False, True, True, True, True], kind="stable")
        packed = pack_lengths(pdf["length"].tolist(), capacities, cost)
        bins, offsets, sizes = zip(*packed)
        base = pdf["shard"].to_numpy() << 32
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "piece": pdf["piece"].to_numpy(), "start": pdf["start"].to_numpy(), "length": pdf["length"].to_numpy(), "bin_id": base + pd.Series(bins).to_numpy(), "capacity": sizes, "bin_offset": offsets})

    kind = df.schema[doc_id].dataType.simpleString()
    packed = pieces.groupBy("shard").applyInPandas(_nullable_ids(pack, kind), f"doc_id {kind}, piece int, start long, length long, bin_id long, capacity long, bin_offset long")
    none = F.lit(None).cast("long")
    return packed.unionByName(docs.where("n = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), none.alias("bin_id"), none.alias("capacity"), none.alias("bin_offset")))


def _copies(counted: DataFrame, block: int = 4096) -> DataFrame:
    """``doc_id, n, row``: each row of ``doc_id, n, copies`` as often as it says, numbered; many copies by several tasks."""
    few, many = counted.where(F.col("copies") <= block), counted.where(F.col("copies") > block)
    blocks = many.select("doc_id", "n", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {block}"))).alias("b"))
    blocks = blocks.repartition(spread(counted), "doc_id", "n", "b")
    parts = blocks.select("doc_id", "n", F.explode(F.sequence(F.col("b") * block, F.least(F.col("copies"), (F.col("b") + 1) * block) - 1)).alias("row"))
    return few.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("row")).unionByName(parts)


def _nullable_ids(pack, kind: str):
    """pandas reads a nullable integer column as floats; take ids as nullable integers instead."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if kind in ("bigint", "int", "smallint", "tinyint"):
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        out = pack(pdf)
        if kind in ("bigint", "int", "smallint", "tinyint"):
            out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
        return out

    return run


def token_lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens``: encoded length of each whole text with one end mark (empty: 0)."""
    n = encoded_length(text, vocabulary)
    lengths = docs.select(F.col(doc_id).alias("doc_id"), n.alias("n"))
    return lengths.select("doc_id", F.when(F.col("n") > 0, F.col("n") + 1).otherwise(0).cast("long").alias("n_tokens"))


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents packed by encoded length; see :func:`best_fit_pack`."""
    return best_fit_pack(token_lengths(docs, doc_id, text), "doc_id", "n_tokens", **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed by their encoded lengths."""
    return pack_documents(table(spark, sf_dir, "documents"))
