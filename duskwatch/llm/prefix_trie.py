"""Prefix trie of conversations: burst tries over shards.

A conversation is a sequence of turns, a turn a record of 24 bytes: half of the SHA-256 of role and text,
then the text's code points; so sequences compare, sort and share prefixes as byte strings.

* Copies are counted first: sequences are grouped whole, with their number, smallest id and the hash of their ids.
  Ids are gathered in pieces of ``PIECE`` neighbouring numbers and hashed piece by piece in order, so that a
  sequence that a third of all conversations share needs memory for one piece.
* A container holds the distinct sequences under one trie head (a prefix), at first all under the root.  One
  of more than ``CONTAINER`` sequences is burst: its head moves to the longest prefix that all share and
  each next turn becomes the head of a container of its own.  Rounds go on until none is oversized, and each one
  reads only what the one before has burst.  After ``ROUNDS`` of them, as where each sequence is the one before and a
  turn more, what is left is swept as it is, with the same result.
* What remains is dealt to shards by head, sorted and swept: a stack of open nodes follows the sequences in
  order, so a task holds one path and the finished children along it, at most a container's nodes.
* The nodes of burst heads are summed from their containers' tops, last round first.

Every job starts from tables in the shared folder.  Defined cases: rows without a conv_id belong to no
conversation; null roles and texts are empty; null turn numbers come first; turns of equal number are ordered
by role and then by their records, and repeated rows are turns like others; conversations of any
length are read whole (their records, not their texts, are gathered by conversation); other columns are not
read; an empty table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import spread, table, written

CONTAINER = 4096
PIECE = 4096
ROUNDS = 24
RECORD = 24
#: Burst heads that may be broadcast; each is one row.
BROADCAST_HEADS = 100_000
#: In the order of a sweep's rows.
NODE = "above binary, top boolean, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_ARROW = pa.schema([(n, {"binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}[k]) for n, k in (c.split() for c in NODE.split(", "))])
NO_ENDS = hashlib.sha256(b"").hexdigest()


def record(role: Column | str, text: Column | str) -> Column:
    """A turn as 48 hex digits."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.upper(F.substring(F.sha2(named, 256), 1, 32)), F.lpad(F.hex(F.length(text).cast("long")), 16, "0"))


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: each conversation's records in order."""
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), record(role, text).alias("record")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).getField("record").alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """``conv_id, turns``: the first h turns of conversation c - c % 100, then c's own after its first h; h = crc32(c) % 6."""
    first = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("base_turns"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    own = convs.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h.alias("h"))
    taken = F.coalesce(F.slice("base_turns", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    return own.join(first, "base", "left").select("conv_id", F.concat(taken, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def sequences(convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """``seq, n, low, ends_sha256`` of each distinct sequence of ``conv_id, turns``.

    Ends are the SHA-256 of the ids of the conversations that are this sequence, in order, joined by commas.
    """
    keyed = convs.select(F.unhex(F.array_join("turns", "")).alias("seq"), "conv_id", F.expr(f"conv_id div {piece}").alias("piece"))
    pieces = keyed.groupBy("seq", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for seq, n, low, ids in zip(*[batch.column(c).to_pylist() for c in ("seq", "n", "low", "ids")]):
                if now is not None and seq == now[0]:
                    now[1] += n
                    now[3].update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append(now)
                now = [seq, n, low, hashlib.sha256(ids.encode())]
            yield made(done)
        if now is not None:
            yield made([now])

    def made(rows: list) -> pa.RecordBatch:
        columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3].hexdigest() for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["seq", "n", "low", "ends_sha256"])

    return pieces.repartition(spread(pieces), "seq").sortWithinPartitions("seq", "piece").mapInArrow(hashed, "seq binary, n long, low long, ends_sha256 string")


def _prefix(seq: Column | str, turns: Column) -> Column:
    """What names the head of ``turns`` records."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.unhex(F.sha2(F.substr(seq, F.lit(1), (turns * RECORD).cast("int")), 256))


def _shared(a: str, b: str) -> Column:
    """Number of records that two sequences begin with alike."""
    at = lambda c, k: F.substr(F.col(c), (k * RECORD + 1).cast("int"), F.lit(RECORD))
    n = (F.least(F.length(a), F.length(b)) / RECORD).cast("int")
    unlike = F.filter(F.sequence(F.lit(0), n), lambda k: (k == n) | (at(a, k) != at(b, k)))
    return F.element_at(unlike, 1)


def burst(seqs: DataFrame, container: int = CONTAINER, most_rounds: int = ROUNDS) -> tuple[DataFrame, list[DataFrame]]:
    """All sequences in their containers, and the heads that were burst, a table for each round.

    The first adds ``head, depth`` (turns of the head) and ``above`` (the head it was burst from, null for the root) to
    the sequences; where ``head`` is null, the sequence ends at the head ``above``.  The others are ``head, depth,
    above, shared`` (turns that all under the head begin with) ``, first`` (one of the sequences).
    """
    held = written(seqs.withColumns({"head": F.lit(hashlib.sha256(b"").digest()), "depth": F.lit(0), "above": F.lit(None).cast("binary")}), "sequences")
    settled, rounds = [], []
    while len(rounds) < most_rounds:
        sizes = held.groupBy("head").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > container)
        sizes = written(sizes, "burst-heads")
        number = sizes.count()
        if not number:
            break
        opened = held.join(_small(sizes.select("head"), number), "head")
        edges = opened.groupBy("head", "depth").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.any_value("above").alias("above"))
        big = written(edges.select("head", "depth", "above", "first", _shared("first", "last").alias("shared")), "burst-heads")
        rounds.append(big)
        settled.append(held.join(_small(big.select("head"), number), "head", "left_anti").select(*held.columns))
        goes_on = F.length("seq") > F.col("shared") * RECORD
        depth = F.col("shared") + F.when(goes_on, 1).otherwise(0)
        opened = held.drop("depth", "above").join(_small(big.select("head", "shared"), number), "head")
        moved = written(opened.select(*seqs.columns, F.when(goes_on, _prefix("seq", depth)).alias("head"), depth.alias("depth"), F.col("head").alias("above")), "containers")
        settled.append(moved.where("head is null"))
        held = moved.where("head is not null")
    return reduce(DataFrame.unionByName, settled, held), rounds


def _small(heads: DataFrame, number: int) -> DataFrame:
    return F.broadcast(heads) if number <= BROADCAST_HEADS else heads


class _Open:
    """A node whose last sequence has not been seen yet."""

    __slots__ = ("depth", "tokens", "low", "n", "children", "leaves", "saved", "ends", "rows")

    def __init__(self, depth: int, tokens: int):
        self.depth, self.tokens, self.low, self.n, self.children, self.leaves, self.saved, self.ends, self.rows = depth, tokens, None, 0, 0, 0, 0, NO_ENDS, []

    def close(self, out: list) -> tuple:
        """The node's row, without its parent; its children's rows, which waited for its id, go out."""
        out += [(*row, self.low) for row in self.rows]
        return (self.low, self.depth, self.n, self.children, max(1, self.leaves), self.saved + (self.n - 1) * self.tokens, self.ends)

    def take(self, row: tuple) -> None:
        """Add a finished child."""
        low, _, n, _, leaves, saved, _ = row
        self.low, self.n = low if self.low is None else min(self.low, low), self.n + n
        self.children, self.leaves, self.saved = self.children + 1, self.leaves + leaves, self.saved + saved
        self.rows.append(row)


class Sweep:
    """Nodes of one container, its sequences given in order.  Rows are ``(low, depth, n, children, leaves, saved, ends, parent's low)``."""

    def __init__(self, depth: int, first: bytes):
        self.last, self.out = b"", []
        self.path = [_Open(depth, self._tokens(first, depth))]

    @staticmethod
    def _tokens(seq: bytes, depth: int) -> int:
        return int.from_bytes(seq[depth * RECORD - 8 : depth * RECORD]) if depth else 0

    def add(self, seq: bytes, n: int, low: int, ends: str) -> None:
        top, turns = self.path[0].depth, len(seq) // RECORD
        alike, most = top, min(turns, len(self.last) // RECORD)
        while alike < most and seq[alike * RECORD : (alike + 1) * RECORD] == self.last[alike * RECORD : (alike + 1) * RECORD]:
            alike += 1
        self._close(alike)
        for depth in range(alike + 1, turns + 1):
            self.path.append(_Open(depth, self._tokens(seq, depth)))
        node = self.path[-1]  # sequences in order: one that ends here comes before those that go on
        node.n, node.low, node.ends = node.n + n, low if node.low is None else min(node.low, low), ends
        self.last = seq

    def _close(self, depth: int) -> None:
        while self.path[-1].depth > depth:
            row = self.path.pop().close(self.out)
            self.path[-1].take(row)

    def end(self) -> tuple:
        """Close all; the top's row."""
        self._close(self.path[0].depth)
        return self.path[0].close(self.out)


def sweep(containers: DataFrame) -> DataFrame:
    """Nodes (see NODE) of containers, dealt by head and sorted; a container's top node is marked and has no parent yet."""

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, above, now = None, None, None
        for batch in batches:
            rows = []
            for h, a, depth, seq, n, low, ends in zip(*[batch.column(c).to_pylist() for c in ("head", "above", "depth", "seq", "n", "low", "ends_sha256")]):
                if h != head:
                    rows += finished(above, now)
                    head, above, now = h, a, Sweep(depth, seq)
                now.add(seq, n, low, ends)
                rows += [(None, False, *r) for r in now.out]
                now.out.clear()
            yield made(rows)
        yield made(finished(above, now))

    def finished(above: bytes | None, now: Sweep | None) -> list:
        if now is None:
            return []
        top = now.end()
        return [*[(None, False, *r) for r in now.out], (above, True, *top, None)]

    def made(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return containers.repartition(spread(containers), "head").sortWithinPartitions("head", "seq").mapInArrow(swept, NODE)


def trie(convs: DataFrame, container: int = CONTAINER, piece: int = PIECE, most_rounds: int = ROUNDS) -> DataFrame:
    """Nodes of the trie over ``conv_id, turns`` (see :func:`turns_of`), one a row; see COLUMNS.

    ``conv_id`` is the smallest member's and names the node together with ``depth``.
    """
    held, rounds = burst(sequences(convs, piece), container, most_rounds)
    nodes = written(sweep(held.where("head is not null")), "trie-nodes")
    ended = held.where("head is null").select("above", F.col("low").alias("conv_id"), F.col("n").alias("n_convs"), F.lit(0).alias("children"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.col("ends_sha256").alias("ends"))
    tops, inner, linked = nodes.where("top"), nodes.where("not top").select(*COLUMNS), None
    for big in reversed(rounds):
        number = big.count()
        under = tops.select("above", "conv_id", "n_convs", F.lit(1).alias("children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends")).unionByName(ended)
        under = under.join(_small(big.select(F.col("head").alias("above")), number), "above", "left_semi")
        totals = under.groupBy("above").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).cast("long").alias(c) for c in ("n_convs", "children", "n_leaves", "saved_tokens")], F.max("ends").alias("ends"))
        heads = written(big.join(totals.withColumnRenamed("above", "_head"), F.col("head") == F.col("_head")).drop("_head"), "heads")
        path = _path(heads)
        inner = inner.unionByName(path.where("not top").select(*COLUMNS))
        known = _small(heads.select(F.col("head").alias("above"), F.col("conv_id").alias("_parent")), number)
        now = tops.join(known, "above").withColumn("parent_conv_id", F.col("_parent")).select(*COLUMNS)
        linked = now if linked is None else linked.unionByName(now)
        tops = tops.join(known, "above", "left_anti").unionByName(path.where("top").select("above", "top", *COLUMNS), allowMissingColumns=True)
    out = inner.unionByName(tops.select(*COLUMNS))
    return out if linked is None else out.unionByName(linked)


def _path(heads: DataFrame) -> DataFrame:
    """Nodes from each burst head down to where its containers part; all have the same members."""
    tokens = F.conv(F.hex(F.substr(F.col("first"), F.col("depth") * RECORD - 7, F.lit(8))), 16, 10).cast("long")
    steps = heads.withColumn("top_depth", F.col("depth")).withColumn("depth", F.explode(F.sequence("top_depth", "shared")))
    below = Window.partitionBy("head").orderBy(F.desc("depth"))
    last = F.col("depth") == F.col("shared")
    return steps.select(
        F.col("above"), (F.col("depth") == F.col("top_depth")).alias("top"), "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > F.col("top_depth"), F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.sum(F.when(F.col("depth") > 0, tokens).otherwise(0)).over(below)).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::BIGINT[]), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295::BIGINT)"
#: The same by brute force: every prefix of every conversation, and every node with all nodes above it.
SQL = f"""
WITH c AS (SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
k AS (SELECT conv_id, t, CAST({_CRC} % 6 AS INT) AS h FROM c),
r AS (SELECT k.conv_id, list_concat(coalesce(list_slice(b.t, 1, h), []), list_slice(k.t, h + 1, len(k.t))) AS t FROM k LEFT JOIN c b ON b.conv_id = k.conv_id - k.conv_id % 100),
m AS (SELECT conv_id, len(t) AS n, unnest(range(0, len(t) + 1)) AS d, t FROM r),
node AS (SELECT d, list_slice(t, 1, d) AS p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM m GROUP BY ALL),
kid AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
x AS (SELECT node.*, coalesce(kid.n, 0) AS n_children FROM node LEFT JOIN kid USING (p)),
up AS (SELECT unnest(range(0, d + 1)) AS a, p, n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(p[d][2]) ELSE 0 END AS saved FROM x),
s AS (SELECT list_slice(p, 1, a) AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved_tokens, x.ends AS ends_sha256
FROM x JOIN s USING (p) LEFT JOIN x y ON y.p = list_slice(x.p, 1, x.d - 1) AND x.d > 0
"""
