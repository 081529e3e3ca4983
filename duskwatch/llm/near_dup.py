"""MinHash near-duplicates by an inverted join on signature coordinates.

1. Every whole text becomes the set of its distinct five-word shingles and a signature of
   ``coordinates`` minima.  Documents of equal sets form a class, known by its smallest id; from
   here on only classes are compared, so copies cost nothing.
2. Each (coordinate, value) pair of a signature is a token.  Two signatures must agree in at least
   ``matches`` coordinates, so it is enough that they share one of the ``coordinates - matches + 1``
   tokens that are rarest over the corpus: only this prefix is posted, and tokens that occur once
   are skipped.  The frequent tokens' long lists are never merged; what they would add to a count
   of collisions is read off the two signatures.
3. The smallest class of each posting list is its pivot.  Every member is held against its pivots
   (collisions, then the full sets), and confirmed links are contracted to components.  That is
   linear in the postings and settles almost every list.
4. Lists that still hold several components are settled exactly.  The classes of a list are a group.
   In a group of over ``block`` classes, say of a million pages of one template, the classes are first
   listed anew by their rarest shingles: two sets that are near enough share one of the first
   ``n - ceil(percent * n) + 1`` shingles of either, in the order of their frequency, so pages that only
   share the template are never compared.  A group is then cut into blocks of bounded size, and a task
   gets two blocks, counts the shingles that each pair shares by a matrix product and returns at most one
   link per component.  Pairs already known to be connected (both in the pivot's component) are skipped.
   Pairs are never rows of a table.

Links need 100 * |A n B| >= percent * |A u B| on the full sets of 64-bit shingle hashes: 85 in the
query, 80 in the pipeline.  A pair at exactly that limit is missed only if fewer than ``matches`` of
its coordinates agree.  ``matches`` follows from the limit, so that at most 1 in 32,000 such pairs is
missed, and far fewer above the limit: of 48 it is 30 at 85 (3 in 100,000) and 26 at 80 (1 in 100,000).
With ``exact`` all classes are listed by their rarest shingles instead of coordinates, and none is missed.

Defined cases: a null text is empty; texts without words have no shingles, link with nothing and
are kept; rows of one id are one document, linked by any of their texts; rows with a null id are linked
like others but never represent a group: component_id is the smallest id of the component, null if it has
none, and then ``kept`` is true for all its rows, which cannot be told apart (drop_near_duplicates keeps
one of them); where ids reach 2^62, rows with a null id are compared by exact set only; texts of any length
are read whole, one such text at a time; of equally rare coordinates or shingles the smaller number is posted, which
changes no result; other columns are not read; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.llm.common import fresh, spread, table, written
from duskwatch.llm.components import components
from duskwatch.llm.shingles import minhash, mix, shingle_hashes

COORDINATES, MISSED = 48, 1 / 32_000
BLOCK = 512
_LONG_LIST = 1000
_CHUNK_BYTES = 2_000_000


def _chunks(batch: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about _CHUNK_BYTES of text (column ``text``); a longer text is alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    group = np.cumsum(sizes) // _CHUNK_BYTES
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(sizes) else []
    for a, b in zip(cuts, [*cuts[1:], len(sizes)]):
        yield batch.slice(a, b - a)


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[off[1:]] - total[off[:-1]]


def _fingerprints(grams: np.ndarray, off: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two hashes of each set."""
    fp1, fp2 = (pa.array(_sums(mix(grams ^ np.uint64(k)), off).view(np.int64)) for k in (0x51, 0xA7))
    return fp1, fp2


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id, n, fp1, fp2, signature``: set size, two hashes of the whole set, minima."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                grams, off = shingle_hashes(part.column(1), size)
                sig = minhash(grams, off, coordinates).view(np.int32).ravel()
                ends = np.arange(len(part) + 1, dtype=np.int32) * coordinates
                fp1, fp2 = _fingerprints(grams, off)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(np.diff(off).astype(np.int64)), fp1, fp2, pa.ListArray.from_arrays(pa.array(ends), pa.array(sig))],
                    ["doc_id", "n", "fp1", "fp2", "signature"],
                )

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(sign, "doc_id bigint, n bigint, fp1 bigint, fp2 bigint, signature array<int>")


def _shingled(texts: DataFrame, size: int) -> DataFrame:
    """``cls, n, fp1, fp2, grams`` of rows ``cls, text``."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                grams, off = shingle_hashes(part.column(1), size)
                fp1, fp2 = _fingerprints(grams, off)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(np.diff(off).astype(np.int64)), fp1, fp2, pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(grams.view(np.int64)))],
                    ["cls", "n", "fp1", "fp2", "grams"],
                )

    return texts.mapInArrow(shingle, "cls bigint, n bigint, fp1 bigint, fp2 bigint, grams array<bigint>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, nameless: DataFrame | None, doc_id: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """``cls, n, grams``: the full shingle sets of the wanted classes.

    A class is known by one of its documents' ids; ``nameless`` (``cls, n, fp1, fp2``) has those without ids.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("cls"), F.col(text).cast("string").alias("text"))
    found = _shingled(rows.join(wanted.hint("merge"), "cls", "left_semi"), size).select("cls", "n", "grams")
    if nameless is None:
        return found
    rest = _shingled(rows.where("cls is null"), size).drop("cls").join(nameless.join(wanted, "cls", "left_semi"), ["n", "fp1", "fp2"])
    return found.unionByName(rest.select("cls", "n", "grams").dropDuplicates(["cls"]))


def matches_for(percent: int, coordinates: int = COORDINATES) -> int:
    """The most coordinates to ask for, so that a pair at the limit has fewer with a chance of at most MISSED."""
    p, below = percent / 100, 0.0
    for k in range(coordinates):
        below += comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > MISSED:
            return k
    return coordinates


def postings(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """``token, cls``: each class under its rarest tokens, without those that occur once."""
    prefix = coordinates - matches + 1
    tokens = classes.select("cls", "fp1", F.posexplode("signature").alias("at", "value"))
    tokens = tokens.select("cls", "fp1", F.shiftleft(F.col("at").cast("bigint"), 32).bitwiseOR(F.col("value").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
    frequent = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = tokens.join(frequent, "token").groupBy("cls", "fp1").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("ts"))
    room = F.size("ts") - F.lit(coordinates - prefix)
    return shared.where(room > 0).select("cls", F.explode(F.slice("ts", F.lit(1), room)).alias("t")).select("t.token", "cls").distinct()


def rare_postings(sets: DataFrame, percent: int) -> DataFrame:
    """``token, cls``: each class under its rarest shingles, of which every set near enough shares one.

    Sets that are near have at least ceil(percent * n / 100) of a set's n shingles.  Shingles of one set
    only are skipped, and of lists with the same classes one is posted.
    """
    tokens = sets.select("cls", "n", F.xxhash64("grams").alias("own"), F.explode("grams").alias("token"))
    frequent = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = tokens.join(frequent, "token").groupBy("cls", "own", "n").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("ts"))
    room = F.size("ts") - F.expr(f"cast(({percent} * n + 99) div 100 as int)") + 1
    posted = shared.where(room > 0).select("cls", F.explode(F.slice("ts", F.lit(1), room)).alias("t")).select("t.token", "cls").distinct()
    posted = written(posted, "rare")
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("cls")).alias("h1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("h2")).where("c > 1")
    one = lists.groupBy("c", "h1", "h2").agg(F.min("token").alias("token")).select("token")
    return written(posted.join(one, "token"), "rare")


def shared_counts(rows: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of sorted sets has in common."""
    out = np.zeros((len(rows), len(rows)), np.int64)
    lengths = [len(r) for r in rows]
    flat = np.concatenate(rows)
    values, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), lengths)
    often = np.flatnonzero(n > 1)
    place = np.full(len(values), -1)
    place[often] = np.arange(len(often))
    keep = place[column] >= 0
    row, column = row[keep], place[column][keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for start in range(0, len(often), width):
        a, b = np.searchsorted(column, (start, start + width))
        m = np.zeros((len(rows), min(width, len(often) - start)), np.float32)
        m[row[a:b], column[a:b] - start] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def linked_labels(labels: np.ndarray, rows: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(label, smaller label) for labels joined by links between rows; at most one per label."""
    n = np.array([len(r) for r in rows], np.int64)
    common = shared_counts(rows)
    near = 100 * common >= percent * (n[:, None] + n[None, :] - common)  # in 64-bit whole numbers
    near &= labels[:, None] != labels[None, :]
    names, own = np.unique(labels, return_inverse=True)
    a, b = np.nonzero(near)
    a, b = own[a], own[b]
    best = np.arange(len(names))
    while True:
        new = best.copy()
        np.minimum.at(new, a, best[b])
        new = new[new]
        if (new == best).all():
            break
        best = new
    return [(int(names[i]), int(names[j])) for i, j in enumerate(best) if i != j]


def _settle(percent: int):
    def run(part: pa.Table) -> pa.Table:
        pivots, labels = part["p"].to_numpy(), part["label"].to_numpy()
        grams = part["grams"].combine_chunks()
        values, off = grams.values.to_numpy(), grams.offsets.to_numpy()
        order = np.argsort(pivots, kind="stable")
        cuts = np.flatnonzero(np.r_[True, pivots[order][1:] != pivots[order][:-1], True])
        found: set[tuple[int, int]] = set()
        for x, y in zip(cuts[:-1], cuts[1:]):
            at = order[x:y]
            found.update(linked_labels(labels[at], [values[off[i] : off[i + 1]] for i in at], percent))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _tasks(groups: DataFrame, members: DataFrame, block: int, bundles: int) -> DataFrame:
    """``kind, i, j, k, p, cls, label``: the members of each unsettled group, once per task.

    A group of at most ``block`` members is one task, and such groups are bundled by hash.  In a
    larger one the members of the pivot's component form blocks 0.., the others form blocks of
    their own; a task takes one block of others and one block of either kind.
    """
    h = F.xxhash64("cls")
    m = members.join(groups, "p")
    small = m.where(F.col("same") + F.col("other") <= block).select(F.lit("bundle").alias("kind"), F.pmod(F.xxhash64("p"), F.lit(bundles)).alias("i"), F.lit(0).cast("bigint").alias("j"), F.lit(0).cast("bigint").alias("k"), "p", "cls", "label")
    half = block // 2
    large = m.where(F.col("same") + F.col("other") > block)
    large = large.withColumn("na", F.ceil(F.col("same") / half).cast("bigint")).withColumn("nb", F.ceil(F.col("other") / half).cast("bigint"))
    own = large.where("is_same").withColumn("x", F.pmod(h, F.col("na"))).select("p", "cls", "label", "x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)).alias("y"))
    own = own.select(F.lit("own").alias("kind"), F.col("p").alias("i"), F.col("x").alias("j"), F.col("y").alias("k"), "p", "cls", "label")
    rest = large.where(~F.col("is_same")).withColumn("x", F.pmod(h, F.col("nb")))
    rest_own = rest.select("p", "cls", "label", "x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("na") - 1)).alias("y"))
    rest_own = rest_own.select(F.lit("own").alias("kind"), F.col("p").alias("i"), F.col("y").alias("j"), F.col("x").alias("k"), "p", "cls", "label")
    pairs = rest.where("nb > 1").select("p", "cls", "label", "x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)).alias("y"))
    pairs = pairs.where("x <> y").select(F.lit("rest").alias("kind"), F.col("p").alias("i"), F.least("x", "y").alias("j"), F.greatest("x", "y").alias("k"), "p", "cls", "label")
    single = rest.where("nb = 1").select(F.lit("rest").alias("kind"), F.col("p").alias("i"), F.lit(0).cast("bigint").alias("j"), F.lit(0).cast("bigint").alias("k"), "p", "cls", "label")
    return small.unionByName(own).unionByName(rest_own).unionByName(pairs).unionByName(single)


def _grouped(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``p, cls, label, pivot_label`` marked by whether they are connected with the pivot, and the groups with others."""
    members = written(members.select("p", "cls", "label", (F.col("label") == F.col("pivot_label")).alias("is_same")), "members")
    groups = members.groupBy("p").agg(F.count_if("is_same").alias("same"), F.count_if(~F.col("is_same")).alias("other")).where("other > 0")
    return members, written(groups, "groups")


def _sized(groups: DataFrame, members: DataFrame, block: int) -> DataFrame:
    small = groups.where(F.col("same") + F.col("other") <= block).agg(F.sum(F.col("same") + F.col("other"))).first()[0] or 0
    return _tasks(groups, members, block, max(1, small // (2 * block)))


def _components(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, coordinates: int, matches: int | None, block: int, exact: bool) -> tuple[DataFrame, DataFrame, bool]:
    """The signed rows, ``n, fp1, fp2, root, component`` of each class, and whether rows with words lack an id."""
    matches = matches_for(percent, coordinates) if matches is None else matches
    signed = written(signatures(docs, doc_id, text, size, coordinates), "signatures")
    classes = written(signed.where("n > 0").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("cls"), F.first("signature").alias("signature"), F.count_if(F.col("doc_id").isNull()).alias("without")), "classes")
    ids = classes.agg(F.max("cls").alias("top"), F.count_if(F.col("cls").isNull()).alias("nameless"), F.coalesce(F.sum("without"), F.lit(0)).alias("without")).first()
    top, nameless = ids["top"] or 0, None
    if ids["nameless"] and top < 1 << 62:
        # Classes without ids get numbers above all ids, so that any id of a component is smaller.
        classes = written(classes.withColumn("cls", F.coalesce("cls", F.lit(top + 1) + F.monotonically_increasing_id())), "classes")
        nameless = classes.where(F.col("cls") > top).select("cls", "n", "fp1", "fp2")
    alone = classes.where("cls is null").select("n", "fp1", "fp2", F.lit(None).cast("bigint").alias("root"))
    classes = classes.where("cls is not null")

    if exact:
        sets = written(shingle_sets(docs, classes.select("cls").distinct(), nameless, doc_id, text, size), "sets")
        posted = rare_postings(sets, percent)
    else:
        posted = written(postings(classes, coordinates, matches), "postings")
    pivots = written(posted.groupBy("token").agg(F.min("cls").alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1"), "pivots")
    # Lists that hold a large share of all postings are at most 4 * partitions, so their pivots are broadcast.
    long = max(_LONG_LIST, posted.count() // (4 * spread(docs)))
    longest = F.broadcast(pivots.where(F.col("c") > long).select("token", "p"))
    star = posted.join(longest, "token").unionByName(posted.join(longest.select("token"), "token", "left_anti").join(pivots.where(F.col("c") <= long).select("token", "p"), "token").select("token", "cls", "p"))
    star = written(star.where("cls <> p").select("p", "cls").distinct(), "stars")
    if not exact:
        sets = written(shingle_sets(docs, star.select("cls").unionByName(star.select(F.col("p").alias("cls"))).distinct(), nameless, doc_id, text, size), "sets")

    sigs = classes.select("cls", "n", "signature")
    side = sigs.select(F.col("cls").alias("p"), F.col("n").alias("pn"), F.col("signature").alias("ps"))
    collisions = F.size(F.filter(F.zip_with("signature", "ps", lambda x, y: x == y), lambda same: same))
    enough = F.lit(True) if exact else collisions >= matches
    likely = star.join(sigs, "cls").join(side, "p").where((100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")) & enough).select("p", "cls").distinct()
    common = F.size(F.array_intersect("grams", "pg"))
    held = likely.join(sets, "cls").join(sets.select(F.col("cls").alias("p"), F.col("n").alias("pn"), F.col("grams").alias("pg")), "p").withColumn("common", common)
    links = held.where(100 * F.col("common") >= percent * (F.col("n") + F.col("pn") - F.col("common"))).select(F.col("p").alias("a"), F.col("cls").alias("b"))
    first = components(links)

    members = star.unionByName(star.select("p", F.col("p").alias("cls")).distinct())
    members = members.join(first.withColumnRenamed("node", "cls"), "cls", "left").select("p", "cls", F.coalesce("label", "cls").alias("label"))
    members, groups = _grouped(members.join(members.where("p = cls").select("p", F.col("label").alias("pivot_label")), "p"))
    large = groups.where(F.col("same") + F.col("other") > block).select("p")
    if large.isEmpty():
        tasks = _sized(groups, members, block)
    else:
        left = written(members.join(large, "p").select("cls", "label").distinct(), "unsettled")
        again = rare_postings(sets.join(left, "cls", "left_semi"), percent).withColumnRenamed("token", "p").join(left, "cls")
        again = again.join(again.groupBy("p").agg(F.min("label").alias("pivot_label")), "p")
        tasks = _sized(groups.join(large, "p", "left_anti"), members, block)
        tasks = tasks.unionByName(_sized(*reversed(_grouped(again)), block).withColumn("kind", F.concat(F.lit("rare "), "kind")))
    more = tasks.join(sets.select("cls", "grams"), "cls").groupBy("kind", "i", "j", "k").applyInArrow(_settle(percent), "a bigint, b bigint")
    second = components(more)

    final = classes.select("n", "fp1", "fp2", "cls").join(first.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    final = final.join(second.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("n", "fp1", "fp2", F.coalesce("to", "label").alias("root"))
    final = final.unionByName(alone)
    component = F.col("root") if nameless is None else F.when(F.col("root") <= top, F.col("root"))
    return signed, final.withColumn("component", component), ids["without"] > 0


def _decided(signed: DataFrame, final: DataFrame) -> DataFrame:
    out = signed.select("doc_id", "n", "fp1", "fp2").join(final, ["n", "fp1", "fp2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85, coordinates: int = COORDINATES, matches: int | None = None, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; see the module."""
    signed, final, _ = _components(docs, doc_id, text, size, percent, coordinates, matches, block, exact)
    return _decided(signed, final)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85, coordinates: int = COORDINATES, matches: int | None = None, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """The documents that stay: of each component, the one with the smallest id; of a component without ids, one."""
    signed, final, without = _components(docs, doc_id, text, size, percent, coordinates, matches, block, exact)
    gone = _decided(signed, final).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    named = docs.join(gone, docs[doc_id].cast("bigint") == gone["gone_id"], "left_anti")
    if not without:
        return named
    n, fp1, fp2, *keys = fresh(docs.columns, "set_n", "set_fp1", "set_fp2", "class_n", "class_fp1", "class_fp2", "class_root", "class_component")
    at, kinds = docs.columns.index(text), T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in (n, fp1, fp2)]])

    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, at):
                grams, off = shingle_hashes(part.column(at).cast(pa.string()), size)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(off).astype(np.int64)), *_fingerprints(grams, off)], kinds.names)

    nulls = docs.where(F.col(doc_id).cast("bigint").isNull()).mapInArrow(fingerprinted, kinds)
    cls = final.toDF(*keys)
    nulls = nulls.join(cls, (nulls[n] == cls[keys[0]]) & (nulls[fp1] == cls[keys[1]]) & (nulls[fp2] == cls[keys[2]]), "left")
    # One row of a component: its root tells which, or its set where there is none.
    sets = {c: F.when(F.col(keys[3]).isNull(), F.col(c)) for c in (n, fp1, fp2)}
    single = nulls.where((F.col(n) > 0) & F.col(keys[4]).isNull()).withColumns(sets).dropDuplicates([keys[3], n, fp1, fp2])
    empty = nulls.where(F.col(n) == 0)
    return named.where(F.col(doc_id).cast("bigint").isNotNull()).unionByName(empty.select(*docs.columns)).unionByName(single.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
