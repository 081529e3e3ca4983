"""Retransmits, and greedy one-to-one matching in one ordered pass per key."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.functions.net import hour_ms

HOUR = 3_600_000


def flag_retransmits(packets: DataFrame, order: tuple[str, ...] = ("ts_ms",)) -> DataFrame:
    """Adds ``retransmit``: the five-field key was seen before in this hour, or in the previous one
    while this hour is not half over.  RST packets are neither retransmits nor sightings."""
    key = Window.partitionBy("saddr", "daddr", "sport", "dport", "snum", "_rst").orderBy(*order)
    here, seen = hour_ms("ts_ms"), F.lag(hour_ms("ts_ms")).over(key)
    young = F.col("ts_ms") < here + HOUR // 2
    again = (seen == here) | ((seen == here - HOUR) & young)
    marked = packets.withColumn("_rst", F.col("rst") == 1)
    return marked.withColumn("retransmit", ~F.col("_rst") & F.coalesce(again, F.lit(False))).drop("_rst")


PAIR = ("userid", "method", "saddr", "daddr", "sport", "dport")


def first_free(timeout_ms: int):
    """Greedy one-to-one matching of one key's packets and confirmations, given in the order of time.

    Returns a function of (time, row) that takes a packet's row or, for a confirmation, None, and gives the
    matched ``(row, confirmation's time)`` or None.  Packets in order each take the first free confirmation
    at most ``timeout_ms`` away; since all reach equally far, the first packet waiting and the first free
    confirmation always belong together, and only what is within reach is kept.
    """
    waiting, free = deque(), deque()

    def step(ts: int, row):
        mine, others = (free, waiting) if row is None else (waiting, free)
        for queue in (mine, others):
            while queue and queue[0][0] < ts - timeout_ms:
                queue.popleft()
        if not others:
            mine.append((ts, row))
            return None
        other_ts, other = others.popleft()
        return (other, ts) if row is None else (row, other_ts)

    return step


def match_confirmations(packets: DataFrame, confs: DataFrame, timeout_ms: int = 300_000) -> DataFrame:
    """Adds ``con_ms`` to packets: the confirmation's time, null for unprobed packets.

    A probed packet (non-null method) needs a confirmation of the swapped addresses and ports,
    same method and userid, at most ``timeout_ms`` away; each confirmation serves one packet, in
    order of arrival (``ts_ms``, ``step``).  Probed packets without one are left out, and those with a
    null among these columns have none.

    Packets and confirmations meet by the six columns.  Where a key has one packet, which is nearly always so,
    a window sees its first confirmation; keys with more packets, and those whose first confirmation came too
    early to be the packet's, are walked in the order of time, which keeps what is within reach.
    """
    usable = F.expr("method is null or (" + " and ".join(f"{c} is not null" for c in (*PAIR, "ts_ms")) + ")")
    flat = [*PAIR, "ts_ms", "step"]
    rest = [c for c in packets.columns if c not in flat]
    p = packets.where(usable).select(*flat, F.lit(True).alias("is_packet"), F.struct(*rest).alias("packet"))
    c = turned(packets, confs).where(" and ".join(f"{k} is not null" for k in (*PAIR, "ts_ms")))
    rows = p.unionByName(c.select(*PAIR, "ts_ms", F.lit(-1).cast(packets.schema["step"].dataType).alias("step"), F.lit(False).alias("is_packet"), F.lit(None).cast(p.schema["packet"].dataType).alias("packet")))
    own, is_packet, probed = Window.partitionBy(*PAIR), F.col("is_packet"), F.col("method").isNotNull()
    rows = rows.withColumns({"np": F.count_if(is_packet).over(own), "p_ts": F.min(F.when(is_packet, F.col("ts_ms"))).over(own), "c_ts": F.min(F.when(~is_packet, F.col("ts_ms"))).over(own)})
    walked = probed & ((F.col("np") > 1) | (F.col("c_ts") < F.col("p_ts") - timeout_ms))
    first = F.when(probed, F.col("c_ts"))
    columns = [F.col(c) if c in flat else F.col("packet")[c].alias(c) for c in packets.columns]
    single = rows.where(is_packet & (~probed | (~walked & (F.col("c_ts") <= F.col("ts_ms") + timeout_ms)))).select(*columns, first.alias("con_ms"))
    several = rows.where(walked & F.col("p_ts").isNotNull() & F.col("c_ts").isNotNull()).sortWithinPartitions(*flat).select(*flat, "is_packet", "packet")
    schema = T.StructType([*packets.schema.fields, T.StructField("con_ms", packets.schema["ts_ms"].dataType)])
    names = [f.name for f in schema]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            found = []
            kind = lambda c: batch.schema.field(c).type if c in flat else batch.schema.field("packet").type.field(c).type
            kinds = [*map(kind, names[:-1]), kind("ts_ms")]
            for values, here, packet in zip(zip(*[batch.column(c).to_pylist() for c in flat]), batch.column("is_packet").to_pylist(), batch.column("packet").to_pylist()):
                if values[: len(PAIR)] != key:
                    key, step = values[: len(PAIR)], first_free(timeout_ms)
                if (hit := step(values[len(PAIR)], {**packet, **dict(zip(flat, values))} if here else None)) is not None:
                    found.append((*[hit[0][name] for name in names[:-1]], hit[1]))
            values = zip(*found) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(values, kinds)], names)

    return single.unionByName(several.mapInArrow(walk, schema))


def turned(packets: DataFrame, confs: DataFrame) -> DataFrame:
    """Confirmations as seen by the packets they answer: their PAIR columns and ``ts_ms``, in the packets' types."""
    swap = {"saddr": "daddr", "daddr": "saddr", "sport": "dport", "dport": "sport"}
    return confs.select(*[F.col(swap.get(n, n)).cast(packets.schema[n].dataType).alias(n) for n in PAIR], F.col("ts_ms").cast(packets.schema["ts_ms"].dataType).alias("ts_ms"))


def confirmed(packets: DataFrame, confs: DataFrame, order: tuple[str, ...] = ("ts_ms",), keys: tuple[str, ...] = ("saddr", "daddr", "dport")) -> DataFrame:
    """Packets with ``retransmit`` and ``con_ms``, as :func:`flag_retransmits` and :func:`match_confirmations` give them.

    Both deal rows by columns that include ``keys``, so packets and confirmations are shuffled once, by these.
    """
    n = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    back = {"saddr": "daddr", "daddr": "saddr", "sport": "dport", "dport": "sport"}
    dealt = confs.repartition(n, *[F.col(back.get(k, k)).cast(packets.schema[k].dataType) for k in keys])
    return match_confirmations(flag_retransmits(packets.repartition(n, *keys), order), dealt)


def unused_confirmations(packets: DataFrame, confs: DataFrame, timeout_ms: int = 300_000) -> DataFrame:
    """One row: confirmations that no packet can claim, and those of them that are not RSTs."""
    p = packets.select("userid", "method", F.col("daddr").alias("saddr"), F.col("saddr").alias("daddr"), F.col("dport").alias("sport"), F.col("sport").alias("dport"), F.col("ts_ms").alias("p_ms"))
    keys = ["userid", "method", "saddr", "daddr", "sport", "dport"]
    near = [F.col(f"c.{k}") == F.col(f"p.{k}") for k in keys] + [F.abs(F.col("c.ts_ms") - F.col("p.p_ms")) <= timeout_ms]
    left = confs.alias("c").join(p.alias("p"), near, "left_anti")
    return left.agg(F.count(F.lit(1)).alias("unused"), F.count_if(F.col("method") != "tcp-rst").alias("unsure"))
