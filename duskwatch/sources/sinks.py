"""Writing logs, events and tables.  Nothing here overwrites what it was read from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions import net
from duskwatch.functions import payload as pl
from duskwatch.sources import schemas as S


def packet_lines(packets: DataFrame, **more: Column) -> DataFrame:
    """The packet log's columns in header order, as text; an unprobed packet has empty probe fields.

    ``more`` adds columns of the packets' own."""
    probe = lambda c: F.when(F.col("probed"), F.col(c).cast("string")).otherwise("")
    columns = {
        "ts": F.col("ts_ms"), "saddr": net.long_to_ip("saddr"), "daddr": net.long_to_ip("daddr"), "window size": F.col("window_size"), "probed": F.when(F.col("probed"), "true").otherwise("false"),
        "method": probe("method"), "userid": probe("userid"), "probe anum": probe("probe_anum"), "probe snum": probe("probe_snum"), "num probes": probe("num_probes"),
    }
    return packets.select(*[columns.get(c, F.col(c) if c in packets.columns else F.lit(None)).cast("string").alias(c) for c in S.PACKET_COLUMNS], *[c.alias(n) for n, c in more.items()])


def confirmation_lines(confs: DataFrame) -> DataFrame:
    columns = {"start sec": F.floor(F.col("ts_ms") / 1000), "start usec": F.pmod("ts_ms", F.lit(1000)) * 1000, "saddr": net.long_to_ip("saddr"), "daddr": net.long_to_ip("daddr"), "num probes": F.col("num_probes")}
    return confs.select(*[columns.get(c, F.col(c) if c in confs.columns else F.lit(None)).cast("string").alias(c) for c in S.CONFIRMATION_COLUMNS])


def write_packet_log(packets: DataFrame, path: str, mode: str = "errorifexists", tag: Column | None = None) -> None:
    """Packet log in folders date=/hour=, and tag= if given, one header a file, pipes between fields, gzip.

    Rows meet by hour before they are written, so an hour is one file or, where it is large, as many as its size
    asks for; small hours share a task.  Spark divides a large hour between the tasks that sent its rows, so rows are
    dealt out evenly first: packets that come from one task are then made text, sorted and written by many.  A small hour
    whose rows meet with a large one's is divided with it.
    """
    packets = packets.hint("rebalance")
    ts = F.timestamp_millis(F.col("ts").cast("bigint"))
    folders = ["date", "hour"] + ([] if tag is None else ["tag"])
    lines = packet_lines(packets) if tag is None else packet_lines(packets, tag=tag)
    lines = lines.withColumns({"date": F.date_format(ts, "yyyy-MM-dd"), "hour": F.date_format(ts, "HH")})
    met = lines.hint("rebalance", *folders)
    met.sortWithinPartitions(*folders, "ts").write.partitionBy(*folders).mode(mode).option("sep", "|").option("header", True).option("emptyValue", "").option("compression", "gzip").csv(path)


def split_late(rows: DataFrame, arrival: str, log: str | None = None, since_ms: int | None = None, width: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Rows a two-hour log accepts, and those it rejects: older than the hour before the newest seen.

    ``arrival`` (numbers) orders rows as they came, within each ``log`` (a column; None: one log);
    ``since_ms`` is an hour seen before all of them.  The running maximum is taken within ranges of
    ``width`` arrivals and over the ranges' maxima, so that no task gets a whole log.  A row without a
    time is neither late nor newest.
    """
    own = [log] if log else []
    marked = rows.withColumns({"_range": F.floor(F.col(arrival) / width), "_hour": net.hour_ms("ts_ms")})
    tops = marked.groupBy(*own, "_range").agg(F.max("_hour").alias("_top"))
    before = Window.partitionBy(*own).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*[F.col(c).alias("_log") for c in own], F.col("_range").alias("_r"), F.max("_top").over(before).alias("_before"))
    same = marked["_range"].eqNullSafe(tops["_r"]) & (marked[log].eqNullSafe(tops["_log"]) if log else F.lit(True))
    joined = marked.join(tops, same)
    within = Window.partitionBy(*own, "_range").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    newest = F.greatest(F.max("_hour").over(within), "_before", F.lit(since_ms).cast("long"))
    joined = joined.withColumn("_late", F.coalesce(F.col("_hour") < newest - 3_600_000, F.lit(False)))
    return joined.where("not _late").select(*rows.columns), joined.where("_late").select(*rows.columns)


def with_events(handshakes: DataFrame, packets: DataFrame) -> DataFrame:
    """Handshakes in the JSON form (S.HANDSHAKES): four packets as nested events."""
    p = packets.select("userid", F.struct(
        F.struct(F.floor(F.col("ts_ms") / 1000).alias("timestamp"), net.long_to_ip("saddr").alias("saddr"), net.long_to_ip("daddr").alias("daddr"), F.col("ipid").cast("int").alias("ipid"), F.col("ttl").cast("int").alias("ttl"), "proto", F.struct(
            F.col("sport").cast("int").alias("sport"), F.col("dport").cast("int").alias("dport"), "snum", "anum", F.lit(0).alias("window_size"),
            net.flags_array({c: F.col(c) for c in ("fin", "syn", "rst", "ack")}).alias("flags"), net.options_array("options").alias("options"), "payload",
        ).alias("payload")).alias("trigger"),
        net.probe_request(F.col("method").isNotNull(), num_probes=F.lit(1)).alias("reaction"),
    ).alias("event"))
    out = handshakes.where("not repeated")
    for part in ("isyn", "iack", "rsyn", "rack"):
        side = p.select(F.col("userid").alias(f"{part}_id"), F.col("event").alias(f"{part}_event"))
        out = out.join(side, out[part] == side[f"{part}_id"], "left")
    return out.select(F.floor(F.col("ts_ms") / 1000).alias("ts"), "tag", *[F.col(f"{part}_event").alias(part) for part in ("isyn", "iack", "rsyn", "rack")])


def write_handshakes(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Events as gzipped JSON lines in one folder per hour, ordered by time within a file.

    Rows meet by hour before they are written, as in :func:`write_packet_log`.
    """
    hour = F.date_format(F.timestamp_seconds(F.col("ts")), "yyyyMMdd-HH")
    events.withColumn("hour", hour).hint("rebalance", "hour").sortWithinPartitions("hour", "ts").write.partitionBy("hour").mode(mode).option("compression", "gzip").json(path)


def kafka_rows(df: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows as Kafka messages: JSON values, and keys if given."""
    value = F.to_json(F.struct("*")).alias("value")
    return df.select(value) if key is None else df.select(key.cast("string").alias("key"), value)


def write_kafka(df: DataFrame, topic: str, servers: str, checkpoint: str | None = None):
    """Send rows to a topic; a streaming table starts a query (the connector must be on the classpath)."""
    rows = kafka_rows(df)
    if df.isStreaming:
        return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()
    return rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def annotated_path(path: str, kind: str) -> str:
    """Path of an annotated copy, never the path itself: x.csv.gz -> x.<kind>.csv.gz."""
    for suffix in (".csv.gz", ".csv"):
        if path.endswith(suffix):
            return f"{path.removesuffix(suffix)}.{kind}{suffix}"
    return f"{path}.{kind}"


def write_annotated(df: DataFrame, path: str, kind: str) -> str:
    out = annotated_path(path, kind)
    df.write.option("sep", "|").option("header", True).option("compression", "gzip").csv(out)
    return out


def cached(spark, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table kept at a path; made and written first if it is missing or ``force`` is given."""
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_contact_types(df: DataFrame, path: str) -> None:
    df.toDF(*[c.replace("_", "-") for c in df.columns]).write.mode("append").option("sep", "|").option("header", True).csv(path)


def write_activity(df: DataFrame, path: str) -> None:
    """Activity rows in folders name_key=/month=; the key is the server where the name is empty."""
    key = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("server"))
    rows = df.withColumns({"name_key": key, "month": F.date_format(F.timestamp_millis("ts_ms"), "yyyy.MM")})
    rows.hint("rebalance", "name_key", "month").write.partitionBy("name_key", "month").option("compression", "gzip").option("header", True).csv(path)


def write_hashes(known: DataFrame, missing: DataFrame, path: str) -> None:
    """The hash database and the set of hashes not found, side by side."""
    known.write.mode("overwrite").json(f"{path}/known")
    missing.select("hash").distinct().write.mode("overwrite").json(f"{path}/missing")


def write_hash_database(known: DataFrame, path: str) -> None:
    """``hash, first, last`` (maps of source to epoch seconds) as one JSON object a file, an entry a line."""
    pair = F.concat(F.regexp_replace(F.to_json(F.array("hash")), r"^\[|\]$", ""), F.lit(": "), F.to_json(F.struct(*[F.coalesce(c, F.create_map().cast("map<string,bigint>")).alias(c) for c in ("first", "last")])))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "{"
        for batch in batches:
            lines = []
            for line in batch.column(0).to_pylist():
                lines.append(lead + line)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if lead == "{" else "}"])], ["value"])

    known.select(pair.alias("value")).mapInArrow(framed, "value string").write.text(path)


def unparsed_payloads(df: DataFrame, text: str) -> DataFrame:
    """Payloads that name more tools than URLs were found in."""
    return df.where(pl.unparsed(text)).select(text)


def write_probe_results(df: DataFrame, path: str) -> None:
    """``address,port,protocol,payload`` in one folder per hour."""
    rows = df.select(net.long_to_ip("addr").alias("address"), "port", "proto", "payload", F.date_format(F.timestamp_millis("ts_ms"), "yyyyMMdd-HH").alias("hour"))
    rows.write.partitionBy("hour").csv(path)
