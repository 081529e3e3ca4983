"""Reading packet, confirmation and lookup files.

Readers of logs, prefix tables, lists and targets return typed rows and the quarantine: the lines that
cannot be typed, with the reason where there are several, instead of stopping the job or vanishing.  File names are read from ``_metadata``, so hour, tag and
protocol are columns that a filter can use.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.functions import net
from duskwatch.sources import schemas as S

#: 2024-01-31.13:00:00.<tag>.<program>.<proto>.<kind>.<unix seconds>.csv[.gz]; local and HDFS paths
#: that Spark reads cannot hold colons, so dashes are taken for them as well.
FILE_NAME = r"^(\d{4}-\d{2}-\d{2}\.\d{2}[:-]\d{2}[:-]\d{2})\.([^.]+)\.([^.]+)\.([^.]+)\.([^.]+)\.(\d+)\.csv"


def log_file_name(ts_ms: Column | str, tag: Column, proto: Column, kind: Column, program: str = "duskwatch") -> Column:
    """File name of a row's hour, in UTC."""
    hour = F.timestamp_millis(net.hour_ms(ts_ms))
    return F.concat_ws(".", F.date_format(hour, "yyyy-MM-dd'.'HH:mm:ss"), tag, F.lit(program), proto, kind, F.unix_seconds(hour).cast("string"), F.lit("csv"))


def parse_file_name(name: Column | str) -> Column:
    """struct(hour_ms, tag, proto, kind), null for other names."""
    c = F.col(name) if isinstance(name, str) else name
    part = lambda k: F.regexp_extract(c, FILE_NAME, k)
    hour = F.unix_millis(F.try_to_timestamp(F.replace(part(1), F.lit(":"), F.lit("-")), F.lit("yyyy-MM-dd'.'HH-mm-ss")))
    return F.when(c.rlike(FILE_NAME), F.struct(hour.alias("hour_ms"), part(2).alias("tag"), part(4).alias("proto"), part(5).alias("kind")))


def _lines(spark: SparkSession, path: str, columns, stream: bool = False, **options) -> DataFrame:
    """Text lines as arrays of fields, without header lines, with the file's name."""
    reader = (spark.readStream if stream else spark.read).options(**options)
    text = reader.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return text.where(F.col("value") != "|".join(columns)).withColumn("f", F.split("value", r"\|"))


def repair_udp(fields: Column) -> Column:
    """Fields of a packet line; a UDP line that lacks one gets an empty one after ``snum``."""
    short = (F.get(fields, F.lit(5)) == "udp") & (F.size(fields) == len(S.PACKET_COLUMNS) - 1)
    return F.when(short, F.array_insert(fields, 11, F.lit(""))).otherwise(fields)


def _number(fields: Column, at: int, low: int, high: int, empty: int | None = None) -> Column:
    text = F.get(fields, F.lit(at))
    value = text.try_cast("bigint")
    ok = F.when(value.between(low, high), value)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(empty)).otherwise(ok) if empty is not None else ok


U8, U16, U32 = 255, 65535, 2**32 - 1


def typed_packets(lines: DataFrame) -> DataFrame:
    """``lines`` with ``packet`` (a struct of S.PACKETS) and ``problem``, null where the row is good.

    Fields are repaired, cast and checked in projections of their own, and ``problem`` comes out of an ``explode``: Spark
    would else copy splitting and casts into the condition on it, once a mention.
    """
    own = [c for c in lines.columns if c not in ("packet", "problem")]
    lines = lines.withColumn("_fields", repair_udp(F.col("f")))
    f = F.col("_fields")
    text = lambda at: F.coalesce(F.get(f, F.lit(at)), F.lit(""))
    address = lambda at: F.when(net.is_ipv4(text(at)), F.aggregate(F.split(text(at), r"\."), F.lit(0).cast("bigint"), lambda v, part: v * 256 + part.try_cast("bigint")))
    number = lambda at: F.when(text(at) != "", text(at).try_cast("bigint")).otherwise(F.lit(None if at in (0, 3, 4, 19) else 0))
    lines = lines.select(*own, "_fields", *[address(at).alias(f"_{at}") for at in (1, 2)], *[number(at).alias(f"_{at}") for at in (0, 3, 4, *range(6, 10), *range(12, 17), *range(19, 23))])
    num = lambda at, high: F.when(F.col(f"_{at}").between(0, high), F.col(f"_{at}"))
    probed = text(17) == "true"
    fields = {
        "ts_ms": num(0, 2**53), "saddr": F.col("_1"), "daddr": F.col("_2"), "ipid": num(3, U16), "ttl": num(4, U8),
        "proto": F.when(text(5).isin("tcp", "udp", "icmp"), text(5)), "sport": num(6, U16), "dport": num(7, U16), "anum": num(8, U32), "snum": num(9, U32), "options": text(10), "payload": text(11),
        **{n: num(12 + k, 1) for k, n in enumerate(("syn", "ack", "rst", "fin"))}, "window_size": num(16, U16), "probed": probed,
        "method": F.when(probed, text(18)), "userid": F.when(probed, num(19, U32)), "probe_anum": F.when(probed, num(20, U32)), "probe_snum": F.when(probed, num(21, U32)), "num_probes": F.when(probed, num(22, U16)),
    }
    kinds = {x.split()[0]: x.split()[1] for x in S.PACKETS.split(", ")}
    wrong = [F.when(fields[n].isNull(), F.lit(n)) for n in ("ts_ms", "saddr", "daddr", "ipid", "ttl", "proto", "sport", "dport", "anum", "snum", "syn", "ack", "rst", "fin", "window_size")]
    wrong.append(F.when(probed & fields["userid"].isNull(), F.lit("userid")))
    size = F.when(F.size(f) != len(S.PACKET_COLUMNS), F.lit("number of fields"))
    problem = F.coalesce(size, F.array_join(F.filter(F.array(*wrong), lambda n: n.isNotNull()), ","))
    packet = F.struct(*[c.cast("boolean" if n == "probed" else kinds[n]).alias(n) for n, c in fields.items()])
    typed = lines.select(*own, packet.alias("packet"), problem.alias("_found"))
    return typed.withColumn("problem", F.explode(F.array("_found"))).withColumn("problem", F.nullif("problem", F.lit(""))).drop("_found")


def _under(spark: SparkSession, path: str, pattern: str = "") -> list[str]:
    """Paths that match a pattern, hidden ones left out; one listing of a folder, none of what is below."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path + pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or ()
    return [str(f.getPath()) for f in found if not f.getPath().getName().startswith(("_", "."))]


def _between(date: Column, hour: Column, start_ms: int | None, end_ms: int | None) -> Column:
    """Whether an hour folder is in a range, in terms of the folders' columns only."""
    inside = F.lit(True)
    if start_ms is not None:
        at = datetime.fromtimestamp(start_ms // 1000, UTC)
        inside = inside & (date >= F.lit(at.date())) & ((date > F.lit(at.date())) | (hour >= at.hour))
    if end_ms is not None:
        at = datetime.fromtimestamp(-(-end_ms // 3_600_000) * 3600, UTC)  # the first hour that is left out
        inside = inside & (date <= F.lit(at.date())) & ((date < F.lit(at.date())) | (hour < at.hour))
    return inside


def _hour_folders(spark: SparkSession, days: list[str], start_ms: int | None, end_ms: int | None, **options) -> list[DataFrame]:
    """``value, file, hour_ms, tag`` of folders date=/hour=[/tag=]: only the days of the range are listed, and only its hours read."""
    first, last = (None if t is None else str(datetime.fromtimestamp(t // 1000, UTC).date()) for t in (start_ms, end_ms))
    bases: dict[str, list[str]] = {}
    for day in days:
        base, _, name = day.rpartition("/date=")
        if (first is None or name >= first) and (last is None or name <= last):
            bases.setdefault(base, []).append(day)
    out = []
    for base, chosen in bases.items():
        text = spark.read.options(**options).option("basePath", base).text(chosen)
        date, hour = F.col("date").cast("date"), F.col("hour").cast("int")
        at = F.unix_millis(date.cast("timestamp")) + hour.cast("long") * 3_600_000
        tag = F.col("tag").cast("string") if "tag" in text.columns else F.lit(None).cast("string")
        out.append(text.where(_between(date, hour, start_ms, end_ms)).select("value", F.col("_metadata.file_name").alias("file"), at.alias("hour_ms"), tag.alias("tag"), F.lit(None).cast("string").alias("proto")))
    return out


def read_packets(spark: SparkSession, path: str, start_ms: int | None = None, end_ms: int | None = None, tag: str | None = None, proto: str | None = None, stream: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Packets of a CSV log and the quarantine: ``value, file, problem``.

    The log may hold the hour folders that ``sinks.write_packet_log`` makes, files named by hour, tag and protocol
    (FILE_NAME), and others, side by side.  A range takes whole hours from that of ``start_ms`` to the last that
    begins before ``end_ms``: folders and named files outside it are not opened, and other files are read and their
    rows compared.  Where ``tag`` is asked for, lines of files that tell none go to the quarantine; a protocol
    is compared with the name, else with the row.  With ``stream`` both are streaming tables that follow completed files.
    """
    if stream:
        text = spark.readStream.options(**options).text(path).select("value", F.col("_metadata.file_name").alias("file"))
        parts = []
    else:
        days = [] if options.get("recursiveFileLookup") else _under(spark, path, "/date=*")
        parts = _hour_folders(spark, days, start_ms, end_ms, **options)
        files = [f for f in _under(spark, path, "/*") or _under(spark, path) if "/date=" not in f] if days else [path]
        text = spark.read.options(**options).text(files).select("value", F.col("_metadata.file_name").alias("file")) if files else None
    if text is not None:
        name = parse_file_name("file")
        parts.append(text.select("value", "file", name["hour_ms"].alias("hour_ms"), name["tag"].alias("tag"), name["proto"].alias("proto")))
    own_hour, own_proto, first = net.hour_ms(F.get("f", F.lit(0)).try_cast("bigint")), F.get("f", F.lit(5)), None if start_ms is None else start_ms - start_ms % 3_600_000
    in_range = lambda hour: (F.lit(True) if first is None else hour >= first) & (F.lit(True) if end_ms is None else hour < end_ms)
    typed = []
    for lines in parts or [spark.createDataFrame([], "value string, file string, hour_ms long, tag string, proto string")]:
        lines = lines.where(F.col("hour_ms").isNull() | in_range(F.col("hour_ms")))
        for column, value in (("tag", tag), ("proto", proto)):
            if value is not None:
                lines = lines.where(F.col(column).isNull() | (F.col(column) == value))
        rows = typed_packets(lines.where(F.col("value") != "|".join(S.PACKET_COLUMNS)).withColumn("f", F.split("value", r"\|")))
        rows = rows.where(F.col("problem").isNotNull() | F.col("hour_ms").isNotNull() | in_range(own_hour))
        if proto is not None:
            rows = rows.where(F.col("problem").isNotNull() | F.col("proto").isNotNull() | (own_proto == proto))
        if tag is not None:
            rows = rows.withColumn("problem", F.coalesce("problem", F.when(F.col("tag").isNull(), "no tag")))
        typed.append(rows)
    rows = reduce(DataFrame.unionByName, typed)
    good = rows.where("problem is null").select("packet.*", F.col("tag").alias("log_tag"), F.col("hour_ms").alias("log_hour_ms"))
    return good, rows.where("problem is not null").select("value", "file", "problem")


def read_confirmations(spark: SparkSession, path: str, stream: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Confirmations (S.CONFIRMATIONS) of a CSV log, and the quarantine."""
    lines = _lines(spark, path, S.CONFIRMATION_COLUMNS, stream, **options)
    f = F.col("f")
    num = lambda at, high, empty=None: _number(f, at, 0, high, empty)
    ts = num(0, 2**40) * 1000 + F.floor(num(1, 999_999, 0) / 1000)
    row = F.struct(
        ts.alias("ts_ms"), F.get(f, F.lit(2)).alias("method"), num(3, U32).alias("userid"), num(4, U16, 0).cast("int").alias("num_probes"),
        net.ip_to_long(F.get(f, F.lit(5))).alias("saddr"), net.ip_to_long(F.get(f, F.lit(6))).alias("daddr"), num(7, U16, 0).cast("int").alias("sport"), num(8, U16, 0).cast("int").alias("dport"),
    )
    typed = lines.withColumn("row", row).withColumn("bad", F.col("row.ts_ms").isNull() | F.col("row.userid").isNull() | F.col("row.saddr").isNull() | F.col("row.daddr").isNull())
    return typed.where("not bad").select("row.*"), typed.where("bad").select("value", "file")


def read_json_confirmations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Confirmations (S.CONFIRMATIONS) of a JSON-lines log, and the quarantine.

    The time is ``start`` (sec, usec), or ``timestamp`` in seconds where that is missing.
    """
    schema = T.StructType.fromDDL(S.JSON_CONFIRMATIONS + ", broken string")
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path).withColumn("file", F.col("_metadata.file_name"))
    ts = F.coalesce(F.col("start.sec") * 1000 + F.floor(F.col("start.usec") / 1000), F.col("timestamp") * 1000)
    good = rows.select(
        "broken", "file", F.to_json(F.struct("start", "timestamp", "userid", "src", "dst")).alias("value"),
        F.struct(ts.alias("ts_ms"), "method", F.when(F.col("userid").between(0, U32), F.col("userid")).alias("userid"), F.lit(1).alias("num_probes"), net.ip_to_long("src").alias("saddr"), net.ip_to_long("dst").alias("daddr"), "sport", "dport").alias("row"),
    ).withColumn("bad", F.col("broken").isNotNull() | F.col("row.ts_ms").isNull() | F.col("row.userid").isNull() | F.col("row.saddr").isNull() | F.col("row.daddr").isNull())
    return good.where("not bad").select("row.*"), good.where("bad").select(F.coalesce("broken", "value").alias("value"), "file")


def read_rows(spark: SparkSession, path: str, columns: tuple[str, ...], row: Callable[[Column], dict[str, Column]], required: tuple[str, ...] = (), stream: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Rows of any pipe-separated log, and the quarantine.

    ``row`` makes named columns of a line's fields (an array), so that a new kind of row needs no reader of
    its own; lines with another number of fields, or without a ``required`` column, go to the quarantine.
    """
    lines = _lines(spark, path, columns, stream, **options)
    made = lines.withColumn("row", F.struct(*[c.alias(n) for n, c in row(F.col("f")).items()]))
    bad = F.size("f") != len(columns)
    for n in required:
        bad = bad | F.col(f"row.{n}").isNull()
    typed = made.withColumn("bad", bad)
    return typed.where("not bad").select("row.*"), typed.where("bad").select("value", "file")


def count_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, n``: number of lines of each file, headers included."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def read_legacy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Packets of the older JSON-lines log (one trigger and reaction a line), and the quarantine."""
    schema = T.StructType.fromDDL(S.LEGACY + ", broken string")
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    t = F.col("trigger")
    on = lambda flag: F.coalesce(F.try_element_at(t["tcp"]["flags"], F.lit(flag)), F.lit(False)).cast("int").alias(flag)
    good = rows.where(F.col("broken").isNull() & t.isNotNull()).select(
        t["observed"].alias("ts_ms"), net.ip_to_long(t["saddr"]).alias("saddr"), net.ip_to_long(t["daddr"]).alias("daddr"), t["ipid"].alias("ipid"), t["ttl"].alias("ttl"), t["protocol"].alias("proto"),
        F.coalesce(t["tcp"]["sport"], t["udp"]["sport"], F.lit(0)).alias("sport"), F.coalesce(t["tcp"]["dport"], t["udp"]["dport"], F.lit(0)).alias("dport"), F.coalesce(t["tcp"]["anum"], F.lit(0)).alias("anum"), F.coalesce(t["tcp"]["snum"], F.lit(0)).alias("snum"),
        F.coalesce(F.array_join(F.map_keys(t["tcp"]["options"]), ":"), t["icmp"]["type"], F.lit("")).alias("options"), F.coalesce(t["tcp"]["payload"], t["udp"]["payload"], F.lit("")).alias("payload"),
        on("syn"), on("ack"), on("rst"), on("fin"), F.coalesce(t["tcp"]["window_size"], F.lit(0)).alias("window_size"), F.col("reaction").isNotNull().alias("probed"),
        F.col("reaction.probe_method").alias("method"), F.col("reaction.userid").alias("userid"), F.col("reaction.anum").alias("probe_anum"), F.col("reaction.snum").alias("probe_snum"), F.col("reaction.num_probes").alias("num_probes"),
    )
    return good, rows.where(F.col("broken").isNotNull() | t.isNull()).select(F.col("broken").alias("value"))


def read_partitioned(spark: SparkSession, root: str, **where) -> tuple[DataFrame, DataFrame]:
    """Packets of an object store laid out as datasource=/protocol=/type=/year=/month=/day=, and the quarantine.

    Values in ``where`` prune folders before any file is opened.
    """
    text = spark.read.option("basePath", root).text(root).where(F.col("value") != "|".join(S.PACKET_COLUMNS))
    for column, value in where.items():
        text = text.where(F.col(column) == value)
    keep = [c for c in ("datasource", "protocol", "type", "year", "month", "day") if c in text.columns]
    typed = typed_packets(text.withColumn("f", F.split("value", r"\|")))
    return typed.where("problem is null").select("packet.*", *keep), typed.where("problem is not null").select("value", "problem", *keep)


def _json(spark: SparkSession, path: str, schema: str, good: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines file with ``file``, and the lines that do not parse or fit."""
    rows = spark.read.schema(T.StructType.fromDDL(f"{schema}, broken string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    names = [c for c in rows.columns if c != "broken"]
    rows = rows.select("*", F.col("_metadata.file_path").alias("file")).withColumn("fits", F.col("broken").isNull() & F.coalesce(F.expr(good), F.lit(False)))
    return rows.where("fits").select(*names, "file"), rows.where("not fits").select(F.coalesce("broken", F.to_json(F.struct(*names))).alias("value"), "file")


def read_handshakes(spark: SparkSession, path: str, days: int | None = None) -> DataFrame:
    """Assembled events (JSON lines, plain or gzip); with ``days`` the first so many days of them."""
    return sort_handshakes(spark, path, days)[0]


def sort_handshakes(spark: SparkSession, path: str, days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Assembled events as :func:`read_handshakes` gives them, and the quarantine: lines without a time or a tag."""
    rows, bad = _json(spark, path, S.HANDSHAKES, "ts is not null and tag is not null")
    rows = rows.drop("file")
    if days is None:
        return rows, bad
    first = rows.agg(F.min("ts").alias("t")).first()["t"] or 0
    return rows.where(F.col("ts") < first - first % 3600 + days * 86_400), bad


def _sorted_out(text: DataFrame, good: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows that fit, with the given columns, and the lines of the others."""
    fits = F.coalesce(F.expr(good), F.lit(False))
    return text.where(fits).select(*columns), text.where(~fits).select("value")


def read_scanner_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``tag, prio, ip`` from files ips.<tag>.txt, the order of tags being alphabetical, and the quarantine."""
    rows = spark.read.text(path).where("trim(value) <> ''").select("value", F.regexp_extract("_metadata.file_name", r"ips\.(.+)\.txt", 1).alias("tag"), net.ip_to_long(F.trim("value")).alias("ip"))
    good, bad = _sorted_out(rows.withColumn("prio", F.col("tag")), "ip is not null", "tag", "prio", "ip")
    return good.distinct(), bad


def read_prefixes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``lo, len, prefix, asn`` of a tab-separated prefix table with ; comments, and the quarantine."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(value, ';')").select("value", F.get(f, F.lit(0)).alias("prefix"), F.get(f, F.lit(1)).try_cast("bigint").alias("asn"))
    return _sorted_out(rows.withColumn("c", net.cidr("prefix")), "c is not null and asn is not null", "c.lo", "c.len", "prefix", "asn")


def read_geo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``lo, hi, country_code, region_code, continent_code, city`` of a prefix table, and the quarantine."""
    names = ("country_code", "region_code", "continent_code", "city")
    f = F.split("value", r"\|")
    rows = spark.read.text(path).where(F.col("value") != "|".join(("prefix", *names))).select("value", F.size(f).alias("n"), net.cidr(F.get(f, F.lit(0))).alias("c"), *[F.nullif(F.get(f, F.lit(k + 1)), F.lit("")).alias(n) for k, n in enumerate(names)])
    return _sorted_out(rows, "c is not null and n = 5", "c.lo", "c.hi", *names)


def read_downloads(spark: SparkSession, path: str) -> DataFrame:
    """Download logs <hash>/downloads.csv.gz with the hash of their folder."""
    return sort_downloads(spark, path)[0]


def sort_downloads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Downloads as :func:`read_downloads` gives them, and the quarantine: lines with another number of fields or without a time."""
    names = S.DOWNLOADS.fieldNames()
    f = F.split("value", r"\|")
    text = spark.read.text(path).where(F.col("value") != "|".join(names)).select("value", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("hash"), F.size(f).alias("n"), *[F.get(f, F.lit(k)).alias(c) for k, c in enumerate(names)])
    return _sorted_out(text, f"n = {len(names)} and try_cast(timestamp as double) is not null", *names, "hash")


def read_reputation_replies(spark: SparkSession, path: str) -> DataFrame:
    """``hash, first_submission, last_submission`` from reply files <hash>.json[.gz]; null dates if empty."""
    return sort_reputation_replies(spark, path)[0]


def sort_reputation_replies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Replies as :func:`read_reputation_replies` gives them, and the quarantine: what is no reply."""
    rows, bad = _json(spark, path, "data array<struct<attributes:struct<first_submission_date:bigint,last_submission_date:bigint>>>", "data is not null")
    first = F.get("data", F.lit(0))["attributes"]
    name = F.element_at(F.split("file", "/"), -1)
    return rows.select(F.regexp_extract(name, r"^([^.]+)\.", 1).alias("hash"), first["first_submission_date"].alias("first_submission"), first["last_submission_date"].alias("last_submission")), bad


def read_hash_database(spark: SparkSession, path: str) -> DataFrame:
    """``hash, first, last`` (maps of source to epoch seconds) of databases kept as one JSON object a file."""
    return sort_hash_database(spark, path)[0]


def sort_hash_database(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries as :func:`read_hash_database` gives them, and the quarantine.

    An entry ends with two braces, which end nothing else, so files are read as records that end there: one entry a row,
    whatever the size of the object, and parts of a plain file by several tasks.  An object that is written with
    blanks between its braces is one record and is parsed whole.
    """
    text = spark.read.option("lineSep", "}}").text(path).select("value", F.regexp_replace("value", r"^[\s,{]*", "").alias("entry"), F.rtrim(F.regexp_replace("value", r"[\s}]+$", "")).alias("bare")).where("bare not in ('', '{')")
    parsed = F.coalesce(F.from_json(F.concat(F.lit("{"), "entry", F.lit("}}}")), S.HASH_ENTRY), F.from_json("value", S.HASH_ENTRY))
    rows = text.withColumn("parsed", parsed)
    whole = F.coalesce(F.forall(F.map_values("parsed"), lambda e: e["first"].isNotNull()) & (F.size("parsed") > 0), F.lit(False))
    good = rows.where(whole).select(F.explode("parsed").alias("hash", "e")).select("hash", "e.first", "e.last")
    return good, rows.where(~whole).select("value")


def read_annotatable(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """Any pipe-separated table with a header, all strings."""
    return spark.read.option("sep", sep).option("header", True).csv(path)


def read_targets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Probe targets: five comma fields, # comments; and the quarantine."""
    f = F.split("value", ",", 5)
    port = lambda at: _number(f, at, 0, U16).cast("int")
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").select("value", F.size(f).alias("n"), F.get(f, F.lit(0)).alias("saddr"), F.get(f, F.lit(1)).alias("daddr"), port(2).alias("sport"), port(3).alias("dport"), F.get(f, F.lit(4)).alias("payload"))
    rows = rows.withColumn("fits", net.is_ipv4("saddr") & net.is_ipv4("daddr"))
    return _sorted_out(rows, "n = 5 and fits and sport is not null and dport is not null", "saddr", "daddr", "sport", "dport", "payload")


def read_contact_types(spark: SparkSession, path) -> DataFrame:
    """Union of counter files."""
    rows = spark.read.schema(S.CONTACT_TYPES).option("sep", "|").option("header", True).csv(path)
    return rows.toDF(*[c.replace("-", "_") for c in rows.columns])


def read_hashes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``sinks.write_hashes`` wrote: the known hashes' rows, and those not found."""
    return spark.read.json(f"{path}/known"), spark.read.schema("hash string").json(f"{path}/missing")
