"""What is known about addresses and hashes, joined to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions.net import bounds

#: Networks of known scanners; fixed values, in order of precedence.
SCANNERS = (
    ("censys", "198.108.66.0/23"), ("censys", "192.35.168.0/23"),
    ("kudelski", "185.35.62.0/23"),
    ("rapid7", "5.63.151.96/27"), ("rapid7", "71.6.233.0/24"), ("rapid7", "88.202.190.128/27"), ("rapid7", "146.185.25.160/27"), ("rapid7", "109.123.117.224/27"),
    ("shadowserver", "184.105.139.64/26"), ("shadowserver", "184.105.247.192/26"), ("shadowserver", "216.218.206.64/26"), ("shadowserver", "74.82.47.0/26"), ("shadowserver", "65.49.20.64/26"),
)


def scanner_of(ip, scanners=SCANNERS):
    """Name of the first known scanner network that an address lies in, else null.

    The networks are constants, so this is a chain of comparisons and needs no join at all.
    """
    name = F.lit(None).cast("string")
    for tag, prefix in reversed(scanners):
        name = F.when(F.col(ip).between(*bounds(prefix)), tag).otherwise(name)
    return name


def tag_known_scanners(df: DataFrame, ip: str, lists: DataFrame | None = None, scanners=SCANNERS) -> DataFrame:
    """Adds ``project``: network, else first list (``tag, prio, ip``) with the address, else unknown."""
    found = df.withColumn("project", scanner_of(ip, scanners))
    if lists is not None:
        first = lists.groupBy(F.col("ip").alias("_ip")).agg(F.min_by("tag", "prio").alias("_tag"))
        found = found.join(first, F.col(ip) == F.col("_ip"), "left").withColumn("project", F.coalesce("project", "_tag")).drop("_ip", "_tag")
    return found.withColumn("project", F.coalesce("project", F.lit("unknown")))


def longest_prefix(ips: DataFrame, ip: str, prefixes: DataFrame, every: bool = False) -> DataFrame:
    """``ip`` and the columns of the longest prefix (``lo, len, ..``) that holds it, for each distinct address.

    Where the table holds that prefix several times, one of its rows counts, or with ``every`` each gives a row.

    An address is compared by equality only: once for each length that prefixes of its first octet have, cut to that
    length.  No range join, and each address is looked up once however often it occurs; those whose octet
    has no prefix go at once.  The octets' lengths are at most 256 rows.
    """
    one = ips.select(F.col(ip).alias("ip")).where("ip is not null").distinct()
    octets = F.sequence(F.shiftright("lo", 24), F.shiftright(F.col("lo") + F.expr("shiftleft(1L, 32 - len)") - 1, 24))
    lengths = prefixes.select("len", F.explode(octets).alias("_octet")).groupBy("_octet").agg(F.collect_set("len").alias("_lengths"))
    cut = one.join(F.broadcast(lengths), F.shiftright("ip", 24) == F.col("_octet")).select("ip", F.explode("_lengths").alias("len"))
    cut = cut.withColumn("lo", F.col("ip") - F.pmod("ip", F.expr("shiftleft(1L, 32 - len)")))
    rest = [c for c in prefixes.columns if c not in ("lo", "len")]
    hit = cut.join(prefixes, ["len", "lo"])
    if every:
        return hit.withColumn("_place", F.rank().over(Window.partitionBy("ip").orderBy(F.desc("len")))).where("_place = 1").select("ip", "len", "lo", *rest)
    return hit.groupBy("ip").agg(F.max_by(F.struct("len", "lo", *rest), F.col("len")).alias("p")).select("ip", "p.*")


def add_asn(df: DataFrame, fields: list[str], table: DataFrame) -> DataFrame:
    """Adds ``<field>.prefix`` and ``<field>.asn`` (table: ``lo, len, prefix, asn``), null for misses."""
    for f in fields:
        found = longest_prefix(df, f, table).select(F.col("ip").alias("_ip"), F.col("prefix").alias(f"{f}.prefix"), F.col("asn").alias(f"{f}.asn"))
        df = df.join(found, df[f] == found["_ip"], "left").drop("_ip")
    return df


def add_geo(df: DataFrame, fields: list[str], table: DataFrame, shift: int = 16, every: bool = False) -> DataFrame:
    """Adds country, region, continent and city of each field from ranges ``lo, hi, ..``.

    The range that begins last counts. Where several begin there, one of them does, or with ``every`` each gives a row.

    Ranges and addresses meet by equality on blocks of 2^``shift`` addresses, then by the bounds.
    """
    names = ("country_code", "region_code", "continent_code", "city")
    blocks = table.select("*", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright("hi", shift))).alias("_b"))
    for f in fields:
        one = df.select(F.col(f).alias("_ip")).where("_ip is not null").distinct().withColumn("_b", F.shiftright("_ip", shift))
        found = one.join(blocks, "_b").where("_ip between lo and hi")
        if every:
            found = found.withColumn("_place", F.rank().over(Window.partitionBy("_ip").orderBy(F.desc("lo")))).where("_place = 1").select("_ip", F.struct(*names).alias("_g"))
        else:
            found = found.groupBy("_ip").agg(F.max_by(F.struct(*names), F.col("lo")).alias("_g"))
        found = found.select("_ip", *[F.col(f"_g.{n}").alias(f"{f}.{n}") for n in names])
        df = df.join(found, df[f] == found["_ip"], "left").drop("_ip")
    return df


def add_reputation(df: DataFrame, ip: str, snapshot: DataFrame) -> DataFrame:
    """Adds ``classification`` and ``spoofable`` (snapshot: ``ip, classification, spoofable``)."""
    s = snapshot.select(F.col("ip").alias("_ip"), F.col("classification").alias("_c"), F.col("spoofable").cast("string").alias("_s"))
    out = df.join(s, df[ip] == s["_ip"], "left")
    return out.withColumns({"classification": F.coalesce("_c", F.lit("no result")), "spoofable": F.coalesce("_s", F.lit("no result"))}).drop("_ip", "_c", "_s")


def first_submissions(hashes: DataFrame, replies: DataFrame) -> DataFrame:
    """Adds ``vt_first`` and ``vt_last`` to hashes (replies: ``hash, first_submission, last_submission``)."""
    r = replies.groupBy("hash").agg(F.min("first_submission").alias("vt_first"), F.max("last_submission").alias("vt_last"))
    return hashes.join(r, "hash", "left")


def unknown_hashes(hashes: DataFrame, replies: DataFrame) -> DataFrame:
    return hashes.join(replies.select("hash"), "hash", "left_anti")


def hash_report(db: DataFrame, replies: DataFrame, require: bool = False, exclude: bool = False, types: DataFrame | None = None) -> DataFrame:
    """Hashes that are (``require``), or are not (``exclude``), known to the reputation source."""
    if require and exclude:
        raise ValueError("require and exclude exclude each other")
    if require or exclude:
        db = db.join(replies.select("hash"), "hash", "left_semi" if require else "left_anti")
    return db if types is None else db.join(types, "hash", "left")
