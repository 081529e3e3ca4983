"""Reports over handshakes: ports, contact types, payloads, catalogues, throttling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from duskwatch.functions import payload as pl
from duskwatch.functions.net import hour_ms
from duskwatch.operators.enrich import tag_known_scanners
from duskwatch.operators.ordered import flag_in_order

CATEGORIES = {"isyn": "isyn", "isyn (acked)": "isyn", "rsyn": "rsyn", "rsyn (acked)": "rsyn", "two-phase": "two-phase", "two-phase (no ack)": "two-phase"}


def with_category(handshakes: DataFrame) -> DataFrame:
    return handshakes.withColumn("category", F.when(F.col("tag").startswith("isyn"), "isyn").when(F.col("tag").startswith("rsyn"), "rsyn").otherwise("two-phase"))


def port_counts(handshakes: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """``category, port, n, share, n_ports``: events per port without known scanners, percent of
    the category (two places), and its number of ports."""
    events = tag_known_scanners(with_category(handshakes), "saddr", lists).where("project = 'unknown'")
    counts = events.groupBy("category", F.col("dport").alias("port")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("category")
    return counts.select("*", F.round(F.col("n") * 100 / F.sum("n").over(own), 2).alias("share"), F.count(F.lit(1)).over(own).alias("n_ports"))


def known_scanner_counts(handshakes: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    tagged = tag_known_scanners(with_category(handshakes), "saddr", lists)
    return tagged.groupBy("category").agg(F.count_if(F.col("project") != "unknown").alias("known"), F.count(F.lit(1)).alias("events"))


def top_ports(counts: DataFrame, n: int = 25) -> DataFrame:
    """The n ports of most events per category; ties by port."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "port"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def ports_in_order(counts: DataFrame) -> DataFrame:
    """The port table ordered by category and port."""
    return counts.orderBy("category", "port")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a defined order."""
    return df.orderBy(*order).limit(n)


def progress(df: DataFrame, name: str, **counters) -> tuple[DataFrame, Observation | None]:
    """The rows, and counters that are filled while they are consumed: ``rows`` and one for each condition given.

    The counters are read from ``observation.get`` after an action; a stream has no observation but reports
    them with each batch (``flows.progress_of``).
    """
    seen = None if df.isStreaming else Observation(name)
    return df.observe(seen or name, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counters.items()]), seen


def share_curve(counts: DataFrame, n: int = 25) -> DataFrame:
    """``category, rank, share`` for ranks 1..n, 0 beyond the last port."""
    top = top_ports(counts, n).select("category", "rank", "share")
    ranks = counts.select("category").distinct().select("category", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"))
    return ranks.join(top, ["category", "rank"], "left").select("category", "rank", F.coalesce("share", F.lit(0.0)).alias("share"))


def recover_payloads(handshakes: DataFrame, packets: DataFrame, same_hour: bool = False) -> DataFrame:
    """Two-phase events with ``rack_payload`` filled from raw ACKs of the same flow and sequence number.

    The raw ACKs are the non-empty ones; the first of a flow and number counts, and serves the first
    event that lacks a payload.  ``matched`` tells where that happened.  With ``same_hour`` an event
    takes raw ACKs of its own hour's log only.
    """
    return _recovered(handshakes.where("tag = 'two-phase'"), packets, same_hour)


def _recovered(events: DataFrame, packets: DataFrame, same_hour: bool = False) -> DataFrame:
    flow = ["saddr", "daddr", "sport", "dport", "snum"]
    if same_hour:
        flow.append("_hour")
        packets, events = packets.withColumn("_hour", hour_ms("ts_ms")), events.withColumn("_hour", hour_ms("ts_ms"))
    raw = packets.where("ack = 1 and syn = 0 and payload <> ''").groupBy(*flow).agg(F.min_by("payload", F.struct("ts_ms", "step")).alias("raw"))
    raw = raw.select(*[F.col(c).alias(f"r_{c}") for c in flow], "raw")
    lacks = (F.col("tag") == "two-phase") & (F.col("rack_payload") == "")
    turn = F.row_number().over(Window.partitionBy("saddr", "daddr", "rack_sport", "dport", "rack_snum", "_lacks", *flow[5:]).orderBy("ts_ms", "rack"))
    lacking = events.withColumn("_lacks", F.coalesce(lacks, F.lit(False))).withColumn("_turn", F.when(F.col("_lacks"), turn))
    same = (F.col("saddr") == F.col("r_saddr")) & (F.col("daddr") == F.col("r_daddr")) & (F.col("rack_sport") == F.col("r_sport")) & (F.col("dport") == F.col("r_dport")) & (F.col("rack_snum") == F.col("r_snum")) & (F.col("_turn") == 1)
    same = same & (F.col("_hour") == F.col("r__hour")) if same_hour else same
    out = lacking.join(raw, same, "left").drop("_turn", "_lacks", "_hour", *[f"r_{c}" for c in flow])
    return out.withColumns({"matched": F.col("raw").isNotNull(), "rack_payload": F.coalesce("raw", "rack_payload")}).drop("raw")


def contact_types(handshakes: DataFrame, packets: DataFrame) -> DataFrame:
    """Counters per hour over two-phase events: all, without ACK, without and with payload, by kind, matched."""
    acked = F.col("tag") == "two-phase"
    loaded = acked & (F.col("rack_payload") != "")
    events = _recovered(handshakes.where("tag in ('two-phase', 'two-phase (no ack)')"), packets)
    events = events.select("ts_ms", F.when(loaded, pl.payload_kind("rack_payload")).alias("kind"), "matched", acked.alias("acked"), F.coalesce(loaded, F.lit(False)).alias("loaded"))
    n = lambda c, name: F.count_if(c).alias(name)
    return events.groupBy(hour_ms("ts_ms").alias("hour_ms")).agg(
        F.count(F.lit(1)).alias("all"), n(~F.col("acked"), "without_ack"), n(F.col("acked") & ~F.col("loaded"), "without_payload"), n(F.col("loaded"), "with_payload"),
        n(F.col("kind") == "ascii", "ascii"), n(F.col("kind") == "hex", "hex"), n(F.col("kind") == "downloader", "downloader"), n(F.col("matched"), "matched"),
    )


_COUNTERS = ("all", "without_ack", "without_payload", "with_payload", "ascii", "hex", "downloader", "matched")


def rollup_contact_types(df: DataFrame) -> DataFrame:
    """One row: sums, percent of all, and whether kinds and states add up."""
    s = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTERS])
    shares = [F.try_divide(F.col(c) * 100.0, F.col("all")).alias(f"{c}_pct") for c in _COUNTERS[1:]]
    kinds = (F.col("ascii") + F.col("hex") + F.col("downloader")) == F.col("with_payload")
    states = (F.col("without_ack") + F.col("without_payload") + F.col("with_payload")) == F.col("all")
    return s.select("*", *shares, kinds.alias("kinds_add_up"), states.alias("states_add_up"))


def filter_downloaders(handshakes: DataFrame) -> DataFrame:
    """Events whose payload (second phase first, else first phase) decodes and names a tool."""
    def check(c):
        text = pl.hex_to_text(c)
        return F.when((F.col(c) != "") & pl.tool_of(text).isNotNull(), F.struct(F.col(c).alias("payload"), pl.tool_of(text).alias("tool"), text.alias("decoded")))
    return handshakes.withColumn("_d", F.coalesce(check("rack_payload"), check("iack_payload"))).where("_d is not null").select("ts_ms", "tag", "saddr", "daddr", "dport", "_d.*")


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, missing, percent`` of each annotated column."""
    a = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)])
    return a.select("n", F.inline(rows)).select("field", "missing", F.try_divide(F.col("missing") * 100.0, F.col("n")).alias("percent"))


def hash_catalogue(downloads: DataFrame, content: str = "content") -> DataFrame:
    """Distinct contents by SHA-256 with first and last sighting and number of downloads."""
    return downloads.withColumn("hash", F.sha2(F.col(content).cast("binary"), 256)).groupBy("hash").agg(F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen"), F.count(F.lit(1)).alias("downloads"))


def hash_contents(downloads: DataFrame, content: str = "content") -> DataFrame:
    """``hash, content``: every distinct content once."""
    hashed = downloads.select(F.sha2(F.col(content).cast("binary"), 256).alias("hash"), F.col(content).alias("content"))
    return hashed.dropDuplicates(["hash"])


def hash_downloads(downloads: DataFrame, content: str = "content") -> DataFrame:
    """``hash, name, url, ts_ms, server, tag`` of every download: the list that belongs to each hash, as rows,
    since a frequent hash may have any number of them."""
    wanted = ("name", "url", "ts_ms", "server", "tag")
    return downloads.select(F.sha2(F.col(content).cast("binary"), 256).alias("hash"), *[F.col(c) if c in downloads.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def download_events(events: DataFrame, downloads: DataFrame, content: str = "content") -> DataFrame:
    """Events (``url, ts_ms, attempted``) with ``status, hash`` of their download (``url, ts_ms, status, content``).

    Both are null for events that were not attempted; the hash is null where a download brought nothing.
    """
    d = downloads.select(F.col("url").alias("_url"), F.col("ts_ms").alias("_ts"), F.col("status"), F.when(F.col(content).isNotNull(), F.sha2(F.col(content).cast("binary"), 256)).alias("hash"))
    same = (F.col("url") == F.col("_url")) & (F.col("ts_ms") == F.col("_ts")) & F.col("attempted")
    return events.join(d, same, "left").drop("_url", "_ts")


def activity(downloads: DataFrame) -> DataFrame:
    """Downloads per malware name (server where the name is empty) and month."""
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("server")).alias("name_key")
    return downloads.groupBy(name, F.date_format(F.timestamp_millis("ts_ms"), "yyyy.MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def throttle(df: DataFrame, key: str, ts: str = "ts_ms", every_ms: int = 3_600_000, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``attempted``: at least ``every_ms`` since the key's last attempt (not sighting).

    Rows of one time stand in the order of the ``ties`` columns. One pass over a key's rows in order keeps one number, the time of its last attempt.
    """

    def fold():
        last = None

        def step(row: tuple) -> bool:
            nonlocal last
            if row[0] is None or (last is not None and (row[0] == last or row[0] - last < every_ms)):
                return False
            last = row[0]
            return True

        return step

    tried = flag_in_order(df, [key], [ts, *ties], "attempted", fold)
    return tried.withColumn("attempted", F.col("attempted") & F.col(key).isNotNull())


def first_hours(df: DataFrame, hours: int, ts: str = "ts_ms") -> DataFrame:
    """Rows of the first ``hours`` hours that have any."""
    distinct = df.select(hour_ms(ts).alias("_h")).distinct().orderBy("_h").limit(hours)
    return df.withColumn("_h", hour_ms(ts)).join(distinct, "_h", "left_semi").drop("_h")


def pending(missing: DataFrame, budget: int, order: str = "first_missed") -> DataFrame:
    """The hashes to ask for next: 80 % of a budget of requests, longest missing first."""
    return missing.orderBy(order, "hash").limit(budget * 8 // 10)


def unanswered(asked: DataFrame, answered: DataFrame, column: str) -> DataFrame:
    """Distinct values asked for and not answered."""
    return asked.select(column).distinct().join(answered.select(column), column, "left_anti")
