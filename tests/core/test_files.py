"""Files: what is written is read again, and what is broken goes to the quarantine."""

import gzip
import json

from pyspark.sql import functions as F

from duskwatch.plans import derived, queries
from duskwatch.sources import logs, sinks
from duskwatch.sources import schemas as S
from duskwatch.sources.schemas import PACKET_COLUMNS

HEADER = "|".join(PACKET_COLUMNS)
GOOD = "1700000000123|1.2.3.4|44.0.0.1|54321|231|tcp|1000|23|0|77|mss:sack|6869|1|0|0|0|1024|true|tcp-synack|9|78|0|1"
PLAIN = "1700000000124|1.2.3.5|44.0.0.1|7|64|tcp|1000|23|0|77||  |1|0|0|0|1024|false|||||".replace("|  |", "||")
UDP = "1700000000125|1.2.3.6|44.0.0.1|7|64|udp|53|54|0|0|6869|0|0|0|0|0|false|||||"
BAD = ["1700000000126|1.2.3|44.0.0.1|7|64|tcp|1|2|0|0|||1|0|0|0|0|false|||||", "half a li", GOOD.replace("|231|", "|999|")]


def test_packet_log(spark, tmp_path):
    name = "2023-11-14.22-00-00.here.prog.tcp.raw.1699999200.csv"
    (tmp_path / name).write_text("\n".join([HEADER, GOOD, PLAIN, UDP, *BAD]) + "\n")
    with gzip.open(tmp_path / "2023-11-14.23-00-00.here.prog.tcp.raw.1700002800.csv.gz", "wt") as f:
        f.write(HEADER + "\n" + GOOD + "\n")
    good, bad = logs.read_packets(spark, str(tmp_path))
    rows = good.where("log_hour_ms = 1699999200000").orderBy("ts_ms").collect()
    assert [r["proto"] for r in rows] == ["tcp", "tcp", "udp"] and good.count() == 4
    assert (rows[0]["saddr"], rows[0]["userid"], rows[0]["options"], rows[0]["log_tag"]) == (16909060, 9, "mss:sack", "here")
    assert rows[1]["method"] is None and (rows[2]["options"], rows[2]["payload"]) == ("", "6869")
    assert sorted(r["problem"] for r in bad.collect()) == ["number of fields", "saddr", "ttl"]
    assert logs.read_packets(spark, str(tmp_path), start_ms=1700002800000)[0].count() == 1
    assert logs.read_packets(spark, str(tmp_path), tag="other")[0].count() == 0


def test_packet_log_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("\n".join([HEADER, GOOD, PLAIN]) + "\n")
    good, _ = logs.read_packets(spark, str(tmp_path / "in"))
    sinks.write_packet_log(good, str(tmp_path / "out"))
    again, bad = logs.read_packets(spark, str(tmp_path / "out"), recursiveFileLookup="true")
    drop = ("log_tag", "log_hour_ms")
    assert bad.count() == 0 and sorted(map(tuple, good.drop(*drop).collect())) == sorted(map(tuple, again.drop(*drop).collect()))


def test_a_large_hour_of_one_task_is_written_by_several(spark, tmp_path):
    """The files of an hour follow its size, not the number of tasks that its rows come from."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("\n".join([HEADER, GOOD, PLAIN, UDP]) + "\n")
    k = F.col("k")
    rows = spark.range(0, 60_000, 1, 1).withColumnRenamed("id", "k").crossJoin(F.broadcast(logs.read_packets(spark, str(tmp_path / "in"))[0].where("userid = 9")))
    packets = rows.withColumns({"ts_ms": H0 + k, "snum": k * 7919, "anum": k * 104_729 % 2**32}).drop("k")
    sizes = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for size in sizes:
        spark.conf.set(size, "100k")
    try:
        sinks.write_packet_log(packets, str(tmp_path / "log"))
    finally:
        for size in sizes:
            spark.conf.unset(size)
    assert [f.name for f in tmp_path.glob("log/date=*/hour=*")] == ["hour=00"] and len(list(tmp_path.glob("log/date=*/hour=*/*.csv.gz"))) > 1
    good, bad = logs.read_packets(spark, str(tmp_path / "log"))
    columns = [c for c in good.columns if not c.startswith("log_")]
    assert bad.count() == 0 and good.count() == 60_000 and good.select(columns).exceptAll(packets.select(columns)).count() == 0


def test_a_line_is_split_once(spark, tmp_path):
    """The condition on the problem holds no copy of the splitting and the casts."""
    (tmp_path / "a.csv").write_text("\n".join([HEADER, GOOD, PLAIN, UDP, *BAD]) + "\n")
    good, bad = logs.read_packets(spark, str(tmp_path))
    for rows, n in ((good, 3), (bad, 3)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"split(value#") == 1 and rows.count() == n


def scans(df):
    """Files that each scan opens, and the plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    opened, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        if "FileSourceScanExec" in node.getClass().getName():
            opened.append(node.metrics().apply("numFiles").value())
        if hasattr(node, "children"):
            nodes = node.children()
            waiting += [nodes.apply(k) for k in range(nodes.size())]
        if "AdaptiveSparkPlanExec" in node.getClass().getName():
            waiting.append(node.executedPlan())
    return opened, text


H0 = 1_700_006_400_000


def test_ranges_of_own_hour_folders(spark, tmp_path):
    """No row of a range is lost, whatever the layout, and what is outside is not opened."""
    h = 3_600_000
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("\n".join([HEADER, *[GOOD.replace("1700000000123", str(H0 + k * h // 2)) for k in range(96)]]) + "\n")
    packets, _ = logs.read_packets(spark, str(tmp_path / "in"))
    assert packets.count() == 96
    log = str(tmp_path / "log")
    sinks.write_packet_log(packets, log)
    assert logs.read_packets(spark, log, H0, H0 + 48 * h)[0].count() == 96 and logs.read_packets(spark, log)[0].count() == 96
    got, bad = logs.read_packets(spark, log, H0 + 10 * h + 5, H0 + 13 * h)
    opened, plan = scans(got)
    assert sorted(r["ts_ms"] for r in got.collect()) == [H0 + k * h // 2 for k in range(20, 26)] and bad.count() == 0
    assert "PartitionFilters: [" in plan and "hour#" in plan.split("PartitionFilters: [")[1].split("]")[0] and opened == [3]
    for start, end, n in ((H0 + 47 * h, None, 2), (None, H0 + h + 1, 4), (H0 - 99 * h, H0, 0), (H0 + 48 * h, None, 0), (H0 + 23 * h, H0 + 25 * h, 4)):
        assert logs.read_packets(spark, log, start, end)[0].count() == n
    assert logs.read_packets(spark, log, proto="tcp")[0].count() == 96 and logs.read_packets(spark, log, proto="udp")[0].count() == 0
    good, bad = logs.read_packets(spark, log, H0, H0 + h, tag="here")
    assert good.count() == 0 and [r["problem"] for r in bad.collect()] == ["no tag"] * 2


def test_ranges_of_named_other_and_tagged_files(spark, tmp_path):
    h = 3_600_000
    at = lambda k: GOOD.replace("1700000000123", str(H0 + k * h))
    for k in range(5):
        (tmp_path / f"2023-11-15.{k:02d}-00-00.here.prog.tcp.raw.{H0 // 1000 + k * 3600}.csv").write_text("\n".join([HEADER, at(k)]) + "\n")
    (tmp_path / "other.csv").write_text("\n".join([HEADER, at(1), at(9), BAD[0]]) + "\n")
    packets, _ = logs.read_packets(spark, str(tmp_path / "other.csv"))
    sinks.write_packet_log(packets, str(tmp_path), mode="append", tag=F.lit("there"))
    good, bad = logs.read_packets(spark, str(tmp_path), H0 + h, H0 + 3 * h)
    assert sorted(scans(good)[0]) == [1, 3] and [r["problem"] for r in bad.collect()] == ["saddr"]
    assert sorted(((r["ts_ms"] - H0) // h, r["log_tag"] or "") for r in good.collect()) == [(1, ""), (1, "here"), (1, "there"), (2, "here")]
    good, bad = logs.read_packets(spark, str(tmp_path), H0 + h, tag="there")
    assert sorted((r["ts_ms"] - H0) // h for r in good.collect()) == [1, 9] and sorted(r["problem"] for r in bad.collect()) == ["no tag", "no tag", "saddr"]
    assert logs.read_packets(spark, str(tmp_path))[0].count() == 9


def test_confirmations_and_legacy(spark, tmp_path):
    (tmp_path / "c.csv").write_text("start sec|start usec|method|userid|num probes|saddr|daddr|sport|dport\n1700000000|123456|tcp-synack|9|1|44.0.0.1|1.2.3.4|23|1000\nx|1|a|b|c|d|e|f|g\n")
    good, bad = logs.read_confirmations(spark, str(tmp_path / "c.csv"))
    assert good.first()["ts_ms"] == 1700000000123 and bad.count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"sport": 23, "dport": 1000, "src": "44.0.0.1", "dst": "1.2.3.4", "userid": 9, "method": "tcp-synack", "start": {"sec": 1700000000, "usec": 123456}}) + "\n" + json.dumps({"sport": 1, "dport": 2, "src": "1.1.1.1", "dst": "2.2.2.2", "userid": 3, "method": "udp", "timestamp": 7}) + '\n{"src": "x"}\nbroken\n')
    good, bad = logs.read_json_confirmations(spark, str(tmp_path / "c.json"))
    assert sorted(r["ts_ms"] for r in good.collect()) == [7000, 1700000000123] and bad.count() == 2
    good, bad = logs.read_rows(spark, str(tmp_path / "c.csv"), S.CONFIRMATION_COLUMNS, lambda f: {"sec": F.get(f, F.lit(0)).try_cast("bigint"), "kind": F.get(f, F.lit(2))}, ("sec",))
    assert [tuple(r) for r in good.collect()] == [(1700000000, "tcp-synack")] and bad.count() == 1
    assert [(r["file"], r["n"]) for r in logs.count_rows(spark, str(tmp_path / "c.csv")).collect()] == [("c.csv", 3)]
    line = {"trigger": {"saddr": "1.2.3.4", "daddr": "44.0.0.1", "ipid": 1, "ttl": 64, "observed": 5, "protocol": "tcp", "tcp": {"sport": 1, "dport": 2, "snum": 3, "anum": 0, "window_size": 1, "flags": {"syn": True}, "options": {"mss": None}, "payload": ""}}, "reaction": None}
    (tmp_path / "l.json").write_text(json.dumps(line) + "\n{broken\n")
    good, bad = logs.read_legacy(spark, str(tmp_path / "l.json"))
    assert (good.first()["syn"], good.first()["options"]) == (1, "mss") and bad.count() == 1


def test_lookup_files(spark, tmp_path):
    (tmp_path / "ips.alpha.txt").write_text("1.2.3.4\n1.2.3.4\nbad\n")
    assert [(r["tag"], r["ip"]) for r in logs.read_scanner_lists(spark, f"{tmp_path}/ips.*.txt")[0].collect()] == [("alpha", 16909060)]
    assert [r["value"] for r in logs.read_scanner_lists(spark, f"{tmp_path}/ips.*.txt")[1].collect()] == ["bad"]
    (tmp_path / "p.tsv").write_text("; comment\n1.2.0.0/16\t7\n1.2.0.0/99\t7\nx\n")
    good, bad = logs.read_prefixes(spark, f"{tmp_path}/p.tsv")
    assert [r["asn"] for r in good.collect()] == [7] and sorted(r["value"] for r in bad.collect()) == ["1.2.0.0/99\t7", "x"]
    (tmp_path / "g.csv").write_text("prefix|country_code|region_code|continent_code|city\n1.2.0.0/16|DE|HH|EU|H\n1.2|DE|HH|EU|H\n")
    good, bad = logs.read_geo(spark, f"{tmp_path}/g.csv")
    assert [r["city"] for r in good.collect()] == ["H"] and bad.first()["value"].startswith("1.2|")
    (tmp_path / "abc").mkdir()
    with gzip.open(tmp_path / "abc/downloads.csv.gz", "wt") as f:
        f.write("name|url|timestamp|server|tag\nn|u|1|s|t\n")
    assert logs.read_downloads(spark, f"{tmp_path}/*/downloads.csv.gz").first()["hash"] == "abc"
    with gzip.open(tmp_path / "ff.json.gz", "wt") as f:
        f.write(json.dumps({"data": [{"attributes": {"first_submission_date": 5}}]}) + "\n")
    assert tuple(logs.read_reputation_replies(spark, f"{tmp_path}/ff.json.gz").first()) == ("ff", 5, None)
    (tmp_path / "db.json").write_text(json.dumps({"h": {"first": {"own": 1, "vt": 2}, "last": {"own": 3}}}))
    assert logs.read_hash_database(spark, f"{tmp_path}/db.json").first()["first"]["vt"] == 2
    (tmp_path / "t.txt").write_text("# c\n1.2.3.4,5.6.7.8,1,2,aa\nbad\n1.2.3.4,5.6.7.8,1,99999,aa\n")
    good, bad = logs.read_targets(spark, f"{tmp_path}/t.txt")
    assert good.count() == 1 and sorted(r["value"] for r in bad.collect()) == ["1.2.3.4,5.6.7.8,1,99999,aa", "bad"]


def test_object_store_layout(spark, tmp_path):
    d = tmp_path / "datasource=a/protocol=tcp/type=raw/year=2023/month=11/day=14"
    d.mkdir(parents=True)
    (d / "x.csv").write_text(HEADER + "\n" + GOOD + "\n" + BAD[2] + "\n")
    got, bad = logs.read_partitioned(spark, str(tmp_path), protocol="tcp", day=14)
    assert [r["problem"] for r in bad.collect()] == ["ttl"]
    assert got.count() == 1 and "PartitionFilters: [isnotnull(protocol" in got._jdf.queryExecution().toString()


def test_event_json_round_trip(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    events = sinks.with_events(queries.shakes(spark, d), derived.packets(spark, d))
    sinks.write_handshakes(events, f"{tmp_path}/e")
    again = logs.read_handshakes(spark, f"{tmp_path}/e")
    assert again.count() == events.count()
    two = again.where("tag = 'two-phase'").first()
    assert two["isyn"]["trigger"]["payload"]["flags"] == ["syn"] and two["rack"] is not None
    assert 0 < logs.read_handshakes(spark, f"{tmp_path}/e", days=1).count() < events.count()


def test_small_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, 10), (1, 3_600_010), (2, 20), (3, 4 * 3_600_000), (4, 3_600_020)], "seq int, ts_ms long")
    kept, late = sinks.split_late(rows, "seq")
    assert sorted(r["seq"] for r in late.collect()) == [4] and kept.count() == 4
    assert sinks.annotated_path("a/x.csv.gz", "meta") == "a/x.meta.csv.gz" and sinks.annotated_path("a/y", "geo") == "a/y.geo"
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert sinks.cached(spark, f"{tmp_path}/c", make).count() == sinks.cached(spark, f"{tmp_path}/c", make).count() == 3 and len(made) == 1
    assert sinks.cached(spark, f"{tmp_path}/c", make, force=True).count() == 3 and len(made) == 2
    assert json.loads(sinks.kafka_rows(spark.range(1)).first()["value"]) == {"id": 0}
    texts = spark.createDataFrame([("wget http://a/b",), ("wget -q; curl",)], "t string")
    assert [r["t"] for r in sinks.unparsed_payloads(texts, "t").collect()] == ["wget -q; curl"]
    act = spark.createDataFrame([("", "srv", 0), ("n", "srv", 0)], "name string, server string, ts_ms long")
    sinks.write_activity(act, f"{tmp_path}/act")
    assert sorted(r["name_key"] for r in spark.read.option("header", True).csv(f"{tmp_path}/act").collect()) == ["n", "srv"]
    sinks.write_hashes(act.select(F.col("name").alias("hash")), act.select(F.col("name").alias("hash")), f"{tmp_path}/h")
    counts = spark.createDataFrame([(1, 0, 0, 1, 1, 0, 0, 0)], "all long, without_ack long, without_payload long, with_payload long, ascii long, hex long, downloader long, matched long")
    sinks.append_contact_types(counts, f"{tmp_path}/ct")
    sinks.append_contact_types(counts, f"{tmp_path}/ct")
    assert logs.read_contact_types(spark, f"{tmp_path}/ct").agg(F.sum("all")).first()[0] == 2


def test_two_hour_log(spark):
    """Rows in the order of arrival, by hour: what is older than the hour before the newest is late."""
    h = 3_600_000
    for hours, late in (([5, 5, 5], []), ([5, 6, 6], []), ([6, 5, 6, 5], []), ([5, 8, 7, 8], []), ([5, 8, 5], [2]), ([5, 7, 5, 6], [2]), ([3, 9, 8, 2, 9, 7], [3, 5]), ([9, 1, 9, 8], [1])):
        rows = spark.createDataFrame([(k, x * h + k) for k, x in enumerate(hours)] + [(len(hours), None)], "seq int, ts_ms long")
        for width in (1, 2, 1000):
            good, bad = sinks.split_late(rows, "seq", width=width)
            assert sorted(r["seq"] for r in bad.collect()) == late and good.count() == len(hours) + 1 - len(late)


def test_quarantines_of_events_downloads_replies_and_databases(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"ts": 5, "tag": "isyn"}\n{"ts": 5}\nhalf\n')
    good, bad = logs.sort_handshakes(spark, f"{tmp_path}/e.json")
    assert [r["tag"] for r in good.collect()] == ["isyn"] and sorted(r["value"] for r in bad.collect()) == ["half", '{"ts":5}']
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab/downloads.csv").write_text("name|url|timestamp|server|tag\nn|u|1|s|t\nn|u|x|s|t\nn|u|1|s\n")
    good, bad = logs.sort_downloads(spark, f"{tmp_path}/ab/downloads.csv")
    assert [(r["hash"], r["timestamp"]) for r in good.collect()] == [("ab", "1")] and sorted(r["value"] for r in bad.collect()) == ["n|u|1|s", "n|u|x|s|t"]
    (tmp_path / "h1.json").write_text('{"data": []}\n')
    (tmp_path / "h2.json").write_text('{"error": "quota"}\n')
    good, bad = logs.sort_reputation_replies(spark, f"{tmp_path}/h?.json")
    assert [tuple(r) for r in good.collect()] == [("h1", None, None)] and bad.count() == 1


def test_hash_databases_are_read_an_entry_a_row(spark, tmp_path):
    entries = {f"{k:064x}": {"first": {"own": k, "vt": 2}, "last": {"own": k + 3}} for k in range(300)}
    compact, spaced, broken = (tmp_path / n for n in ("a.json", "b.json", "c.json"))
    compact.write_text(json.dumps(entries))
    spaced.write_text(json.dumps(entries, indent=2))
    broken.write_text('{"x": {"first": {"own": 1}, "last": {"own": 2}}, "y": {"first": [1]}}, "z": {"first": {}, "last": {}}}')
    for path in (compact, spaced):
        good, bad = logs.sort_hash_database(spark, str(path))
        assert {r["hash"]: {"first": r["first"], "last": r["last"]} for r in good.collect()} == entries and bad.count() == 0
    pieces = spark.read.option("lineSep", "}}").text(str(compact)).count()
    assert pieces >= 300  # no cell holds the object
    good, bad = logs.sort_hash_database(spark, str(broken))
    assert sorted(r["hash"] for r in good.collect()) == ["x", "z"] and bad.count() == 1
    rows = spark.createDataFrame([('q"uo\\te', {"own": 1}, None), ("plain", {"own": 2, "vt": 3}, {"own": 4})], "hash string, first map<string,bigint>, last map<string,bigint>")
    sinks.write_hash_database(rows.repartition(3), f"{tmp_path}/db")
    assert sorted((r["hash"], r["first"], r["last"]) for r in logs.read_hash_database(spark, f"{tmp_path}/db").collect()) == [("plain", {"own": 2, "vt": 3}, {"own": 4}), ('q"uo\\te', {"own": 1}, {})]
    import glob

    whole = {}
    for part in glob.glob(f"{tmp_path}/db/part-*"):
        whole |= json.loads(open(part).read())
    assert whole.keys() == {"plain", 'q"uo\\te'}
