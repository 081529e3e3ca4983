"""Streams give what the batch gives."""

import glob
import os
import time
import uuid

from pyspark.sql import functions as F

from duskwatch.operators import reaction, reports
from duskwatch.plans import derived, queries
from duskwatch.streaming import flows

D = "/root/testdata/sf0.001"


def run(spark, df, mode="append"):
    flows.typed_state(spark)
    name = f"t{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name).collect()


def as_stream(spark, df, path, ordered="ts_ms", files=3, last=None):
    """The rows as time-ordered files, and one more file whose rows push the watermark past all."""
    top = df.agg(F.max(ordered)).first()[0]
    df.orderBy(ordered).coalesce(1).write.option("maxRecordsPerFile", -(-df.count() // files)).parquet(path)
    for k, name in enumerate(sorted(glob.glob(f"{path}/part-*"), key=lambda f: f.rsplit("-c", 1)[1])):
        os.utime(name, (1_700_000_000 + k,) * 2)  # files are read in this order
    if last is not None:
        last(top).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_handshakes(spark, tmp_path):
    rows = queries.confirmed(spark, D).where("not retransmit").where("event_id < 150")
    want = sorted((r["tag"], r["isyn"], r["rsyn"], r["rack"]) for r in queries.handshakes.assemble_handshakes(rows).collect() if r["isyn"] is not None and r["rsyn"] is not None)

    def later(top):
        return rows.limit(1).withColumns({"ts_ms": F.lit(top + 40 * 3_600_000).cast("long"), "saddr": F.lit(99).cast(dict(rows.dtypes)["saddr"])})

    stream = flows.with_time(as_stream(spark, rows, f"{tmp_path}/p", last=later))
    got = run(spark, flows.handshakes(stream))
    assert sorted((r["tag"], r["isyn"], r["rsyn"], r["rack"]) for r in got if r["isyn"] is not None and r["rsyn"] is not None) == want and want


def test_handshakes_of_a_contended_hour(spark, tmp_path):
    """The stream and the batch agree where phases contend, and a batch writes back what it changed."""
    p = derived.busy_packets(spark, D)
    rows = queries.matching.match_confirmations(queries.matching.flag_retransmits(p, ("ts_ms", "step")), derived.busy_confirmations(p)).where("not retransmit")
    columns = ["tag", "repeated", "isyn", "iack", "rsyn", "rack", "repeat_of"]
    want = sorted((tuple(r[c] for c in columns) for r in queries.handshakes.assemble_handshakes(rows).collect()), key=str)

    def later(top):
        return rows.where("rst = 0 and syn = 1").limit(1).withColumns({"ts_ms": F.lit(top + 40 * 3_600_000).cast("long"), "saddr": F.lit(99).cast(dict(rows.dtypes)["saddr"])})

    stream = flows.with_time(as_stream(spark, rows, f"{tmp_path}/p", files=4, last=later))
    got = [tuple(r[c] for c in columns) for r in run(spark, flows.handshakes(stream)) if r["saddr"] != 99]
    assert sorted(got, key=str) == want and len({g[0] for g in want}) == 6


def test_state_of_phases_is_written_as_it_changes():
    """Of a key with many open phases, one more packet writes one phase."""

    class Kept(dict):
        writes = 0

        def iterator(self):
            return iter(self.items())

        def updateValue(self, k, v):  # noqa: N802
            Kept.writes += 1
            self[k] = v

        def removeKey(self, k):  # noqa: N802
            del self[k]

    class One(list):
        exists = lambda self: bool(self)
        get = lambda self: self[0]
        update = lambda self, v: self.__setitem__(slice(None), [v])

    state = flows.OpenPhases(600)
    timers = set()
    state.phases, state.acks, state.count = Kept(), Kept(), One()
    state.handle = type("H", (), {"registerTimer": lambda self, at: timers.add(at)})()
    clock = type("T", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    row = lambda k, kind, ts, sport, snum: (1, 2, 80, ts, k, sport, snum, 0, 7, k, kind, snum + 1 if kind != "ack" else 0, ts + 5 if kind != "ack" else None, "")
    feed = lambda *rows: list(state.handleInputRows((1, 2, 80), iter([flows.pd.DataFrame(rows, columns=queries.handshakes.NEEDED)]), clock))
    feed(*[row(k, "isyn", 1000 + k, 100 + k, k) for k in range(300)])
    assert Kept.writes == 300 and timers == {5_400_000}
    Kept.writes = 0
    feed(row(300, "ack", 5000, 107, 8))
    assert Kept.writes == 1 and state.phases[7,][13] is not None
    feed(row(301, "ack", 5001, 999, 8), row(302, "rsyn", 6000, 9, 9))
    assert Kept.writes == 4 and len(state.acks) == 1
    clock.getCurrentWatermarkInMs = lambda: 5_400_000
    tags = [t for pdf in state.handleExpiredTimer((1, 2, 80), clock, None) for t in pdf["tag"]]
    assert sorted(set(tags)) == ["isyn", "isyn (acked)", "two-phase (no ack)"] and len(tags) == 300 and not state.phases and not state.acks


def test_retransmits_across_hour_edges(spark, tmp_path):
    h, h0 = 3_600_000, 1_700_006_400_000
    at = [(1, 0), (1, 5), (1, h + 10), (2, 7), (2, h + h // 2), (2, h + h // 2 + 5), (3, h // 2), (3, h + h // 2 - 1), (3, 2 * h + h // 2 - 1), (3, 3 * h + h // 2), (4, 9), (4, 2 * h + 9), (4, 2 * h + 10)]
    rows = spark.createDataFrame([(k, 1, 2, s, 4, 5, 0, h0 + t) for k, (s, t) in enumerate(at)] + [(99, 1, 2, 1, 4, 5, 1, h0 + 3 * h)], "step int, saddr long, daddr long, sport int, dport int, snum long, rst int, ts_ms long")
    want = sorted((r["step"], r["retransmit"]) for r in queries.matching.flag_retransmits(rows, ("ts_ms", "step")).collect())
    for files in (1, 5, 14):
        stream = flows.with_time(as_stream(spark, rows, f"{tmp_path}/r{files}", files=files))
        assert sorted((r["step"], r["retransmit"]) for r in run(spark, flows.flagged_retransmits(stream))) == want
    assert [s for s, again in want if again] == [1, 2, 5, 7, 8, 12]
    p = derived.busy_packets(spark, D)
    want = sorted((r["userid"], r["retransmit"]) for r in queries.matching.flag_retransmits(p, ("ts_ms", "step")).collect())
    stream = flows.with_time(as_stream(spark, p, f"{tmp_path}/busy", files=3))
    assert sorted((r["userid"], r["retransmit"]) for r in run(spark, flows.flagged_retransmits(stream))) == want


def test_throttle(spark, tmp_path):
    e = derived.read(spark, D, "events").select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    want = sorted((r["key"], r["ts_ms"], r["attempted"]) for r in reports.throttle(e, "key").collect())
    got = run(spark, flows.throttled(flows.with_time(as_stream(spark, e, f"{tmp_path}/e"), "1 day"), "key"))
    assert sorted((r["key"], r["ts_ms"], r["attempted"]) for r in got) == want


def test_confirmations_unique_packets_and_rates(spark, tmp_path):
    p = derived.packets(spark, D).where("event_id < 200")
    c = derived.confirmations(p)
    ps, cs = as_stream(spark, p, f"{tmp_path}/p", files=2), as_stream(spark, c, f"{tmp_path}/c", files=2)
    got = run(spark, flows.confirmed(ps, cs, delay="60 days").select("userid", "con_ms"))
    assert sorted((r["userid"], r["con_ms"]) for r in got) == sorted((r["userid"], r["con_ms"]) for r in queries.matching.match_confirmations(p, c).collect())
    # Unprobed packets stay, and a confirmation that is repeated does not double its packet.
    some = p.withColumn("method", F.when(F.col("event_id") % 3 > 0, F.col("method")))
    twice = c.unionByName(c.withColumn("ts_ms", F.col("ts_ms") + 7))
    got = run(spark, flows.confirmed(as_stream(spark, some, f"{tmp_path}/p2", files=2), as_stream(spark, twice, f"{tmp_path}/c2", files=2), delay="60 days").select("userid", "method", "con_ms"))
    want = queries.matching.match_confirmations(some, twice).collect()
    assert sorted((r["userid"], r["method"] is None, r["con_ms"] or 0) for r in got) == sorted((r["userid"], r["method"] is None, r["con_ms"] or 0) for r in want)
    unique = run(spark, flows.unique_packets(as_stream(spark, p, f"{tmp_path}/u", files=1), "60 days").select("saddr"))
    assert len(unique) == p.select("saddr", "daddr", "sport", "dport", "snum").distinct().count()
    counted = p.withColumn("num_probes", F.lit(1))
    rates = run(spark, flows.rates(flows.with_time(as_stream(spark, counted, f"{tmp_path}/r", files=1)), "1 hour"), "complete")
    assert sum(r["requests"] for r in rates) == p.count()


def test_messages_and_hour_log(spark, tmp_path):
    messages = spark.createDataFrame([('{"a": 1}',), ("broken",)], "value string")
    assert [r["a"] for r in flows.json_values(messages, "a int").where("a is not null").collect()] == [1]
    h = 3_600_000
    first = spark.createDataFrame([(10 * h,), (9 * h,)], "ts_ms long")
    first.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts_ms long").parquet(f"{tmp_path}/in")
    q = flows.log_by_hour(stream, f"{tmp_path}/log", f"{tmp_path}/late", f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    spark.createDataFrame([(8 * h,), (11 * h,)], "ts_ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = flows.log_by_hour(stream, f"{tmp_path}/log", f"{tmp_path}/late", f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    assert sorted(r["ts_ms"] for r in spark.read.parquet(f"{tmp_path}/late").collect()) == [8 * h]
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3


def test_hour_log_by_arrival_and_repeated_batches(spark, tmp_path):
    h = 3_600_000
    rows = [(1, 10 * h), (2, 12 * h), (3, 10 * h + 5), (4, 11 * h), (5, 14 * h), (6, 12 * h)]
    spark.createDataFrame(rows, "seq long, ts_ms long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq long, ts_ms long").parquet(f"{tmp_path}/in")
    for checkpoint in ("a", "b"):  # a lost checkpoint repeats the batch, which replaces what it wrote
        q = flows.log_by_hour(stream, f"{tmp_path}/log", f"{tmp_path}/late", f"{tmp_path}/{checkpoint}", arrival="seq")
        q.processAllAvailable()
        q.stop()
        kept, late = (sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/{x}").collect()) for x in ("log", "late"))
        assert (kept, late) == ([1, 2, 4, 5], [3, 6]) if checkpoint == "a" else set(kept) | set(late) == {1, 2, 3, 4, 5, 6}


def pushed(spark, df, path, **other):
    """A stream of the rows, with a last one far in the future, on keys of its own."""

    def later(top):
        return df.limit(1).withColumns({"ts_ms": F.lit(top + 40 * 3_600_000).cast("long"), **other})

    return flows.with_time(as_stream(spark, df, path, last=later))


def test_probes_in_flight_and_pauses(spark, tmp_path):
    p = derived.busy_packets(spark, D)
    syn = F.col("kind").isin("isyn", "rsyn")
    probes = p.where(syn).select(F.col("userid").alias("probe_id"), F.col("saddr").alias("addr"), F.lit(53).alias("port"), "ts_ms")
    got = p.where(~syn).select(F.when(F.col("event_id") % 5 == 0, "icmp").otherwise("udp").alias("proto"), "saddr", F.lit(53).alias("sport"), "ts_ms")
    want = sorted(tuple(r) for r in reaction.udp_outcomes(probes, got).collect())
    events = reaction.probe_events(probes, got)
    stream = pushed(spark, events, f"{tmp_path}/o", addr=F.lit(-1).cast("long"), proto=F.lit("udp"))
    out = run(spark, flows.udp_outcomes(stream))
    assert sorted((r["probe_id"], r["outcome"]) for r in out) == want and len({o for _, o in want}) == 3
    want = sorted(tuple(r) for r in reaction.udp_probing(probes, got).collect())
    assert sorted(tuple(r) for r in run(spark, flows.udp_probing(stream))) == want and sum(w == "send" for _, w, _ in want) > len({i for i, _, _ in want})

    asked = p.where(syn).select("userid", F.col("saddr").alias("daddr"), (F.col("kind") == "isyn").alias("irregular"), "ts_ms")
    replies = p.where(syn & (F.col("event_id") % 7 > 0)).select("userid", (F.col("ts_ms") + 5000).alias("ts_ms"))
    want = sorted((r["userid"], r["suppressed"]) for r in reaction.suppress_in_flight(asked, replies).collect())
    events = asked.withColumn("is_reply", F.lit(False)).unionByName(asked.drop("ts_ms").join(replies, "userid").withColumn("is_reply", F.lit(True)).select("userid", "daddr", "irregular", "ts_ms", "is_reply"))
    out = run(spark, flows.in_flight(pushed(spark, events, f"{tmp_path}/f", daddr=F.lit(-1).cast("long"), is_reply=F.lit(True)), forget_ms=10**9))
    assert sorted((r["userid"], r["suppressed"]) for r in out) == want and len({s for _, s in want}) == 2

    rst = p.where("method = 'tcp-rst'").select("userid", "saddr", "sport", "ts_ms")
    want = sorted((r["userid"], r["logged"]) for r in reaction.dedupe_rst(rst).collect())
    out = run(spark, flows.dedupe_rst(flows.with_time(as_stream(spark, rst, f"{tmp_path}/r"), "1 day")))
    assert sorted((r["userid"], r["logged"]) for r in out) == want


def test_entries_age(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("b", 50), ("a", 1000), ("c", 900_000)], "addr string, ts_ms long")
    out = run(spark, flows.aged(flows.with_time(as_stream(spark, rows, f"{tmp_path}/s", files=4), "1 second"), 10_000))
    assert sorted((r["addr"], r["ts_ms"]) for r in out) == [("a", 1000), ("b", 50)]


def test_chained_query_and_its_counters(spark, tmp_path):
    rows = queries.confirmed(spark, D).where("not retransmit").where("event_id < 80")

    def later(top):
        return rows.limit(1).withColumns({"ts_ms": F.lit(top + 40 * 3_600_000).cast("long"), "saddr": F.lit(99).cast(dict(rows.dtypes)["saddr"])})

    seen = {"events": [], "urls": []}

    def sink(events, urls, number):
        seen["events"] += [(r["tag"], r["isyn"], r["rsyn"]) for r in events.collect()]
        seen["urls"] += [r["url"] for r in urls.collect()]

    q = flows.chain(flows.with_time(as_stream(spark, rows, f"{tmp_path}/c", last=later)), sink, f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    batch = queries.handshakes.assemble_handshakes(rows)
    assert sorted(seen["events"], key=str) == sorted(((r["tag"], r["isyn"], r["rsyn"]) for r in batch.collect()), key=str)
    assert sorted(seen["urls"]) == sorted(r["url"] for r in flows.downloader_urls(batch).collect()) != []
    counted, _ = reports.progress(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/c"), "packets", syns=F.col("syn") == 1)
    q = counted.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert flows.progress_of(q)["packets"]["rows"] == rows.count() + 1


def test_counters_add_up_over_batches_and_restarts(spark, tmp_path):
    """What is consumed is produced or rejected."""
    flows.typed_state(spark)
    listener = flows.ProgressTotals(spark, f"{tmp_path}/totals")
    spark.streams.addListener(listener)
    try:
        rows = [spark.range(k * 100, k * 100 + 100).withColumn("ts_ms", F.col("id")) for k in range(4)]
        ids = set()
        for part in (rows[:2], rows[2:]):
            for df in part:
                df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            counted, _ = reports.progress(spark.readStream.schema("id long, ts_ms long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "filter", produced=F.col("id") % 3 == 0, rejected=F.col("id") % 3 > 0)
            q = counted.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ck").start()
            q.processAllAvailable()
            q.stop()
            ids.add(str(q.id))
        (query_id,) = ids
        for _ in range(100):  # events come a little later
            own = flows.ProgressTotals(spark, f"{tmp_path}/totals").totals(query_id).get("filter", {})
            if own.get("rows") == 400:
                break
            time.sleep(0.2)
        assert own == {"rows": 400, "produced": 134, "rejected": 266}
        # An event that comes again counts once.
        progress = type("P", (), {"id": query_id, "batchId": 0, "observedMetrics": {"filter": None}})
        listener.onQueryProgress(type("E", (), {"progress": progress}))
        assert listener.totals(query_id)["filter"] == own
    finally:
        spark.streams.removeListener(listener)


def in_turns(spark, frames, path):
    for k, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{path}/{k}")
        for name in glob.glob(f"{path}/{k}/*.parquet"):
            os.utime(name, (1_700_000_000 + k,) * 2)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_a_slower_input_holds_the_join_back(spark, tmp_path):
    """One side is read hours ahead of the other: no row is lost, and the state goes once both have passed."""
    minute, t0 = 60_000, 1_700_006_400_000
    packet = "userid long, method string, saddr long, daddr long, sport int, dport int, ts_ms long, step int"
    p_of = lambda minutes: spark.createDataFrame([(m, "tcp-synack", 1, 2, 3, 4, t0 + m * minute, 0) for m in minutes], packet)
    c_of = lambda minutes: spark.createDataFrame([(m, "tcp-synack", 2, 1, 4, 3, t0 + m * minute + 500) for m in minutes], "userid long, method string, saddr long, daddr long, sport int, dport int, ts_ms long")
    end = 2000
    ahead = [p_of(range(0, 20)), p_of(range(20, 140)), p_of(range(140, 260)), p_of([end])]
    behind = [c_of(range(0, 5)), c_of(range(5, 20)), c_of(range(20, 40)), *[c_of(range(k, k + 40)) for k in range(40, 240, 40)], c_of(range(240, 260)), c_of([end]), c_of([end + 1])]
    seen = []
    for policy in ("min", "max"):
        df = flows.confirmed(in_turns(spark, ahead, f"{tmp_path}/p-{policy}"), in_turns(spark, behind, f"{tmp_path}/c-{policy}")).select("userid", "con_ms")
        assert spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy") == "min"
        spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", policy)
        q = df.writeStream.format("memory").queryName(f"aligned_{policy}").option("checkpointLocation", f"{tmp_path}/ck-{policy}").start()
        q.processAllAvailable()
        seen.append(sorted(r["userid"] for r in spark.table(f"aligned_{policy}").collect()))
        states = max(o.numRowsTotal for o in q.lastProgress.stateOperators)
        q.stop()
        if policy == "min":
            assert states < 30
    flows.align(spark)
    assert seen[0] == [*range(260), end] and len(seen[1]) < 200
