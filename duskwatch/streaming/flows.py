"""Continuous versions: the same row logic, with watermarks and keyed state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from duskwatch.functions import payload as pl
from duskwatch.functions.net import hour_ms
from duskwatch.operators.handshakes import KEYS, RESULT, Fold, Packet, closing, events_of, frame, rows_of
from duskwatch.operators.reaction import RESEND_MS, Probes
from duskwatch.sources import folders
from duskwatch.sources.sinks import split_late


def read_topics(spark: SparkSession, topics: list[str], servers: str, schema: str, **options) -> DataFrame:
    """Rows of JSON messages of several topics; offsets are kept by the query's checkpoint."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).options(**options).load()
    return json_values(raw, schema)


def json_values(messages: DataFrame, schema: str) -> DataFrame:
    """``value`` (text or bytes) parsed by a schema; messages that do not parse are left out."""
    return messages.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).where("m is not null").select("m.*")


def with_time(df: DataFrame, delay: str = "30 minutes") -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)


def typed_state(spark: SparkSession) -> None:
    """Let the session's streams keep states of maps and lists and timers, which needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def flagged_retransmits(packets: DataFrame) -> DataFrame:
    """Adds ``retransmit`` to packets with the watermarked ``ts``, by the batch's rule (``matching.flag_retransmits``).

    State of a five-field key are two hours, the newest in which it was seen and whether it was seen in the one
    before; it is dropped when the newest can matter no more, half an hour after the next hour has begun.  Within a
    micro-batch rows count in order of time.  A row of the hour before the newest still counts in its own hour.
    """
    out = [f for f in packets.schema.fields if f.name != "ts"]
    names, kinds = [f.name for f in out], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    hour, half = 3_600_000, 1_800_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, before = state.get if state.exists else (None, False)
        rows = pd.concat(list(frames))
        rows = rows.sort_values([c for c in ("ts_ms", "step") if c in rows.columns], kind="stable")
        again = []
        for t in rows["ts_ms"].tolist():
            own, young = t - t % hour, t % hour < half
            if newest is None or own > newest + hour:
                again.append(False)
                newest, before = own, False
            elif own == newest + hour:
                again.append(young)
                newest, before = own, True
            elif own == newest:
                again.append(True)
            else:
                again.append(before and own == newest - hour)
                before = before or own == newest - hour
        state.update((int(newest), bool(before)))
        state.setTimeoutTimestamp(max(int(newest) + hour + half, state.getCurrentWatermarkMs() + 1))
        yield rows[names].assign(retransmit=again)

    others = packets.where("rst <> 1").groupBy("saddr", "daddr", "sport", "dport", "snum")
    flagged = others.applyInPandasWithState(step, f"{kinds}, retransmit boolean", "newest long, before boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return flagged.unionByName(packets.where("rst = 1").select(*names, F.lit(False).alias("retransmit")))


def unique_packets(packets: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """Packets without retransmits, as the batch removes them; RSTs all pass."""
    return flagged_retransmits(packets if "ts" in packets.columns else with_time(packets, delay)).where("not retransmit").drop("retransmit")


def align(spark: SparkSession) -> None:
    """Let a join of streams wait for its slower input: time goes on with the least of the inputs' watermarks.

    However far one input has been read ahead, its rows stay in the state until the other has come as far, and rows
    that both have passed by the delay are dropped.
    """
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")


def confirmed(packets: DataFrame, confs: DataFrame, delay: str = "30 minutes", timeout: str = "5 minutes") -> DataFrame:
    """Packets with ``con_ms``: probed ones by a stream-stream join with their confirmations, unprobed ones with null.

    A userid names one probe, so of repeated confirmations, and of repeated packets of one probe, the
    first within the watermark's delay counts and the join is one to one.  Probed packets without a
    confirmation are left out, as in the batch.
    """
    align(packets.sparkSession)
    keys = ["userid", "method", "saddr", "daddr", "sport", "dport"]
    packets = packets if "ts" in packets.columns else with_time(packets, delay)
    p = packets.where("method is not null").dropDuplicatesWithinWatermark(keys)
    c = with_time(confs, delay).dropDuplicatesWithinWatermark(keys).select(*[F.col(n).alias(f"c_{n}") for n in (*keys, "ts_ms", "ts")])
    near = F.expr(f"c_ts between ts - interval {timeout} and ts + interval {timeout}")
    same = F.expr("userid = c_userid and method = c_method and daddr = c_saddr and saddr = c_daddr and dport = c_sport and sport = c_dport")
    joined = p.join(c, same & near).withColumn("con_ms", F.col("c_ts_ms")).select(*packets.columns, "con_ms")
    return joined.unionByName(packets.where("method is null").withColumn("con_ms", F.lit(None).cast(packets.schema["ts_ms"].dataType)))


_KINDS = {"ts_ms": "long", "step": "int", "sport": "int", "snum": "long", "anum": "long", "ipid": "int", "userid": "long", "kind": "string", "probe_anum": "long", "con_ms": "long", "payload": "string"}
_FIELDS = list(_KINDS)


class OpenPhases(StatefulProcessor):
    """The batch's fold as keyed state: a map of open phases, one of waiting ACKs, and the count that numbers both.

    A micro-batch writes back only what it has changed.  A timer stands at each time at which an hour of the
    key closes.
    """

    def __init__(self, phase_timeout: int):
        self.phase_timeout = phase_timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        packet = lambda p: ", ".join(f"{p}_{c} {k}" for c, k in _KINDS.items())
        self.handle = handle
        self.phases = handle.getMapState("phases", "number long", f"role int, second long, {packet('syn')}, {packet('ack')}")
        self.acks = handle.getMapState("acks", "number long", packet("ack"))
        self.count = handle.getValueState("count", "n long")

    def _packet(self, key: tuple, values: tuple) -> Packet | None:
        own = dict(zip(_FIELDS, values))
        return None if own["kind"] is None else Packet(**dict(zip(KEYS, map(int, key))), **own)

    def _resume(self, key: tuple) -> tuple[Fold, dict, dict]:
        n = len(_FIELDS)
        phases = {k[0]: (v[0], v[1], self._packet(key, v[2 : 2 + n]), self._packet(key, v[2 + n :])) for k, v in self.phases.iterator()}
        acks = {k[0]: self._packet(key, v) for k, v in self.acks.iterator()}
        count = self.count.get()[0] if self.count.exists() else 0
        return Fold.resumed(phases, acks, count, self.phase_timeout), phases, acks

    def _keep(self, fold: Fold, phases: dict, acks: dict, watermark: int) -> None:
        plain = lambda p: (None,) * len(_FIELDS) if p is None else tuple(getattr(p, c) for c in _FIELDS)
        now, waiting, due = fold.phases(), dict(fold.waiting), set()
        for number, phase in now.items():
            if phases.get(number) != phase:
                self.phases.updateValue((number,), (*phase[:2], *plain(phase[2]), *plain(phase[3])))
                if number not in phases:
                    due.add(closing(phase[2].ts_ms))
        for number, ack in waiting.items():
            if number not in acks:
                self.acks.updateValue((number,), plain(ack))
                due.add(closing(ack.ts_ms))
        for state, gone in ((self.phases, phases.keys() - now.keys()), (self.acks, acks.keys() - waiting.keys())):
            for number in gone:
                state.removeKey((number,))
        if now or waiting:
            self.count.update((fold._count,))
        elif phases or acks:
            self.count.clear()
        for at in due:
            self.handle.registerTimer(max(at, watermark + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fold, phases, acks = self._resume(key)
        out = []
        for row in rows_of(pd.concat(list(rows)).sort_values(["ts_ms", "step"])):
            out += fold.close(row.ts_ms)
            fold.add(row)
        self._keep(fold, phases, acks, timerValues.getCurrentWatermarkInMs())
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold, phases, acks = self._resume(key)
        out = fold.close(timerValues.getCurrentWatermarkInMs())
        self._keep(fold, phases, acks, timerValues.getCurrentWatermarkInMs())
        yield frame(out)

    def close(self) -> None:
        pass


def handshakes(packets: DataFrame, phase_timeout: int = 600) -> DataFrame:
    """The batch fold over a stream of confirmed packets: state per key, events when their hour closes.

    ``packets`` carries the watermarked column ``ts``; rows of a micro-batch are sorted per key.  The session needs
    :func:`typed_state`.
    """
    return events_of(packets, "ts").groupBy("saddr", "daddr", "dport").transformWithStateInPandas(OpenPhases(phase_timeout), RESULT, "append", "eventTime")


def throttled(df: DataFrame, key: str, every_ms: int = 3_600_000) -> DataFrame:
    """Adds ``attempted``: state is the time of the key's last attempt, dropped after ``every_ms``.

    ``df`` has ``ts_ms`` and the watermarked ``ts``.
    """
    out = [f for f in df.schema.fields if f.name != "ts"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    names = [f.name for f in out]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts_ms", kind="stable")
        tried = []
        for t in rows["ts_ms"].tolist():
            yes = last is None or t - last >= every_ms
            last = t if yes else last
            tried.append(yes)
        state.update((int(last),))
        state.setTimeoutTimestamp(max(int(last) + every_ms, state.getCurrentWatermarkMs() + 1))
        yield rows[names].assign(attempted=tried)

    return df.groupBy(key).applyInPandasWithState(step, f"{kinds}, attempted boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def dedupe_rst(requests: DataFrame, pause_ms: int = 5000) -> DataFrame:
    """Adds ``logged`` to RST requests, as the batch does; ``requests`` has the watermarked ``ts``."""
    keyed = requests.withColumn("_key", F.concat_ws(":", F.col("saddr").cast("string"), F.col("sport").cast("string")))
    return throttled(keyed, "_key", pause_ms).withColumnRenamed("attempted", "logged").drop("_key")


def in_flight(events: DataFrame, forget_ms: int = 3_600_000) -> DataFrame:
    """``userid, suppressed`` of each request: whether a probe to its (daddr, irregular) is unanswered.

    ``events`` are requests and replies, ``userid, daddr, irregular, ts_ms, is_reply`` and the watermarked
    ``ts``.  State is the userid in flight; a reply to it frees the target, and so do ``forget_ms``
    without one.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        flying, since = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts_ms", "is_reply", "userid"], ascending=[True, False, True])
        for user, ts, is_reply in zip(rows["userid"].tolist(), rows["ts_ms"].tolist(), rows["is_reply"].tolist()):
            if is_reply:
                flying = None if user == flying else flying
                continue
            out.append((user, flying is not None))
            if flying is None:
                flying, since = user, ts
        if flying is not None:
            state.update((int(flying), int(since)))
            state.setTimeoutTimestamp(max(int(since) + forget_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["userid", "suppressed"]).astype({"userid": "int64", "suppressed": "bool"})

    return events.groupBy("daddr", "irregular").applyInPandasWithState(step, "userid long, suppressed boolean", "userid long, since long", "append", GroupStateTimeout.EventTimeTimeout)


class ProbesInFlight(StatefulProcessor):
    """The batch's pass over an address as keyed state: the probe in flight, a map of those waiting, and a timer
    at the next time to send again or to give up, which is set anew each time."""

    def __init__(self, timeout_ms: int, resend_ms: int):
        self.timeout_ms, self.resend_ms = timeout_ms, resend_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flying = handle.getValueState("flying", "probe_id long, port int, start long, sent int")
        self.waiting = handle.getMapState("waiting", "number long", "probe_id long, port int, ts_ms long")
        self.numbers = handle.getValueState("numbers", "first long, next long")

    def _resume(self) -> Probes:
        waiting = _Queue(self.waiting, *(self.numbers.get() if self.numbers.exists() else (0, 0)))
        return Probes(self.timeout_ms, self.resend_ms, tuple(self.flying.get()) if self.flying.exists() else None, waiting)

    def _finish(self, probes: Probes, out: list, watermark: int) -> pd.DataFrame:
        if probes.flying is None:
            self.flying.clear()
        else:
            self.flying.update(tuple(map(int, probes.flying)))
            self.handle.registerTimer(max(probes.due, watermark + 1))
        self.numbers.update((probes.waiting.first, probes.waiting.after))
        if probes.flying is None and not probes.waiting:
            self.numbers.clear()
        return pd.DataFrame(out, columns=["probe_id", "what", "ts_ms"]).astype({"probe_id": "Int64", "what": "object", "ts_ms": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        probes = self._resume()
        rows = pd.concat(list(rows))
        rows = rows.assign(_packet=rows["proto"].notna()).sort_values(["ts_ms", "_packet", "proto", "probe_id"])
        out = []
        for ts, proto, packet, probe, port in zip(rows["ts_ms"].tolist(), rows["proto"], rows["_packet"], rows["probe_id"], rows["port"].tolist()):
            out += probes.row(int(ts), proto if packet else None, None if packet else int(probe), int(port))
        yield self._finish(probes, out, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        probes = self._resume()
        out = probes.advance(timerValues.getCurrentWatermarkInMs())
        yield self._finish(probes, out, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class _Queue:
    """Probes that wait, as entries ``first`` to ``after`` of a map state; only those that are taken are read."""

    def __init__(self, entries, first: int, after: int):
        self.entries, self.first, self.after = entries, first, after

    def __len__(self) -> int:
        return self.after - self.first

    def append(self, probe: tuple) -> None:
        self.entries.updateValue((self.after,), tuple(map(int, probe)))
        self.after += 1

    def popleft(self) -> tuple:
        probe = tuple(self.entries.getValue((self.first,)))
        self.entries.removeKey((self.first,))
        self.first += 1
        return probe


def udp_probing(events: DataFrame, timeout_ms: int = 20_000, resend_ms: int = RESEND_MS) -> DataFrame:
    """``probe_id, what, ts_ms`` of probes (whole numbers), as the batch gives them: sends as their times come, and outcomes.

    ``events`` are probes and packets as :func:`duskwatch.operators.reaction.probe_events` unites them, with the
    watermarked ``ts``.  The session needs :func:`typed_state`.
    """
    return events.groupBy("addr").transformWithStateInPandas(ProbesInFlight(timeout_ms, resend_ms), "probe_id long, what string, ts_ms long", "append", "eventTime")


def udp_outcomes(events: DataFrame, timeout_ms: int = 20_000) -> DataFrame:
    """``probe_id, outcome`` of :func:`udp_probing`."""
    return udp_probing(events, timeout_ms).where("what <> 'send'").select("probe_id", F.col("what").alias("outcome"))


def aged(store: DataFrame, max_age_ms: int) -> DataFrame:
    """``addr, ts_ms``: entries (``addr, ts_ms`` and the watermarked ``ts``) that are dropped once their newest
    sighting is older than ``max_age_ms``; until then the state keeps that sighting."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"addr": [key[0]], "ts_ms": [last]})
            return
        last = max([int(t) for pdf in frames for t in pdf["ts_ms"]] + ([state.get[0]] if state.exists else []))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + max_age_ms, state.getCurrentWatermarkMs() + 1))

    return store.groupBy("addr").applyInPandasWithState(step, f"addr {dict(store.dtypes)['addr']}, ts_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def progress_of(query) -> dict[str, dict]:
    """The counters that the batches of a query observed last, by name (see ``reports.progress``)."""
    last = query.lastProgress
    return {} if last is None else {name: row.asDict() if hasattr(row, "asDict") else dict(row) for name, row in (last.observedMetrics or {}).items()}


class ProgressTotals(StreamingQueryListener):
    """Adds up what the queries of a session observe (``reports.progress``), over all batches and restarts.

    A query's totals are kept in a small file of ``path`` by the query's id, with the last batch that they hold, so that
    a batch counts once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _kept(self, query_id: str) -> dict:
        at = f"{self.path}/{query_id}"
        return json.loads(folders.read_text(self.spark, at)) if folders.exists(self.spark, at) else {"batch": -1, "totals": {}}

    def totals(self, query_id) -> dict[str, dict[str, int]]:
        """The sums by name of the counters."""
        return self._kept(str(query_id))["totals"]

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        kept = self._kept(str(p.id))
        if p.batchId <= kept["batch"] or not p.observedMetrics:
            return
        for name, row in p.observedMetrics.items():
            own = kept["totals"].setdefault(name, {})
            for counter, n in row.asDict().items():
                own[counter] = own.get(counter, 0) + (n or 0)
        folders.write_text(self.spark, f"{self.path}/{p.id}", json.dumps({**kept, "batch": p.batchId}))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def rates(packets: DataFrame, width: str = "1 second") -> DataFrame:
    """Requests and probes per tumbling window of the watermarked ``ts``."""
    return packets.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.sum("num_probes").alias("probes")).select(F.unix_millis("w.start").alias("start_ms"), "requests", "probes")


def downloader_urls(events: DataFrame) -> DataFrame:
    """Filter and clean in one hop: URLs of the events' payloads."""
    from duskwatch.operators.reports import filter_downloaders

    return pl.extract_urls(filter_downloaders(events), "decoded")


def chain(packets: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str):
    """Assemble, filter and clean as one query; ``sink`` gets events and URLs of each micro-batch."""

    def fan_out(batch: DataFrame, number: int) -> None:
        batch.persist()
        sink(batch, downloader_urls(batch), number)
        batch.unpersist()

    return handshakes(packets).writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint).start()


def log_by_hour(packets: DataFrame, path: str, rejects: str, checkpoint: str, arrival: str | None = None):
    """Write a packet stream by hour; rows older than the hour before the newest go to ``rejects``.

    The newest hour is that of all rows so far: of this run's, and of the folders already written,
    so a restarted query goes on where the last one stopped.  Within a micro-batch rows count as they
    came if ``arrival`` (a column of numbers) tells, else the batch's newest row counts for all of it.
    A micro-batch writes folders of its own number, so one that is repeated replaces what it wrote.
    """
    spark = packets.sparkSession
    newest = {"ms": cached_newest(spark, path)}

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        before, top = newest["ms"], batch.agg(F.max(hour_ms("ts_ms")).alias("t")).first()["t"] or 0
        if arrival is None:
            late = batch.where(hour_ms("ts_ms") < max(before, top) - 3_600_000)
            good = batch.where(hour_ms("ts_ms") >= max(before, top) - 3_600_000)
        else:
            good, late = split_late(batch, arrival, since_ms=before)
        newest["ms"] = max(before, top)
        good.withColumn("hour_ms", hour_ms("ts_ms")).write.mode("overwrite").partitionBy("hour_ms").parquet(f"{path}/batch={number}")
        late.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        batch.unpersist()

    return packets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def cached_newest(spark: SparkSession, path: str) -> int:
    """Newest hour folder of a written log, 0 if there is none yet."""
    try:
        return spark.read.parquet(path).agg(F.max("hour_ms").alias("t")).first()["t"] or 0
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0
