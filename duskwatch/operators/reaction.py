"""What to answer to a packet, what not to probe again, and what became of probes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.operators.ordered import dealt, flag_in_order

TWO32, NEVER = 1 << 32, 1 << 62
#: Fixed value: a probe without a reply is sent again after so long.
RESEND_MS = 6000


def plan_reaction(packets: DataFrame, tcp: bool = True, udp: bool = True, icmp: bool = True) -> DataFrame:
    """Adds ``reaction``: null or the probe request (method, swapped tuple, numbers, count, due time).

    A bare SYN is answered with a SYN-ACK, an ACK with two RSTs five seconds later, UDP with its
    own payload and ICMP (but an echo reply) with an echo.
    """
    syn, ack, rst = (F.col(c) == 1 for c in ("syn", "ack", "rst"))
    size = F.floor(F.length(F.coalesce("payload", F.lit(""))) / 2)
    case = [
        (F.lit(tcp) & (F.col("proto") == "tcp") & syn & ~ack & ~rst, ("tcp-synack", (F.col("snum") + size + 1) % TWO32, F.lit(0), 1, 0)),
        (F.lit(tcp) & (F.col("proto") == "tcp") & ~syn & ack, ("tcp-rst", F.lit(0), F.col("anum"), 2, 5000)),
        (F.lit(udp) & (F.col("proto") == "udp"), ("udp", F.lit(0), F.lit(0), 5, 0)),
        (F.lit(icmp) & (F.col("proto") == "icmp") & F.coalesce(F.col("options") != "echo_reply", F.lit(True)), ("icmp-echo", F.lit(0), F.lit(0), 5, 0)),
    ]
    reaction = F.lit(None)
    for when, (method, anum, snum, probes, delay) in reversed(case):
        made = F.struct(
            F.lit(method).alias("method"), F.col("daddr").alias("saddr"), F.col("saddr").alias("daddr"), F.col("dport").alias("sport"), F.col("sport").alias("dport"),
            anum.cast("bigint").alias("anum"), snum.cast("bigint").alias("snum"), F.lit(probes).alias("num_probes"), F.when(F.lit(method) == "udp", F.col("payload")).alias("payload"), (F.col("ts_ms") + delay).alias("due_ms"),
        )
        reaction = F.when(when, made).otherwise(reaction)
    return packets.withColumn("reaction", reaction)


def probe_payload(requests: DataFrame, by_port: DataFrame | None = None) -> DataFrame:
    """Adds ``probe_payload``: the port's own (``dport, port_payload``), else the reflected one, else 0a."""
    if by_port is not None:
        requests = requests.join(by_port, "dport", "left")
    else:
        requests = requests.withColumn("port_payload", F.lit(None).cast("string"))
    return requests.withColumn("probe_payload", F.coalesce("port_payload", F.nullif(F.col("payload"), F.lit("")), F.lit("0a"))).drop("port_payload")


def suppress_in_flight(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Adds ``suppressed``: a probe to the same (daddr, irregular) is still unanswered.

    ``requests``: ``userid, daddr, irregular, ts_ms``; ``replies``: ``userid, ts_ms``.  A request
    that is sent blocks later ones until its reply's time.  One pass over the requests of a target
    in order keeps one number, the time until which the target is busy.
    """

    def fold():
        until = -NEVER

        def step(row: tuple) -> bool:
            nonlocal until
            ts, _, reply = row
            if ts is not None and ts < until:
                return True
            until = NEVER if reply is None else reply
            return False

        return step

    asked = requests.join(replies.groupBy("userid").agg(F.min("ts_ms").alias("_reply_ms")), "userid", "left")
    return flag_in_order(asked, ["daddr", "irregular"], ["ts_ms", "userid"], "suppressed", fold, ("_reply_ms",))


def dedupe_rst(requests: DataFrame, pause_ms: int = 5000, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``logged``: no RST to the same (saddr, sport) is pending; one is for ``pause_ms`` after a kept one.

    Of requests at one time the first by the ``ties`` columns is kept."""
    from duskwatch.operators.reports import throttle

    keyed = requests.withColumn("_key", F.struct("saddr", "sport"))
    return throttle(keyed, "_key", "ts_ms", pause_ms, ties).withColumnRenamed("attempted", "logged").drop("_key")


class Packed:
    """A queue of rows, nearly all of them in Arrow arrays."""

    def __init__(self, size: int = 4096):
        self.size, self.first, self.blocks, self.last = size, deque(), deque(), []

    def __bool__(self) -> bool:
        return bool(self.first or self.blocks or self.last)

    def append(self, row: tuple) -> None:
        self.last.append(row)
        if len(self.last) == self.size:
            self.blocks.append([pa.array(c) for c in zip(*self.last)])
            self.last = []

    def popleft(self) -> tuple:
        if not self.first and self.blocks:
            self.first.extend(zip(*[c.to_pylist() for c in self.blocks.popleft()]))
        elif not self.first:
            self.first.extend(self.last)
            self.last = []
        return self.first.popleft()


class Probes:
    """The probe in flight to one address, and those that wait for it to be done.

    ``flying`` is (probe, port, start, times sent) or None, ``waiting`` holds (probe, port, time).  Methods are called
    in the order of time and return what happens, as (probe, what, time): a probe is sent at its start and every
    ``resend_ms`` from then on until it is settled or has had its time, and it is answered, unreachable or
    a timeout.
    """

    def __init__(self, timeout_ms: int, resend_ms: int = RESEND_MS, flying=None, waiting=None):
        self.timeout_ms, self.resend_ms, self.flying, self.waiting = timeout_ms, resend_ms, flying, deque() if waiting is None else waiting

    def _start(self, probe, port, at: int) -> list[tuple]:
        self.flying = (probe, port, at, 1)
        return [(probe, "send", at)]

    def _follow(self, free: int) -> list[tuple]:
        self.flying = None
        if not self.waiting:
            return []
        probe, port, ts = self.waiting.popleft()
        return self._start(probe, port, max(ts, free))

    def _next(self) -> int | None:
        """When the probe in flight is sent again, if it has the time."""
        again = self.flying[2] + self.resend_ms * self.flying[3]
        return again if again <= self.flying[2] + self.timeout_ms else None

    def advance(self, now: int | None, most: int = NEVER) -> list[tuple]:
        """Send again and time out what is due before ``now`` (None: all), and start what waits; with ``most`` about
        so much of it, and the rest when called again."""
        out = []
        while self.flying is not None and len(out) < most:
            probe, port, start, sent = self.flying
            again = self._next()
            if again is not None and (now is None or again < now):
                self.flying = (probe, port, start, sent + 1)
                out.append((probe, "send", again))
            elif now is None or now - start > self.timeout_ms:
                out.append((probe, "timeout", start + self.timeout_ms))
                out += self._follow(start + self.timeout_ms)
            else:
                break
        return out

    def row(self, ts: int | None, proto: str | None, probe, port) -> list[tuple]:
        """A probe (``proto`` null) or a packet; a probe without a time is never sent."""
        if ts is None:
            return [(probe, "timeout", None)]
        out = self.advance(ts)
        if proto is None and self.flying is None:
            out += self._start(probe, port, ts)
        elif proto is None:
            self.waiting.append((probe, port, ts))
        elif self.flying is not None and self.flying[1] == port and ts >= self.flying[2]:
            out.append((self.flying[0], "answered" if proto == "udp" else "unreachable", ts))
            out += self._follow(ts)
        return out

    @property
    def due(self) -> int | None:
        """When something happens next if no packet comes."""
        if self.flying is None:
            return None
        again = self._next()
        return (self.flying[2] + self.timeout_ms if again is None else again) + 1


def probe_events(probes: DataFrame, packets: DataFrame, *more: str) -> DataFrame:
    """Probes and the packets that can settle them as ``addr, ts_ms, proto, probe_id, port`` (proto null for
    probes) and ``more`` columns of both."""
    sent = probes.select("addr", "ts_ms", F.lit(None).cast("string").alias("proto"), "probe_id", "port", *more)
    got = packets.where(F.col("proto").isin("udp", "icmp") & F.col("ts_ms").isNotNull() & F.col("saddr").isNotNull() & F.col("sport").isNotNull())
    return sent.unionByName(got.select(F.col("saddr").alias("addr"), "ts_ms", "proto", F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"), F.col("sport").alias("port"), *more))


def udp_probing(probes: DataFrame, packets: DataFrame, timeout_ms: int = 20_000, resend_ms: int = RESEND_MS) -> DataFrame:
    """``probe_id, what, ts_ms``: each time a probe is sent (``send``), and what became of it: answered, unreachable or timeout.

    ``probes``: ``probe_id, addr, port, ts_ms``; ``packets``: ``proto, saddr, sport, ts_ms`` where an
    ICMP unreachable carries the embedded port as ``sport``.  An address has one probe in flight;
    others wait in order and start when it is done, at its reply or ``timeout_ms`` after its start.
    A packet of its port settles the probe in flight and no other.  One pass over an address's
    probes and packets in order keeps the probe in flight and those waiting; what happens is given in pieces.
    """
    piece = 10_000
    fresh = lambda: Probes(timeout_ms, resend_ms, None, Packed())

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kind = None, fresh(), None

        def made(out: list[tuple]) -> pa.RecordBatch:
            probe, what, ts = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(probe, kind), pa.array(what, pa.string()), pa.array(ts, pa.int64())], ["probe_id", "what", "ts_ms"])

        for batch in batches:
            kind, out = batch.schema.field("probe_id").type, []
            for addr, ts, proto, probe, port in zip(*[batch.column(c).to_pylist() for c in ("addr", "ts_ms", "proto", "probe_id", "port")]):
                if addr != key:
                    while some := state.advance(None, piece):
                        yield made(some)
                    key, state = addr, fresh()
                while ts is not None and (some := state.advance(ts, piece)):
                    out += some
                    if len(out) >= piece:
                        yield made(out)
                        out = []
                out += state.row(ts, proto, probe, port)
            yield made(out)
        while some := state.advance(None, piece):
            yield made(some)

    schema = T.StructType([probes.schema["probe_id"], T.StructField("what", T.StringType()), T.StructField("ts_ms", T.LongType())])
    return dealt(probe_events(probes, packets), ["addr"], ["ts_ms", "proto", "probe_id"]).mapInArrow(settle, schema)


def udp_outcomes(probes: DataFrame, packets: DataFrame, timeout_ms: int = 20_000) -> DataFrame:
    """``probe_id, outcome`` of :func:`udp_probing`: answered, unreachable or timeout."""
    return udp_probing(probes, packets, timeout_ms).where("what <> 'send'").select("probe_id", F.col("what").alias("outcome"))


def reply_loss(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """``userid, replies, loss`` per request (``userid, num_probes``)."""
    got = replies.groupBy("userid").agg(F.count(F.lit(1)).alias("r"))
    return requests.join(got, "userid", "left").select("userid", F.coalesce("r", F.lit(0)).alias("replies"), (F.col("num_probes") - F.coalesce("r", F.lit(0))).alias("loss"))


def protocol_tally(packets: DataFrame) -> DataFrame:
    """One row: total, tcp, udp, icmp, other."""
    known = F.col("proto").isin("tcp", "udp", "icmp")
    return packets.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("proto") == p).alias(p) for p in ("tcp", "udp", "icmp")], F.count_if(~F.coalesce(known, F.lit(False))).alias("other"))


def rates(packets: DataFrame, width_ms: int = 1000) -> DataFrame:
    """``start_ms, requests, probes, queue``: per window the requests, their probes and the last queue size."""
    start = F.col("ts_ms") - F.pmod("ts_ms", F.lit(width_ms))
    return packets.groupBy(start.alias("start_ms")).agg(F.count(F.lit(1)).alias("requests"), F.sum("num_probes").alias("probes"), F.max_by("queue", F.struct("ts_ms", "queue")).alias("queue"))


def counter_deltas(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """Adds ``<c>_delta`` of cumulative counters, from 0."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.withColumns({f"{c}_delta": F.col(c) - F.lag(c, 1, 0).over(w) for c in columns})
