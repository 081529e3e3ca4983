"""TCP handshakes and two-phase events, one fold per (source, destination, port).

Packets are dealt by key and sorted by time, once.  Keys with one kind of packet only, nearly all of a
telescope's, are finished by columns of Arrow batches.  The rows of the others are walked once: a task keeps
the open phases of the key at hand, indexed by what can find them (ports and numbers for ACKs, the
confirmation's time and then the order of arrival for second phases), so a row costs a logarithm of
the open phases, and emits them when their hour has closed.  The same fold serves batch and stream.
"""

from __future__ import annotations

from collections import deque, namedtuple
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR, GRACE = 3_600_000, 90 * 60_000
RESULT = "saddr long, daddr long, dport int, ts_ms long, tag string, repeated boolean, isyn long, iack long, rsyn long, rack long, isyn_ipid int, isyn_snum long, rack_sport int, rack_snum long, rack_payload string, iack_payload string, repeat_of long"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
NEEDED = ["saddr", "daddr", "dport", "ts_ms", "step", "sport", "snum", "anum", "ipid", "userid", "kind", "probe_anum", "con_ms", "payload"]
KEYS = ["saddr", "daddr", "dport"]
#: What :func:`events_of` takes of packets, and matching needs of them before.
INPUT = [*[c for c in NEEDED if c not in ("kind", "con_ms")], "method", "syn", "ack", "rst", "ttl", "options"]
#: Columns with few values in a batch, which its rows share.
SHARED = {*KEYS, "kind", "payload"}
REGULAR, IRREGULAR, SECOND, FIRST = range(4)

Packet = namedtuple("Packet", NEEDED)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ddl.split(", "))])


_ARROW = _schema(RESULT)


def closing(ts_ms: int) -> int:
    """When the hour of a packet is closed: 90 minutes after its start."""
    return ts_ms - ts_ms % HOUR + GRACE


class Phase:
    """A SYN, the ACK that followed it, and the second phase it was joined with."""

    __slots__ = ("syn", "ack", "second", "role", "order")

    def __init__(self, syn: Packet, role: int, order: int):
        self.syn, self.ack, self.second, self.role, self.order = syn, None, None, role, order


class Free:
    """First phases that regular SYNs may belong to; the SYNs come in the order of time.

    A phase is open from a second before its confirmation until ``timeout`` seconds after it.
    It waits by its confirmation until that begins, then by its order, bare ones before acknowledged ones
    (of a pair, the second phase's ACK counts); once it is over, or has another ``role``, it is passed over
    for good.
    """

    def __init__(self, timeout: int, phases: Iterable[Phase] = (), role: int = IRREGULAR):
        self.timeout, self.now, self.role = timeout, 0, role
        self.later: list[tuple[int, int, Phase]] = []
        self.begun: tuple[list[tuple[int, Phase]], list[tuple[int, Phase]]] = ([], [])
        for p in phases:
            self.add(p)

    def add(self, p: Phase) -> None:
        if p.syn.con_ms is not None:
            heappush(self.later, (p.syn.con_ms // 1000, p.order, p))

    def first(self, syn: Packet) -> Phase | None:
        """The phase whose turn it is; it stays until its role changes."""
        self.now = syn.ts_ms // 1000
        acked = lambda p: (p.second or p).ack is not None
        while self.later and self.later[0][0] <= self.now + 1:
            _, order, p = heappop(self.later)
            heappush(self.begun[acked(p)], (order, p))
        for acknowledged, heap in enumerate(self.begun):
            while heap:
                order, p = heap[0]
                if p.role == self.role and self.now - p.syn.con_ms // 1000 < self.timeout:
                    if acknowledged or not acked(p):
                        return p
                    heappush(self.begun[1], (order, p))
                heappop(heap)
        return None


class Fold:
    """State of one key; ``add`` takes rows in order, ``close`` gives finished events."""

    def __init__(self, timeout: int = 600, row: Callable[..., tuple | None] | None = None):
        self.timeout, self.row = timeout, row or _row
        self.irregular: list[Phase] = []
        self.regular: list[Phase] = []
        self.pairs: list[Phase] = []
        self.waiting: deque[tuple[int, Packet]] = deque()
        self._count = 0
        self._index()

    def _index(self) -> None:
        """Build what finds the open phases: for ACKs by role, for second phases, and the next closing time."""
        self._expecting: tuple[dict, dict, dict] = ({}, {}, {})
        for p in (*self.regular, *self.irregular, *[f.second for f in self.pairs]):
            self._expect(p)
        self._free = Free(self.timeout, self.irregular)
        self._due = min((closing(p.syn.ts_ms) for p in (*self.regular, *self.irregular, *self.pairs)), default=None)

    def _expect(self, p: Phase) -> None:
        """One phase stands for itself, since nearly all are alone and a queue of one is larger than the phase."""
        if p.ack is None and p.syn.con_ms is not None:
            expecting, key = self._expecting[p.role], (p.syn.sport, p.syn.probe_anum)
            others = expecting.get(key)
            if others is None:
                expecting[key] = p
            elif isinstance(others, Phase):
                expecting[key] = deque((others, p))
            else:
                others.append(p)

    def _acknowledge(self, ack: Packet) -> bool:
        """Give an ACK to the first regular SYN that expects it, else an irregular one, else a second phase."""
        for role, expecting in enumerate(self._expecting):
            queue = expecting.get((ack.sport, ack.snum), ())
            if isinstance(queue, Phase):
                queue = (queue,)
            while isinstance(queue, deque) and queue and (queue[0].ack is not None or queue[0].role != role):
                queue.popleft()
            for p in queue:
                if p.ack is None and p.role == role and ack.ts_ms < closing(p.syn.ts_ms):
                    p.ack = ack
                    return True
        return False

    def _join(self, first: Phase, second: Phase) -> None:
        first.second, first.role, second.role = second, FIRST, SECOND
        self.pairs.append(first)
        self._expect(second)

    def add(self, row: Packet) -> None:
        if row.kind == "ack":
            if not self._acknowledge(row):
                self.waiting.append((self._count, row))
                self._count += 1
            return
        phase = Phase(row, IRREGULAR if row.kind == "isyn" else REGULAR, self._count)
        self._count += 1
        self._due = closing(row.ts_ms) if self._due is None else min(self._due, closing(row.ts_ms))
        if phase.role == IRREGULAR:
            self.irregular.append(phase)
            self._free.add(phase)
            self._expect(phase)
            return
        # A row that comes late, as in a stream, looks at all phases anew.
        free = self._free if row.ts_ms // 1000 >= self._free.now else Free(self.timeout, [p for p in self.irregular if p.role == IRREGULAR])
        if (first := free.first(row)) is not None:
            self._join(first, phase)
        else:
            self.regular.append(phase)
            self._expect(phase)

    def close(self, before: int | None) -> list[tuple]:
        """Events whose first SYN's hour is closed at ``before`` (None: all)."""
        return list(self.closed(before))

    def closed(self, before: int | None) -> Iterator[tuple]:
        """As :meth:`close`, one by one; to be taken to the end."""
        if self._due is None or (before is not None and before < self._due):
            while self.waiting and before is not None and before >= closing(self.waiting[0][1].ts_ms):
                self.waiting.popleft()
            return
        gone = lambda p: before is None or before >= closing(p.syn.ts_ms)
        self.waiting = deque((k, a) for k, a in self.waiting if not self._acknowledge(a) and before is not None and before < closing(a.ts_ms))
        # SYNs of a second phase that came just before the first one.
        self._free = free = Free(self.timeout, (p for p in self.irregular if p.role == IRREGULAR))
        for phase in self.regular:
            if gone(phase) and (first := free.first(phase.syn)) is not None:
                self._join(first, phase)
        pairs = Free(self.timeout, self.pairs, FIRST)

        for p in self.regular:
            if p.role == REGULAR and gone(p):
                first = pairs.first(p.syn) if p.ack is not None else None
                yield self.row("rsyn (acked)" if p.ack is not None else "rsyn", None, p, first)
        for p in self.pairs:
            if gone(p):
                yield self.row("two-phase" if p.second.ack is not None else "two-phase (no ack)", p, p.second)
        for p in self.irregular:
            if p.role == IRREGULAR and gone(p):
                yield self.row("isyn (acked)" if p.ack is not None else "isyn", p, None)
        self.regular = [p for p in self.regular if p.role == REGULAR and not gone(p)]
        self.pairs = [p for p in self.pairs if not gone(p)]
        self.irregular = [p for p in self.irregular if p.role == IRREGULAR and not gone(p)]
        self._index()

    def over(self, before: int) -> bool:
        """Whether :meth:`closed` has something to do at ``before``."""
        return (self._due is not None and before >= self._due) or (bool(self.waiting) and before >= closing(self.waiting[0][1].ts_ms))

    @property
    def due(self) -> int | None:
        """When the next phase or waiting ACK is over; None if there is none."""
        times = [t for t in (self._due, closing(self.waiting[0][1].ts_ms) if self.waiting else None) if t is not None]
        return min(times, default=None)

    def phases(self) -> dict[int, tuple]:
        """The open phases by number: ``(role, number of the second phase, SYN, ACK)``."""
        free = [p for p in self.irregular if p.role == IRREGULAR]
        return {p.order: (p.role, p.second.order if p.second else None, p.syn, p.ack) for p in (*free, *self.regular, *self.pairs, *[p.second for p in self.pairs])}

    @classmethod
    def resumed(cls, phases: dict[int, tuple], waiting: dict[int, Packet], count: int, timeout: int = 600) -> Fold:
        """The fold whose :meth:`phases`, waiting ACKs by number and count of numbers these are."""
        fold, made = cls(timeout), {}
        for number, (role, _, syn, ack) in sorted(phases.items()):
            made[number] = Phase(syn, role, number)
            made[number].ack = ack
        for number, p in made.items():
            if p.role == FIRST:
                p.second = made[phases[number][1]]
        fold.irregular, fold.regular = ([p for p in made.values() if p.role == role] for role in (IRREGULAR, REGULAR))
        fold.pairs = sorted((p for p in made.values() if p.role == FIRST), key=lambda p: p.second.order)
        fold.waiting, fold._count = deque(sorted(waiting.items())), count
        fold._index()
        return fold


def _row(tag: str, first: Phase | None, second: Phase | None, repeats: Phase | None = None) -> tuple:
    s = (first or second).syn
    one = lambda row, name: None if row is None else getattr(row, name)
    isyn, iack = (first.syn, first.ack if second is None else None) if first else (None, None)
    rsyn, rack = (second.syn, second.ack) if second else (None, None)
    return (s.saddr, s.daddr, s.dport, s.ts_ms, tag, repeats is not None, one(isyn, "userid"), one(iack, "userid"), one(rsyn, "userid"), one(rack, "userid"), one(isyn, "ipid"), one(isyn, "snum"), one(rack, "sport"), one(rack, "snum"), one(rack, "payload"), one(iack, "payload"), None if repeats is None else repeats.syn.userid)


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
    for c in RESULT.split(", "):
        name, kind = c.split()
        if kind in ("long", "int"):
            out[name] = out[name].astype("Int64" if kind == "long" else "Int32")
    return out


def events_of(packets: DataFrame, *more: str) -> DataFrame:
    """The columns the fold needs, and ``more``; ``kind`` is isyn, rsyn or ack, RSTs and others are left out."""
    kind = F.when(F.col("rst") == 1, None).when((F.col("syn") == 1) & (F.col("ack") == 0), F.when((F.col("ipid") == 54321) | (F.col("ttl") > 200) | (F.col("options") == ""), "isyn").otherwise("rsyn")).when((F.col("ack") == 1) & (F.col("syn") == 0), "ack")
    return packets.withColumn("kind", kind).where("kind is not null").select(*NEEDED, *more)


def rows_of(pdf: pd.DataFrame) -> Iterator[Packet]:
    """Rows with None for missing values and whole numbers as int."""
    texts = ("kind", "payload")
    columns = [[None if gone else v if c in texts else int(v) for v, gone in zip(pdf[c].tolist(), pdf[c].isna().tolist())] for c in NEEDED]
    return map(Packet._make, zip(*columns))


def assemble_handshakes(packets: DataFrame, phase_timeout: int = 600) -> DataFrame:
    """Handshakes of confirmed packets without retransmits; see RESULT for the columns.

    Lone ACKs are dropped; a repeated connection after a two-phase event is flagged, and ``repeat_of`` is
    the userid of that event's first SYN.
    """

    return _dealt(packets).mapInArrow(_walker(phase_timeout), RESULT)


def _walker(timeout: int, row: Callable[..., tuple | None] | None = None, schema: pa.Schema = _ARROW) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walks rows that are sorted by key and time; with ``row``, what it makes of the contended keys' events only."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batched = lambda rows: _batch(rows, schema)
        key, fold = None, Fold(timeout, row)
        for batch in batches:
            finished, waiting = _apart(batch, timeout)
            if row is None:
                yield finished
            out = []
            for packet in _packets(waiting):
                if packet[:3] != key:
                    yield from map(batched, _pieces(filter(None, fold.closed(None))))
                    key, fold = packet[:3], Fold(timeout, row)
                if fold.over(packet.ts_ms):
                    out += filter(None, fold.closed(packet.ts_ms))
                fold.add(packet)
            yield batched(out)
        yield from map(batched, _pieces(filter(None, fold.closed(None))))

    return walk


def _dealt(packets: DataFrame) -> DataFrame:
    n = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events_of(packets).repartition(n, *KEYS).sortWithinPartitions(*KEYS, "ts_ms", "step")


def _packets(batch: pa.RecordBatch) -> Iterator[Packet]:
    return map(Packet._make, zip(*[_shared(batch.column(c)) if c in SHARED else batch.column(c).to_pylist() for c in NEEDED]))


def _shared(column: pa.Array) -> list:
    """The values of a column, equal ones as one object."""
    coded = column.dictionary_encode()
    values = coded.dictionary.to_pylist()
    return [None if k is None else values[k] for k in coded.indices.to_pylist()]


def _pieces(rows: Iterator[tuple], size: int = 10_000) -> Iterator[list[tuple]]:
    while piece := list(islice(rows, size)):
        yield piece


def _apart(batch: pa.RecordBatch, timeout: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Events of the keys whose phases cannot contend, and the rows that have to be walked.

    These are keys with SYNs of one kind and no ACK, and keys with at most one SYN of each kind (that expect different
    ACKs) whose rows all come before the first hour closes.  The batch is sorted by key and time.  Its first and last
    key may go on in other batches and are walked; keys with nothing but ACKs give no event.
    """
    size = batch.num_rows
    if not size:
        return _batch([]), batch
    number = lambda c: batch.column(c).fill_null(-1).to_numpy()
    new = np.ones(size, bool)
    new[1:] = np.logical_or.reduce([(c[1:] != c[:-1]) for c in map(number, KEYS)])
    starts, own = np.flatnonzero(new), np.cumsum(new) - 1
    first, ack = (pc.equal(batch.column("kind"), k).to_numpy(zero_copy_only=False) for k in ("isyn", "ack"))
    second, place = ~(first | ack), np.arange(size)
    times, con = number("ts_ms"), np.where(pc.is_null(batch.column("con_ms")).to_numpy(zero_copy_only=False), np.iinfo(np.int64).max, number("con_ms"))
    n_first, n_second, n_ack = (np.add.reduceat(x.astype(np.int64), starts) for x in (first, second, ack))
    ends = np.append(starts[1:], size) - 1

    # Of a key with at most one SYN of a kind: its place, or -1; and the ACK it gets: the first that comes after it, else the first before.
    at = [np.maximum.reduceat(np.where(x, place, -1), starts) for x in (first, second)]
    sport, snum, expected = number("sport"), number("snum"), number("probe_anum")
    answered = []
    for syn in (x[own] for x in at):
        fits = ack & (syn >= 0) & (sport == sport[syn]) & (snum == expected[syn]) & (con[syn] < np.iinfo(np.int64).max)
        turn = np.minimum.reduceat(np.where(fits, np.where(place > syn, place, place + size), 2 * size), starts)
        answered.append(np.where(turn < 2 * size, turn % size, -1))
    i, r = at
    both = (i >= 0) & (r >= 0)
    apart = (n_first <= 1) & (n_second <= 1) & (times[ends] < closing(times[starts])) & ~(both & (sport[i] == sport[r]) & (expected[i] == expected[r]))
    done = apart | ((n_ack == 0) & ((n_first == 0) | (n_second == 0))) | (n_first + n_second == 0)
    done[[0, -1]] = False
    begun = con[i] // 1000
    late = times[r] // 1000 - begun
    paired = apart & both & (con[i] < np.iinfo(np.int64).max) & (late >= -1) & (late < timeout)

    # An event for each SYN that is done; a pair's is that of its first phase.
    rows = np.flatnonzero(done[own] & ~ack & ~(second & paired[own]))
    key, none = own[rows], np.full(len(rows), -1)
    alone = apart[key]
    is_first = first[rows]
    isyn, rsyn = np.where(is_first, rows, none), np.where(is_first, np.where(paired[key], r[key], -1), rows)
    iack = np.where(alone & is_first & ~paired[key], answered[0][key], -1)
    rack = np.where(alone & (rsyn >= 0), answered[1][key], -1)
    taken = lambda name, places: batch.column(name).take(pa.array(places, mask=places < 0))
    names = np.array(["isyn", "isyn (acked)", "rsyn", "rsyn (acked)", "two-phase (no ack)", "two-phase"], object)
    tag = np.where(isyn >= 0, np.where(rsyn >= 0, 4, 0), 2) + ((iack >= 0) | (rack >= 0))
    known = {
        **{c: taken(c, rows) for c in (*KEYS, "ts_ms")}, "tag": pa.array(names[tag], pa.string()), "repeated": pa.array(np.zeros(len(rows), bool)),
        **{n: taken("userid", x) for n, x in (("isyn", isyn), ("iack", iack), ("rsyn", rsyn), ("rack", rack))}, "isyn_ipid": taken("ipid", isyn), "isyn_snum": taken("snum", isyn),
        "rack_sport": taken("sport", rack), "rack_snum": taken("snum", rack), "rack_payload": taken("payload", rack), "iack_payload": taken("payload", iack),
    }
    columns = [known[f.name].cast(f.type) if f.name in known else pa.nulls(len(rows), f.type) for f in _ARROW]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW), batch.filter(pa.array(~done[own]))


def _batch(rows: list[tuple], schema: pa.Schema = _ARROW) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


NAMED = "rsyn long, first_s long, sport long, ipid long, anum long"
_NAMED = _schema(NAMED)


def _named(tag: str, first: Phase | None, second: Phase | None, repeats: Phase | None = None) -> tuple | None:
    if repeats is not None:
        s = repeats.syn
        return second.syn.userid, s.ts_ms // 1000, s.sport, s.ipid, s.anum


def named_repeats(packets: DataFrame, phase_timeout: int = 600) -> DataFrame:
    """As :func:`repeat_identities` of the handshakes of these packets: the walk itself names the events, without a join."""
    named = _dealt(packets).mapInArrow(_walker(phase_timeout, _named, _NAMED), NAMED)
    named = named.withColumns({c: F.col(c).cast(packets.schema[of].dataType) for c, of in (("rsyn", "userid"), ("sport", "sport"), ("ipid", "ipid"), ("anum", "anum"))})
    return named.withColumn("ident", F.xxhash64("first_s", "sport", "ipid", "anum"))


def repeat_identities(handshakes: DataFrame, packets: DataFrame) -> DataFrame:
    """Repeated connections with what names the event they repeat: ``rsyn, first_s, sport, ipid, anum, ident``.

    The first four are of the event's first SYN, ``ident`` is their hash.
    """
    first = packets.select(F.col("userid").alias("repeat_of"), F.floor(F.col("ts_ms") / 1000).alias("first_s"), "sport", "ipid", "anum")
    named = handshakes.where("repeated").select("rsyn", "repeat_of").join(first, "repeat_of")
    return named.select("rsyn", "first_s", "sport", "ipid", "anum", F.xxhash64("first_s", "sport", "ipid", "anum").alias("ident"))
