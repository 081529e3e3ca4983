"""The handshake rules row by row and list by list, as a model to hold the indexed fold against."""

HOUR, GRACE = 3_600_000, 90 * 60_000


class Phase:
    """A SYN, the ACK that followed it, and the second phase it was joined with."""

    __slots__ = ("syn", "ack", "second")

    def __init__(self, syn):
        self.syn, self.ack, self.second = syn, None, None


def starts(first, syn, timeout: int) -> bool:
    """Whether a regular SYN falls into the time that a first phase's confirmation opens."""
    if first.syn.con_ms is None:
        return False
    gap = syn.ts_ms // 1000 - first.syn.con_ms // 1000
    return gap < timeout if gap >= 0 else gap >= -1


class Fold:
    """State of one key; ``add`` takes rows in order, ``close`` gives finished events."""

    def __init__(self, timeout: int = 600):
        self.timeout = timeout
        self.irregular: list[Phase] = []
        self.regular: list[Phase] = []
        self.pairs: list[Phase] = []
        self.waiting: list = []

    def _pair(self, phase: Phase) -> bool:
        """Join a regular phase with the first free irregular one, bare ones before acknowledged."""
        free = [p for p in self.irregular if p.ack is None] + [p for p in self.irregular if p.ack is not None]
        for first in free:
            if starts(first, phase.syn, self.timeout):
                self.irregular.remove(first)
                first.second = phase
                self.pairs.append(first)
                return True
        return False

    def _acknowledge(self, ack) -> bool:
        """Give an ACK to a regular SYN, else an irregular one, else a second phase."""
        for phases in (self.regular, self.irregular, [p.second for p in self.pairs]):
            for p in phases:
                s = p.syn
                if p.ack is None and s.con_ms is not None and s.sport == ack.sport and s.probe_anum == ack.snum and ack.ts_ms < s.ts_ms - s.ts_ms % HOUR + GRACE:
                    p.ack = ack
                    return True
        return False

    def place(self, first) -> int:
        """First phases count in the order in which they came."""
        return first.syn.step

    def add(self, row) -> None:
        if row.kind == "isyn":
            self.irregular.append(Phase(row))
        elif row.kind == "rsyn":
            phase = Phase(row)
            if not self._pair(phase):
                self.regular.append(phase)
        elif row.kind == "ack" and not self._acknowledge(row):
            self.waiting.append(row)

    def close(self, before: int | None) -> list[tuple]:
        """Events whose first SYN's hour ended 90 minutes after its start, at ``before`` (None: all)."""
        gone = lambda p: before is None or before >= p.syn.ts_ms - p.syn.ts_ms % HOUR + GRACE
        if not any(map(gone, self.irregular + self.regular + self.pairs)):
            if before is not None:
                self.waiting = [a for a in self.waiting if before < a.ts_ms - a.ts_ms % HOUR + GRACE]
            return []
        self.waiting = [a for a in self.waiting if not self._acknowledge(a)]
        self.waiting = [a for a in self.waiting if before is not None and before < a.ts_ms - a.ts_ms % HOUR + GRACE]
        for phase in list(self.regular):
            if gone(phase) and self._pair(phase):
                self.regular.remove(phase)
        out = []
        for p in self.regular:
            if gone(p):
                acked = p.ack is not None
                repeat = next((f for f in sorted(self.pairs, key=lambda f: (f.second.ack is not None, self.place(f))) if acked and starts(f, p.syn, self.timeout)), None)
                out.append(self._row("rsyn (acked)" if acked else "rsyn", None, p, repeat))
        for p in self.pairs:
            if gone(p):
                out.append(self._row("two-phase" if p.second.ack is not None else "two-phase (no ack)", p, p.second, None))
        for p in self.irregular:
            if gone(p):
                out.append(self._row("isyn (acked)" if p.ack is not None else "isyn", p, None, None))
        self.regular = [p for p in self.regular if not gone(p)]
        self.pairs = [p for p in self.pairs if not gone(p)]
        self.irregular = [p for p in self.irregular if not gone(p)]
        return out

    @staticmethod
    def _row(tag: str, first: Phase | None, second: Phase | None, repeat) -> tuple:
        s = (first or second).syn
        one = lambda row, name: None if row is None else getattr(row, name)
        isyn, iack = (first.syn, first.ack if second is None else None) if first else (None, None)
        rsyn, rack = (second.syn, second.ack) if second else (None, None)
        return (s.saddr, s.daddr, s.dport, s.ts_ms, tag, repeat is not None, one(isyn, "userid"), one(iack, "userid"), one(rsyn, "userid"), one(rack, "userid"), one(isyn, "ipid"), one(isyn, "snum"), one(rack, "sport"), one(rack, "snum"), one(rack, "payload"), one(iack, "payload"), None if repeat is None else repeat.syn.userid)
