"""Following hour files while they grow: a streaming source whose offsets are bytes of files.

Files are named by hour (``logs.FILE_NAME``) and appended to.  A micro-batch takes whole lines up to where each file ended
when it was planned; those bytes never change, so a batch that is repeated reads the same lines.

* An hour opens when its first file is there.  An hour without files is passed over ``SKIP_MS`` after it
  began, and files that come for it later are not read.
* An open hour is left once ``CLOSE_MS`` have gone since it began and its files are read to their ends; only then a
  last line without an end of line counts.  Several hours may be open at once.
* A batch holds at most ``max_bytes`` of lines and, if asked for, ``max_rows`` lines; a single longer line goes alone.
  Earlier hours come first.
* Compressed files cannot be cut: one is read whole, once its hour is left, and counts by its compressed size.

The offset lists the open hours' files only.  After a restart it is read from the query's own offset log, which is why the
source is told the query's checkpoint.  Files and checkpoint must be on a file system that the driver and the
executors open by the same path (a mounted one, or what pyarrow reads by URI).
"""

from __future__ import annotations

import gzip
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from duskwatch.sources import logs
from duskwatch.sources import schemas as S

HOUR = 3_600_000
#: When a missing hour is passed over, and when an hour's file is not expected to grow any more.
SKIP_MS, CLOSE_MS = 65 * 60_000, 70 * 60_000
MAX_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
CHUNK = 1 << 20


@dataclass
class Limits:
    max_bytes: int = MAX_BYTES
    max_rows: int | None = None


def hour_of(name: str, tag: str | None = None, proto: str | None = None, kind: str | None = None) -> int | None:
    """The hour of a log file's name; None for other names, tags, protocols and kinds."""
    m = re.match(logs.FILE_NAME, name)
    if not m or any(want is not None and m[k] != want for k, want in ((2, tag), (4, proto), (5, kind))):
        return None
    at = datetime.strptime(m[1].replace(":", "-"), "%Y-%m-%d.%H-%M-%S").replace(tzinfo=UTC)
    return int(at.timestamp()) * 1000


def whole_lines(read: Callable[[int, int], bytes], start: int, size: int, limits: Limits, final: bool) -> tuple[int, int]:
    """Where the lines end that a batch may take from ``start``, and their number if rows are limited.

    ``read(at, n)`` gives bytes of the file, which has ``size`` of them; ``final``: nothing more will be appended.
    """
    end = min(size, start + limits.max_bytes)
    if limits.max_rows is not None:
        rows, at = 0, start
        while at < end:
            chunk = read(at, min(CHUNK, end - at))
            left = limits.max_rows - rows
            if chunk.count(b"\n") >= left:
                for _ in range(left):
                    at += chunk.index(b"\n") + 1
                    chunk = chunk[chunk.index(b"\n") + 1 :]
                return at, limits.max_rows
            rows, at = rows + chunk.count(b"\n"), at + len(chunk)
        limited = whole_lines(read, start, size, Limits(limits.max_bytes), final)[0]
        return limited, rows + (limited == size and final and limited > start and read(limited - 1, 1) != b"\n")
    if end == size and final:
        return size, 0
    at = end
    while at > start:
        n = min(CHUNK, at - start)
        if (k := read(at - n, n).rfind(b"\n")) >= 0:
            return at - n + k + 1, 0
        at -= n
    # No line ends within the limit: the one line that is longer.
    at = end
    while at < size:
        chunk = read(at, min(CHUNK, size - at))
        if (k := chunk.find(b"\n")) >= 0:
            return at + k + 1, 0
        at += len(chunk)
    return (size, 0) if final else (start, 0)


def advance(position: dict, files: dict[int, dict[str, int]], now: int, limits: Limits, read: Callable[[str, int, int], bytes]) -> dict:
    """The position after the next batch.

    ``position`` is ``next`` (the first hour that has not opened), ``open`` (hour to file to bytes read) and ``left`` (files
    of the hours that this batch leaves, with their ends); ``files`` are sizes by hour and name as they are now.
    """
    upcoming, hours = position["next"], {int(h): dict(own) for h, own in position["open"].items()}
    while upcoming <= now:
        if upcoming in files:
            hours[upcoming] = {}
        elif now <= upcoming + SKIP_MS:
            break
        upcoming += HOUR
    left_bytes, left_rows = limits.max_bytes, limits.max_rows
    still, done = {}, {}
    for hour in sorted(hours):
        own, final = hours[hour], now > hour + CLOSE_MS
        for name, size in sorted(files.get(hour, {}).items()):
            start = own.get(name, 0)
            own[name] = start
            if start >= size or left_bytes <= 0 or left_rows == 0 or (name.endswith(".gz") and not final):
                continue
            if name.endswith(".gz"):
                end, rows = size, 0
            else:
                end, rows = whole_lines(lambda at, n, f=name: read(f, at, n), start, size, Limits(left_bytes, left_rows), final)
            if end - start > left_bytes and left_bytes < limits.max_bytes:  # a long line or a compressed file waits for a batch of its own
                left_bytes = 0
                continue
            own[name], left_bytes = end, left_bytes - (end - start)
            left_rows = None if left_rows is None else left_rows - rows
        if not final or any(own.get(name, 0) < size for name, size in files.get(hour, {}).items()):
            still[str(hour)] = own
        else:
            done |= own
    return {**position, "next": upcoming, "open": still, "left": done}


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Piece(InputPartition):
    """Bytes ``first`` to ``last`` of what a batch takes of a file, ``start`` to ``end``."""

    name: str
    start: int
    end: int
    first: int
    last: int


class HourFiles(DataSource):
    """Options: path, checkpoint, tag, proto, kind, start_ms, max_bytes, max_rows, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "hourfiles"

    def schema(self) -> str:
        return "value string, file string, at long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return HourFilesReader(dict(self.options))


class HourFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.checkpoint = options["path"].rstrip("/"), options["checkpoint"].rstrip("/")
        self.names = {k: options.get(k) for k in ("tag", "proto", "kind")}
        self.start_ms = int(options["start_ms"]) if options.get("start_ms") else None
        self.limits = Limits(int(options.get("max_bytes", MAX_BYTES)), int(options["max_rows"]) if options.get("max_rows") else None)
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.position: dict | None = None
        self.key = json.dumps([self.path, *self.names.values()])

    def _files(self) -> dict[int, dict[str, int]]:
        fs, path = _file_system(self.path)
        found: dict[int, dict[str, int]] = {}
        for info in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if info.type == pafs.FileType.File and (hour := hour_of(info.base_name, **self.names)) is not None:
                found.setdefault(hour, {})[info.base_name] = info.size
        return found

    def _read(self, name: str, at: int, n: int) -> bytes:
        fs, path = _file_system(f"{self.path}/{name}")
        with fs.open_input_file(path) as f:
            return f.read_at(n, at)

    def _logged(self) -> dict | None:
        """This source's end of the last batch that the query has planned."""
        fs, path = _file_system(f"{self.checkpoint}/offsets")
        numbers = [int(i.base_name) for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if i.base_name.isdigit()]
        if not numbers:
            return None
        with fs.open_input_stream(f"{path}/{max(numbers)}") as f:
            for line in f.read().decode().splitlines():
                if line.startswith("{") and (offset := json.loads(line)).get("source") == self.key:
                    return offset
        return None

    def initialOffset(self) -> dict:
        start = self.start_ms if self.start_ms is not None else min(self._files(), default=int(time.time() * 1000))
        return {"source": self.key, "next": start - start % HOUR, "open": {}, "left": {}}

    def latestOffset(self) -> dict:
        now = int(time.time() * 1000)
        if self.position is None:
            self.position = self._logged() or self.initialOffset()
        return advance(self.position, self._files(), now, self.limits, self._read)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.position = end  # what has been planned; the next batch goes on from here
        before = {name: at for own in start["open"].values() for name, at in own.items()}
        after = {name: at for own in end["open"].values() for name, at in own.items()} | end["left"]
        pieces = []
        for name, stop in sorted(after.items()):
            first = before.get(name, 0)
            step = stop if name.endswith(".gz") else self.split_bytes
            pieces += [Piece(name, first, stop, at, min(at + step, stop)) for at in range(first, stop, max(step, 1))]
        return pieces

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        for at, block in _blocks(self._read, piece):
            lines = block.split(b"\n")
            lines = lines[:-1] if block.endswith(b"\n") else lines
            offsets, texts = [], []
            for line in lines:
                offsets.append(at)
                texts.append(line.decode("utf-8", "replace").removesuffix("\r"))
                at += len(line) + 1
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([piece.name] * len(texts), pa.string()), pa.array(offsets, pa.int64())], ["value", "file", "at"])


def _blocks(read: Callable[[str, int, int], bytes], piece: Piece) -> Iterator[tuple[int, bytes]]:
    """Blocks of whole lines that begin within a piece, with where each begins."""
    if piece.name.endswith(".gz"):
        whole = gzip.decompress(read(piece.name, piece.start, piece.end - piece.start))
        yield 0, whole
        return
    at, carried = piece.first, b""
    if at > piece.start:  # the line that a piece begins in belongs to the piece before
        at -= 1
        while at < piece.end:
            chunk = read(piece.name, at, min(CHUNK, piece.end - at))
            if (k := chunk.find(b"\n")) >= 0:
                at += k + 1
                break
            at += len(chunk)
        if at >= piece.last:
            return
    begun = at
    while at < piece.end:
        chunk = read(piece.name, at, min(CHUNK, piece.end - at))
        at += len(chunk)
        carried += chunk
        past = carried.find(b"\n", max(0, piece.last - 1 - begun)) if begun + len(carried) >= piece.last else -1
        cut = past + 1 if past >= 0 else carried.rfind(b"\n") + 1 if begun + len(carried) < piece.last else 0
        if cut:
            yield begun, carried[:cut]
            begun, carried = begun + cut, carried[cut:]
        if past >= 0:
            return
    if carried:
        yield begun, carried


def follow_lines(spark: SparkSession, path: str, checkpoint: str, **options) -> DataFrame:
    """``value, file, at`` (the byte where the line begins) of hour files while they grow.

    ``checkpoint`` is the checkpoint of the query that the table will run in; for ``options`` see :class:`HourFiles`.
    """
    spark.dataSource.register(HourFiles)
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.readStream.format("hourfiles").options(path=path, checkpoint=checkpoint, **given).load()


def follow_packets(spark: SparkSession, path: str, checkpoint: str, **options) -> tuple[DataFrame, DataFrame]:
    """Packets of growing hour files and the quarantine, with the columns of ``logs.read_packets``."""
    lines = follow_lines(spark, path, checkpoint, **options).where(F.col("value") != "|".join(S.PACKET_COLUMNS))
    typed = logs.typed_packets(lines.withColumns({"f": F.split("value", r"\|"), "name": logs.parse_file_name("file")}))
    good = typed.where("problem is null").select("packet.*", F.col("name.tag").alias("log_tag"), F.col("name.hour_ms").alias("log_hour_ms"))
    return good, typed.where("problem is not null").select("value", "file", "problem")
