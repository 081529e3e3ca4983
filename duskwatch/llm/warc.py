"""WARC archives: writing, normalising monolithic gzip, and reading back.

``write_archives`` lays out one record per page and lets Spark's own text sink write them, so each
archive is one gzip stream (what crawlers call a monolithic archive) in any store Spark can write.
``normalise`` inflates each such stream once, from front to back, rewrites every record as a gzip
member of its own and writes a sidecar index of offsets, so that a reader can later fetch one
record.  ``read_archives`` reads normalised archives through that index: its entries are cut into
ranges of about ``RANGE_BYTES``, a task fetches a range's bytes and no more, inflates its members,
checks payload digests and returns one row per record.  Spark only lists archives; tasks open them
as streams and hold one record or one range, however long an archive is.

Of the records with equal payloads of at least ``revisit_bytes`` bytes, the one with the largest
page id is the response and the others revisit it; their records carry no payload, only its digest
and length.  Payloads never meet in one place: a page is matched with its group's largest id by an
equi join on the digest, whose hot keys Spark can split.

Defined cases: null html is an empty payload; a payload may have any length that a record's cell can
hold (2 GB); a null url gives a record without target; control characters and blanks in urls are
percent-encoded; a null page id is smaller than all others; rows of the largest id and equal payload
are all responses; other columns are not read; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.llm.common import delete, shared_dir, spread, table

DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = "\r\n\r\n"
#: Archives are rolled after about so many bytes of payload; ranges of an archive are read as so many.
ARCHIVE_BYTES, RANGE_BYTES = 64 << 20, 8 << 20
_RECORDS_A_FILE = 50_000
_INDEX = "archive string, record_no int, offset long, length long, page_id long, record_type string, payload_digest string"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _safe_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One record without its closing blank lines."""
    block = b"" if revisit else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe_url(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = 0) -> None:
    """Write the pages (page_id, url, html) as monolithic gzip archives into a new folder."""

    @F.pandas_udf(T.BinaryType())
    def packed(html: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress((h or "").encode(), 3) for h in html], dtype=object)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sha1 = F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1")
    keys = rows.select("page_id", sha1, F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"))
    mean = keys.agg(F.avg("bytes").alias("mean")).first()["mean"] or 0.0
    groups = keys.where(F.col("bytes") >= revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("c")).where("c > 1").select("sha1", "target")
    rows = rows.select("page_id", "url", packed("html").alias("z"), sha1).join(groups.withColumn("grouped", F.lit(True)), "sha1", "left")

    def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, url, z, digest, target, grouped in zip(pdf["page_id"].astype("Int64"), pdf["url"], pdf["z"], pdf["sha1"], pdf["target"].astype("Int64"), pdf["grouped"]):
                page_id, target = (None if pd.isna(x) else int(x) for x in (page_id, target))
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                out.append(record(page_id, url, zlib.decompress(z), digest, target, grouped is True and page_id != target).decode())
            yield pd.DataFrame({"value": out})

    records = rows.select("page_id", "url", "z", "sha1", "target", "grouped").mapInPandas(lay_out, "value string")
    a_file = int(min(max(ARCHIVE_BYTES // (mean + 600), 1), _RECORDS_A_FILE))
    records.write.option("compression", "gzip").option("lineSep", _END).option("maxRecordsPerFile", a_file).text(path)


def _inflated(stream, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of an open file of one or more gzip members, with or without zeros between them."""
    member, piece = None, stream.read(step)
    while piece:
        if member is None:
            piece = piece.lstrip(b"\0")
            member = zlib.decompressobj(31) if piece else None
        if member is not None:
            yield member.decompress(piece)
            piece = member.unused_data
            member = None if member.eof else member
        piece = piece or stream.read(step)
    if member is not None:
        raise ValueError("truncated gzip stream")


def _headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Cut an inflated stream into records, each with its closing blank lines."""
    buffer = bytearray()
    need = None
    for piece in pieces:
        buffer += piece
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(_headers(bytes(buffer[:end]))["Content-Length"]) + 4
            if len(buffer) < need:
                break
            if buffer[need - 4 : need] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("the last record is cut off")


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _page(headers: dict[str, str], name: str) -> int | None:
    return int(headers[name]) if name in headers else None


def _opened(folder: str, name: str):
    """A file of a folder of the shared store, for reading any part of it."""
    store, path = fs.FileSystem.from_uri(folder)
    return store.open_input_file(f"{path}/{name}")


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite archives so that each record is a gzip member of its own; returns the index.

    ``archive, record_no, offset, length, page_id, record_type, payload_digest``: the sidecar
    index, also kept as a table under ``<target>/index``.  A task streams one archive at a time
    and holds one record; it writes under a name of its own and renames, so that a repeated task
    leaves the same files.  ``source`` and ``target`` must be folders all executors reach.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    schema = T._parse_datatype_string(_INDEX)
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            raw = posixpath.basename(path)
            name = raw.removesuffix(".gz").removesuffix(".txt") + ".warc.gz"
            store, folder = fs.FileSystem.from_uri(target)
            own, rows, at = f"{folder}/archives/.{name}.{uuid.uuid4().hex}", [], 0
            store.create_dir(f"{folder}/archives", recursive=True)
            try:
                with _opened(source, raw) as stream, store.open_output_stream(own) as out:
                    for k, data in enumerate(_records(_inflated(stream))):
                        member = _member(data)
                        out.write(member)
                        h = _headers(data[: data.index(b"\r\n\r\n")])
                        rows.append((name, k, at, len(member), _page(h, "X-Page-Id"), h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")))
                        at += len(member)
                        if len(rows) == 10_000:
                            yield _columns(rows, kinds, schema.names)
                            rows = []
                _put(store, own, f"{folder}/archives/{name}")
            except BaseException:
                _drop(store, own)
                raise
            if rows:
                yield _columns(rows, kinds, schema.names)

    files.mapInArrow(rewrite, _INDEX).write.parquet(f"{target}/index")
    return spark.read.schema(_INDEX).parquet(f"{target}/index")


def _drop(store: fs.FileSystem, path: str) -> None:
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)


def _put(store: fs.FileSystem, own: str, path: str) -> None:
    """Rename a finished file; one that an earlier attempt of the task has left, with the same bytes, goes first,
    since not every file system renames over another."""
    _drop(store, path)
    store.move(own, path)


def _columns(rows: list[tuple], kinds, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def read_record(content: bytes, offset: int, length: int) -> bytes:
    """One record of a normalised archive, by its index entry."""
    return zlib.decompress(content[offset : offset + length], 31)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record in the index.

    Length and digest of a response are taken from its payload, and a digest that disagrees with
    the record's own header is an error; those of a revisit are its headers'.
    """
    index = spark.read.schema(_INDEX).parquet(f"{target}/index")
    ranges = index.groupBy("archive", F.floor(F.col("offset") / RANGE_BYTES).alias("range")).agg(F.min("offset").alias("start"), F.sum("length").alias("bytes"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("members"))
    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(spread(index), total // (4 * RANGE_BYTES))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (r for batch in batches for r in batch.to_pylist()):
            with _opened(f"{target}/archives", part["archive"]) as file:
                file.seek(part["start"])
                content = file.read(part["bytes"])
            rows = []
            for m in part["members"]:
                data = read_record(content, m["offset"] - part["start"], m["length"])
                end = data.index(b"\r\n\r\n")
                h = _headers(data[:end])
                size, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                if h["WARC-Type"] == "response":
                    block = data[end + 4 : -4]
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if (len(payload), payload_digest(payload)) != (size, digest):
                        raise ValueError(f"record {h['WARC-Record-ID']} is damaged")
                rows.append((_page(h, "X-Page-Id"), size, digest, h["WARC-Type"], _page(h, "X-Refers-To-Page")))
            yield _columns(rows, kinds, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return ranges.select("archive", "start", "bytes", "members").repartition(tasks, "archive", "start").mapInArrow(parse, _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: written, normalised and read back."""
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), f"{base}/raw")
    normalise(spark, f"{base}/raw", f"{base}/normal")
    delete(spark, [f"{base}/raw"])  # the index is written, so nothing reads them again
    return read_archives(spark, f"{base}/normal")


#: Base32 of a SHA-1 by hand: character i takes 5 bits from the two hex digits they lie in.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS x FROM p),
b AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((instr('0123456789abcdef', substr(x, CAST(i * 5 // 4 AS BIGINT) + 1, 1)) - 1) * 16
      + (CASE WHEN i * 5 // 4 + 2 > 40 THEN 1 ELSE instr('0123456789abcdef', substr(x, CAST(i * 5 // 4 AS BIGINT) + 2, 1)) END - 1)) >> CAST(3 - i * 5 % 4 AS INTEGER)) & 31), 1)
  ), 'string_agg', '') AS payload_digest FROM d),
g AS (SELECT payload_digest, max(page_id) AS target FROM b GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM target THEN target END AS refers_to
FROM b JOIN g USING (payload_digest)
"""
