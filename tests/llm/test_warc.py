"""WARC: exact round trips, and record types against brute force."""

import base64
import glob
import gzip
import hashlib
import io
import os
import uuid

import pytest

from duskwatch.llm import warc
from duskwatch.llm.common import shared_dir


@pytest.fixture
def pages_of(spark):
    return lambda rows: spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, target int")


def through(spark, pages, **options):
    base = f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"
    warc.write_archives(pages, f"{base}/raw", **options)
    index = warc.normalise(spark, f"{base}/raw", f"{base}/normal")
    return base, index, warc.read_archives(spark, f"{base}/normal")


ROWS = [(1, "http://a/ b\n", "same"), (2, None, "same"), (3, "http://c/", "sä😀me\r\n\r\nWARC/1.1"), (4, "u", None), (5, "u", ""), (None, "n", "same"), (7, "v", "x" * 300_000), (8, "v", "x" * 300_000)]


def test_types_digests_and_lengths(spark, pages_of):
    _, _, read = through(spark, pages_of(ROWS))
    got = sorted((tuple(r) for r in read.collect()), key=str)
    top = {}
    for i, _, h in ROWS:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in ROWS:
        payload = (h or "").encode()
        revisit = i != top[h or ""]
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", top[h or ""] if revisit else None))
    assert got == sorted(want, key=str)


def test_index_reaches_every_record_and_members_join_to_the_raw_stream(spark, pages_of):
    base, index, _ = through(spark, pages_of(ROWS))
    local = base.removeprefix("file://")
    files = {p.rsplit("/", 1)[1]: open(p, "rb").read() for p in glob.glob(f"{local}/normal/archives/*.warc.gz")}
    rows = index.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        data = warc.read_record(files[r["archive"]], r["offset"], r["length"])
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
    raw = b"".join(sorted(gzip.decompress(open(p, "rb").read()) for p in glob.glob(f"{local}/raw/*.gz")))
    assert raw == b"".join(sorted(gzip.decompress(f) for f in files.values()))


def test_small_payloads_can_be_left_out_of_revisits(spark, pages_of):
    _, _, read = through(spark, pages_of([(1, "u", ""), (2, "u", ""), (3, "u", "long"), (4, "u", "long")]), revisit_bytes=1)
    assert sorted((r["page_id"], r["record_type"]) for r in read.collect()) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_a_repeated_normalisation_leaves_the_same_files(spark, pages_of):
    base, index, _ = through(spark, pages_of(ROWS))
    local = base.removeprefix("file://")
    before = {p: open(p, "rb").read() for p in glob.glob(f"{local}/normal/archives/*")}
    want = sorted(map(tuple, index.collect()))
    os.rename(f"{local}/normal/index", f"{local}/old-index")
    again = warc.normalise(spark, f"{base}/raw", f"{base}/normal")  # every archive is there already
    assert sorted(map(tuple, again.collect())) == want
    assert {p: open(p, "rb").read() for p in glob.glob(f"{local}/normal/archives/*")} == before


def test_a_failed_normalisation_leaves_no_part(spark, pages_of, monkeypatch):
    base, _, _ = through(spark, pages_of(ROWS[:3]))
    local = base.removeprefix("file://")
    for p in glob.glob(f"{local}/raw/*.gz"):
        data = open(p, "rb").read()
        open(p, "wb").write(data[:-9])
    with pytest.raises(Exception, match="truncated"):
        warc.normalise(spark, f"{base}/raw", f"{base}/other").count()
    assert glob.glob(f"{local}/other/archives/.*.gz.*") == []


def test_the_query_leaves_no_raw_archives(spark):
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/warc-*"))
    assert warc.query(spark, "/root/testdata/sf0.001").count() == 50
    (new,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/warc-*")) - before
    assert sorted(os.listdir(new)) == ["normal"]


def test_empty_table(spark, pages_of):
    _, index, read = through(spark, pages_of([]))
    assert index.count() == read.count() == 0


def test_damage_is_an_error():
    with pytest.raises(ValueError, match="truncated"):
        list(warc._inflated(io.BytesIO(gzip.compress(b"a" * 1000)[:-9])))
    with pytest.raises(ValueError, match="cut off"):
        list(warc._records(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"])))


def test_several_members_and_padding_are_one_stream():
    for step in (1, 7, 1 << 16):
        data = gzip.compress(b"a" * 100) + bytes(9) + gzip.compress(b"") + gzip.compress(b"b" * 50) + bytes(3)
        assert b"".join(warc._inflated(io.BytesIO(data), step)) == b"a" * 100 + b"b" * 50
    assert list(warc._inflated(io.BytesIO(b""))) == []


def test_archives_are_rolled_by_bytes_and_read_by_ranges(spark, pages_of, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(warc, "RANGE_BYTES", 700)
    rows = [(i, f"http://a/{i}", f"{i} " + "".join(chr(97 + (i * j) % 26) for j in range(2000))) for i in range(100)]
    base, index, read = through(spark, pages_of(rows).coalesce(1))
    assert index.select("archive").distinct().count() >= 10
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in read.collect()}
    assert got == {i: (len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, _, h in rows}
