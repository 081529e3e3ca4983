"""Growing hour files: what a batch may take, which hours open, pass and close, and restarts."""

import gzip
import random

import pytest

from duskwatch.streaming import tail
from duskwatch.streaming.tail import CLOSE_MS, HOUR, SKIP_MS, Limits, advance, whole_lines

H0 = 1_700_006_400_000


def name(hour, suffix="csv", tag="here"):
    from datetime import UTC, datetime

    return f"{datetime.fromtimestamp(hour / 1000, UTC):%Y-%m-%d.%H-%M-%S}.{tag}.prog.tcp.raw.{hour // 1000}.{suffix}"


def reader(data):
    return lambda at, n: data[at : at + n]


def test_names():
    assert tail.hour_of(name(H0)) == H0 == tail.hour_of(name(H0).replace("-00-00.", ":00:00.", 1), tag="here", proto="tcp", kind="raw")
    assert tail.hour_of(name(H0), tag="there") is None and tail.hour_of("x.csv") is None


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_whole_lines_within_limits(monkeypatch, chunk):
    monkeypatch.setattr(tail, "CHUNK", chunk)
    data = b"aa\nbbbb\n\ncc\npart"
    ends = lambda start, final=False, **limits: whole_lines(reader(data), start, len(data), Limits(**limits), final)[0]
    assert ends(0, max_bytes=100) == 12 and ends(0, True, max_bytes=100) == 16 and ends(12, max_bytes=100) == 12
    assert [ends(0, max_bytes=n) for n in (3, 7, 8, 9, 11)] == [3, 3, 8, 9, 9]
    assert ends(3, max_bytes=2) == 8  # a line longer than the limit goes alone
    assert [ends(0, max_bytes=100, max_rows=n) for n in (1, 2, 3, 4, 9)] == [3, 8, 9, 12, 12]
    assert whole_lines(reader(data), 9, 16, Limits(100, 9), True) == (16, 2) and ends(0, max_bytes=8, max_rows=9) == 8


def test_hours_open_pass_and_close():
    files, start = {}, {"next": H0, "open": {}, "left": {}}
    step = lambda position, now, **limits: advance(position, files, now, Limits(**limits), lambda f, at, n: ((b"x" * 9 + b"\n") * 100)[at : at + n])
    assert step(start, H0 + SKIP_MS) == start  # the hour may still come
    assert step(start, H0 + SKIP_MS + 1)["next"] == H0 + HOUR  # it is passed over
    files = {H0: {"a.csv": 20}}
    one = step(start, H0 + 1)
    assert one == {"next": H0 + HOUR, "open": {str(H0): {"a.csv": 20}}, "left": {}}
    files = {H0: {"a.csv": 20}, H0 + HOUR: {"b.csv": 10}}
    two = step(one, H0 + HOUR)
    assert two["open"] == {str(H0): {"a.csv": 20}, str(H0 + HOUR): {"b.csv": 10}} and two["next"] == H0 + 2 * HOUR
    files[H0]["late.csv"] = 10  # another file of an open hour
    assert step(two, H0 + HOUR + 9)["open"][str(H0)] == {"a.csv": 20, "late.csv": 10}
    assert str(H0) in step(two, H0 + CLOSE_MS)["open"]
    assert step(two, H0 + CLOSE_MS + 1) == {"next": H0 + 2 * HOUR, "open": {str(H0 + HOUR): {"b.csv": 10}}, "left": {"a.csv": 20, "late.csv": 10}}
    files[H0]["a.csv"] = 90  # what is there is read before the hour is left
    small = step(two, H0 + CLOSE_MS + 1, max_bytes=30)
    assert small["open"][str(H0)] == {"a.csv": 50, "late.csv": 0}
    # A gap of hours, with one of them there at last.
    files = {H0 + 5 * HOUR: {"f.csv": 10}}
    assert step(start, H0 + 5 * HOUR + 1)["next"] == H0 + 4 * HOUR  # the fourth may still come
    gap = step(start, H0 + 5 * HOUR + 6 * 60_000)
    assert gap == {"next": H0 + 6 * HOUR, "open": {str(H0 + 5 * HOUR): {"f.csv": 10}}, "left": {}}
    # A file of an hour that was passed over is not read.
    files = {H0: {"a.csv": 20}}
    assert step({"next": H0 + HOUR, "open": {}}, H0 + HOUR)["open"] == {}


def test_compressed_files_are_read_once_their_hour_is_left():
    files, start = {H0: {"a.csv.gz": 500, "b.csv": 10}}, {"next": H0, "open": {}}
    step = lambda position, now: advance(position, files, now, Limits(100), lambda f, at, n: b"x" * 9 + b"\n")
    one = step(start, H0 + 1)
    assert one["open"] == {str(H0): {"a.csv.gz": 0, "b.csv": 10}}
    two = step(one, H0 + CLOSE_MS + 1)
    assert two["open"] == {} and two["left"] == {"a.csv.gz": 500, "b.csv": 10}


@pytest.mark.parametrize("chunk", [5, 1 << 20])
def test_pieces_of_any_size_give_each_line_once(monkeypatch, chunk):
    monkeypatch.setattr(tail, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(300):
        lines = ["".join(rng.choice("ab") for _ in range(rng.choice((0, 1, 3, 30)))) for _ in range(rng.randint(1, 8))]
        data = b"skip\n" + "\n".join(lines).encode() + (b"\n" if rng.random() < 0.7 else b"")
        start, split, got = 5, rng.randint(1, 20), []
        for at in range(start, len(data), split):
            piece = tail.Piece("f.csv", start, len(data), at, min(at + split, len(data)))
            for begun, block in tail._blocks(lambda f, a, n: data[a : a + n], piece):
                assert data[begun : begun + len(block)] == block
                got += (block[:-1] if block.endswith(b"\n") else block).split(b"\n")
        want = data[start:]
        assert got == (want[:-1] if want.endswith(b"\n") else want).split(b"\n") if want else got == []


def write(path, text, mode="a"):
    with open(path, mode) as f:
        f.write(text)


def test_a_stream_over_growing_files_and_restarts(spark, tmp_path):
    """Rows come once each, over appends, a partial line, restarts and a batch that failed; no batch passes the bound."""
    (tmp_path / "log").mkdir()
    log, sizes, rows = tmp_path / "log", [], []
    line = lambda hour, k: f"{hour}-{k:05d}"
    limit, fail = 2000, []

    def sink(batch, number):
        got = [(r["file"], r["at"], r["value"]) for r in batch.collect()]
        if fail:
            fail.pop()
            raise RuntimeError("lost")
        sizes.append(sum(len(v) + 1 for f, _, v in got if not f.endswith(".gz")))
        rows.extend(v for _, _, v in got)

    def run():
        lines = tail.follow_lines(spark, str(log), f"{tmp_path}/ck", max_bytes=limit, split_bytes=300)
        return lines.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/ck").start()

    def drain():
        q = run()
        q.processAllAvailable()
        q.stop()

    import time

    now = int(time.time() * 1000)
    hours = [now - now % HOUR - 5 * HOUR, now - now % HOUR - 2 * HOUR, now - now % HOUR]  # the hours between are missing
    write(log / name(hours[0]), "".join(line(0, k) + "\n" for k in range(400)) + "0-last")
    write(log / name(hours[1]), "".join(line(1, k) + "\n" for k in range(300)))
    with gzip.open(log / name(hours[0], "csv.gz", "zip"), "wt") as f:
        f.write("".join(line(9, k) + "\n" for k in range(50)))
    (log / "README").write_text("not a log\n")
    drain()
    want = [line(0, k) for k in range(400)] + ["0-last"] + [line(1, k) for k in range(300)] + [line(9, k) for k in range(50)]
    assert sorted(rows) == sorted(want) and max(sizes) <= limit and len(sizes) >= 3
    current = log / name(hours[2])
    write(current, "".join(line(2, k) + "\n" for k in range(100)) + "2-par")
    drain()  # after a restart: only what is new, and no partial line
    want += [line(2, k) for k in range(100)]
    assert sorted(rows) == sorted(want)
    write(current, "tial\n" + "".join(line(3, k) + "\n" for k in range(600)))
    fail.append(1)
    q = run()
    with pytest.raises(Exception):
        q.processAllAvailable()
    drain()  # the failed batch is repeated as it was planned
    want += ["2-partial"] + [line(3, k) for k in range(600)]
    assert sorted(rows) == sorted(want) and max(sizes) <= limit


def test_packets_of_growing_files(spark, tmp_path):
    from tests.core.test_files import BAD, GOOD, HEADER, UDP

    write(tmp_path / name(H0), "\n".join([HEADER, GOOD, UDP, *BAD]) + "\n")
    good, bad = tail.follow_packets(spark, str(tmp_path), f"{tmp_path}/ck", start_ms=H0)
    for df, key, want in ((good, "proto", ["tcp", "udp"]), (bad, "problem", ["number of fields", "saddr", "ttl"])):
        q = df.writeStream.format("memory").queryName(f"tail_{key}").option("checkpointLocation", f"{tmp_path}/ck").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(r[key] for r in spark.table(f"tail_{key}").collect()) == want
        import shutil

        shutil.rmtree(tmp_path / "ck")
