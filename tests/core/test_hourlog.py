"""An hour log: which rows it takes, what a closed hour looks like, and crashes between its steps."""

import glob
import gzip

import pytest

from duskwatch.sources import folders, logs
from duskwatch.sources import schemas as S
from duskwatch.streaming import hourlog
from duskwatch.streaming.hourlog import HOUR, HourLog

H0 = 1_700_006_400_000


@pytest.fixture
def batch_of(spark):
    names = [c.split()[0] for c in S.PACKETS.split(", ")]
    fixed = {"saddr": 1, "daddr": 2, "ipid": 3, "ttl": 4, "proto": "tcp", "sport": 5, "dport": 6, "anum": 7, "options": "", "payload": "", "syn": 1, "ack": 0, "rst": 0, "fin": 0, "window_size": 1, "probed": False}
    return lambda hours, first=0: spark.createDataFrame([tuple({**fixed, "ts_ms": None if h is None else H0 + h * HOUR + first + k, "snum": first + k}.get(c) for c in names) for k, h in enumerate(hours)], S.PACKETS)


def closed(log):
    """Hour to the numbers of its packets, in the order of its one file."""
    out = {}
    for folder in glob.glob(f"{log.path}/date=*/hour=*"):
        files = glob.glob(f"{folder}/*.csv.gz")
        assert len(files) == 1
        lines = gzip.open(files[0], "rt").read().splitlines()
        assert lines[0] == "|".join(S.PACKET_COLUMNS) and lines[0] not in lines[1:]
        rows = [line.split("|") for line in lines[1:]]
        out[(int(rows[0][0]) - H0) // HOUR] = [int(r[9]) for r in rows]
    return dict(sorted(out.items()))


CASES = [
    # micro-batches of hours as they come; closed hours before the end; all hours; rejected
    ([[5], [5], [5]], {}, {5: [0, 100, 200]}, []),  # one hour
    ([[5], [6], [6]], {}, {5: [0], 6: [100, 200]}, []),  # the next hour
    ([[6], [5], [6]], {}, {5: [100], 6: [0, 200]}, []),  # the previous hour
    ([[5], [6], [7]], {5: [0]}, {5: [0], 6: [100], 7: [200]}, []),  # three hours
    ([[5], [8], [7]], {5: [0]}, {5: [0], 7: [200], 8: [100]}, []),  # hours are skipped; the one before the newest is open
    ([[5, 6], [5, 7], [5, 6, 7], [9]], {5: [0], 6: [1, 201], 7: [101, 202]}, {5: [0], 6: [1, 201], 7: [101, 202], 9: [300]}, [100, 200]),  # disorder
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_hours_close_as_time_moves_on(spark, batch_of, tmp_path, case):
    batches, before_end, at_end, rejected = CASES[case]
    log = HourLog(spark, str(tmp_path / "log"))
    for number, hours in enumerate(batches):
        log.write(batch_of(hours, 100 * number), number)
    assert closed(log) == before_end
    assert sorted(r["snum"] for r in log.rejected().collect()) == rejected
    log.close()
    assert closed(log) == at_end and log._staged() == {}
    good, bad = logs.read_packets(spark, log.path, start_ms=H0)
    assert sorted(r["snum"] for r in good.collect()) == sorted(n for own in at_end.values() for n in own) and bad.count() == 0


def test_arrival_orders_rows_within_a_batch(spark, batch_of, tmp_path):
    log = HourLog(spark, str(tmp_path / "log"), arrival="snum")
    log.write(batch_of([5, 7, 5, 6]), 0)
    assert closed(log) == {5: [0]} and [r["snum"] for r in log.rejected().collect()] == [2]


def test_empty_batches_and_rows_without_a_time(spark, batch_of, tmp_path):
    log = HourLog(spark, str(tmp_path / "log"))
    log.write(batch_of([]), 0)
    log.write(batch_of([5]), 1)
    log.write(batch_of([None], 700), 2)
    log.write(batch_of([]), 3)
    assert [r["snum"] for r in log.rejected().collect()] == [700]
    assert log.newest_before(4) == H0 + 5 * HOUR and closed(log) == {}


@pytest.mark.parametrize("broken", ["move", "write_text", "delete"])
def test_a_batch_is_repeated_after_a_crash(spark, batch_of, tmp_path, monkeypatch, broken):
    log = HourLog(spark, str(tmp_path / "log"))
    log.write(batch_of([5, 5]), 0)
    real = getattr(folders, broken)

    def crash(session, path, *more):
        if "_closing" in path or "/_hours/" in path or "/_open/" in path:
            raise OSError("lost")
        return real(session, path, *more)

    monkeypatch.setattr(folders, broken, crash)
    with pytest.raises(OSError):
        log.write(batch_of([5, 6, 7], 100), 1)
    monkeypatch.setattr(folders, broken, real)
    again = HourLog(spark, log.path)  # a new process repeats the micro-batch
    again.write(batch_of([5, 6, 7], 100), 1)
    assert closed(again) == {5: [0, 1]} and sorted(r["snum"] for r in again.rejected().collect()) == [100]
    again.write(batch_of([7], 200), 2)
    again.close()
    assert closed(again) == {5: [0, 1], 6: [101], 7: [102, 200]}


def test_a_batch_that_was_committed_whole_is_repeated(spark, batch_of, tmp_path):
    log = HourLog(spark, str(tmp_path / "log"), arrival="snum")
    for _ in range(2):
        log.write(batch_of([5, 6, 7]), 0)
        assert closed(log) == {5: [0]}
    log.close()
    assert closed(log) == {5: [0], 6: [1], 7: [2]}


def test_a_large_hour_is_several_files(spark, batch_of, tmp_path):
    log = HourLog(spark, str(tmp_path / "log"), rows_per_file=4)
    log.write(batch_of([5] * 10), 0)
    log.close()
    assert len(glob.glob(f"{log.path}/date=*/hour=*/*.csv.gz")) == 3
    assert sorted(r["snum"] for r in logs.read_packets(spark, log.path)[0].collect()) == list(range(10))


def test_a_stream(spark, batch_of, tmp_path):
    import os

    for k, hours in enumerate(([5], [5, 6], [8])):
        batch_of(hours, 100 * k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in glob.glob(f"{tmp_path}/in/{k}/*.parquet"):
            os.utime(f, (1_700_000_000 + k,) * 2)
    stream = spark.readStream.schema(S.PACKETS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    log = HourLog(spark, f"{tmp_path}/log")
    q = log.start(stream, f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    assert closed(log) == {5: [0, 100], 6: [101]} and hourlog.HOUR == HOUR
