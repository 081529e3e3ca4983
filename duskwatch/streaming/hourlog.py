"""An hour log that is written as rows come and committed hour by hour.

Two hours are open, that of the newest row so far and the one before; a newer row moves them on, and a row older
than both is rejected.  Below the log's folder:

* ``_open/batch=N/hour_ms=H``: rows of open hours, by micro-batch, so that one that is repeated replaces what it wrote;
* ``date=/hour=``: closed hours in the layout of ``sinks.write_packet_log``, one file with one header each (or as many
  as ``rows_per_file`` asks for), which ``logs.read_packets`` reads;
* ``_hours/H``: for each closed hour, the micro-batches whose rows it has: an hour is committed once this is there;
* ``_state/N``: the newest hour after micro-batch N;
* ``_rejected/batch=N``: rejected rows, those without a time among them.

An hour is written beside the log and renamed into it, then its manifest is written, then its open rows go.  A crash
between those steps is mended by the next micro-batch: a folder without a manifest is made again from the open rows,
and a repeated micro-batch leaves out the hours whose manifests have it already.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.net import hour_ms
from duskwatch.sources import folders, sinks

HOUR = 3_600_000


@dataclass
class HourLog:
    """``arrival``: a column of numbers that orders the rows of a micro-batch as they came; without it they count as
    if the newest had come first."""

    spark: SparkSession
    path: str
    arrival: str | None = None
    rows_per_file: int = 50_000_000

    def _numbers(self, folder: str) -> list[int]:
        return sorted(int(n) for n in folders.names(self.spark, f"{self.path}/{folder}") if n.isdigit())

    def newest_before(self, number: int) -> int | None:
        """The newest hour of all micro-batches before this one."""
        earlier = [n for n in self._numbers("_state") if n < number]
        return json.loads(folders.read_text(self.spark, f"{self.path}/_state/{earlier[-1]}"))["newest"] if earlier else None

    def committed(self) -> dict[int, list[int]]:
        """Closed hours and the micro-batches whose rows they have."""
        return {h: json.loads(folders.read_text(self.spark, f"{self.path}/_hours/{h}"))["batches"] for h in self._numbers("_hours")}

    def _staged(self) -> dict[int, list[int]]:
        """Hours that have open rows, and their micro-batches."""
        out: dict[int, list[int]] = {}
        for batch in folders.names(self.spark, f"{self.path}/_open"):
            for hour in folders.names(self.spark, f"{self.path}/_open/{batch}"):
                if hour.startswith("hour_ms="):
                    out.setdefault(int(hour[8:]), []).append(int(batch[6:]))
        return out

    def write(self, batch: DataFrame, number: int) -> None:
        """Take in a micro-batch; for ``foreachBatch``."""
        batch = batch.persist()
        before = self.newest_before(number)
        top = batch.agg(F.max(hour_ms("ts_ms"))).first()[0]
        if self.arrival is None:
            newest = max(x for x in (before, top, -HOUR) if x is not None)
            late = F.coalesce(hour_ms("ts_ms") < newest - HOUR, F.lit(False))
            good, rejected = batch.where(~late), batch.where(late)
        else:
            good, rejected = sinks.split_late(batch, self.arrival, since_ms=before)
        rejected, good = rejected.unionByName(good.where("ts_ms is null")), good.where("ts_ms is not null")
        have = [h for h, batches in self.committed().items() if number in batches]
        staged = good.withColumn("hour_ms", hour_ms("ts_ms"))
        if have:
            staged = staged.where(~F.col("hour_ms").isin(have))
        staged.hint("rebalance", "hour_ms").write.mode("overwrite").partitionBy("hour_ms").parquet(f"{self.path}/_open/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{self.path}/_rejected/batch={number}")
        batch.unpersist()
        known = [x for x in (before, top) if x is not None]
        newest = max(known) if known else None
        folders.write_text(self.spark, f"{self.path}/_state/{number}", json.dumps({"newest": newest}))
        for old in [n for n in self._numbers("_state") if n < number - 1]:
            folders.delete(self.spark, f"{self.path}/_state/{old}")
        if newest is not None:
            self.close(newest - HOUR)

    def close(self, before: int | None = None) -> list[int]:
        """Commit all hours that began before ``before`` (None: all that have open rows); gives the hours."""
        done, closed = self.committed(), []
        for hour, batches in sorted(self._staged().items()):
            if before is not None and hour >= before:
                continue
            if hour not in done:
                self._commit(hour, sorted(batches))
                closed.append(hour)
            for n in batches:
                folders.delete(self.spark, f"{self.path}/_open/batch={n}/hour_ms={hour}")
        return closed

    def _commit(self, hour: int, batches: list[int]) -> None:
        at = datetime.fromtimestamp(hour // 1000, UTC)
        final, part = f"{self.path}/date={at:%Y-%m-%d}/hour={at:%H}", f"{self.path}/_closing-{uuid.uuid4().hex}"
        rows = self.spark.read.option("basePath", f"{self.path}/_open").parquet(*[f"{self.path}/_open/batch={n}/hour_ms={hour}" for n in batches])
        lines = sinks.packet_lines(rows)
        n = rows.count()
        # One task for an hour that fits in one file; a larger hour is cut by time.
        lines = lines.coalesce(1) if n <= self.rows_per_file else lines.repartitionByRange(-(-n // self.rows_per_file), F.col("ts").cast("bigint"))
        ordered = lines.sortWithinPartitions(F.col("ts").cast("bigint"))
        ordered.write.option("sep", "|").option("header", True).option("emptyValue", "").option("compression", "gzip").csv(part)
        if folders.exists(self.spark, final):  # renamed, but not committed
            folders.delete(self.spark, final)
        folders.move(self.spark, part, final)
        folders.write_text(self.spark, f"{self.path}/_hours/{hour}", json.dumps({"batches": batches, "rows": n}))

    def start(self, packets: DataFrame, checkpoint: str):
        """Write a packet stream."""
        return packets.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).start()

    def rejected(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/_rejected")
