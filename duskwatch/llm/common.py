"""What the operators share: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local run gets a folder of its own; a cluster run is refused, since a
    folder of one machine would be missing on the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return path.rstrip("/")


_local: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _paths.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


_paths: ContextVar[list[str] | None] = ContextVar("paths", default=None)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables written inside, in order, so that they can be deleted once nothing needs them."""
    token = _paths.set(paths := [])
    try:
        yield paths
    finally:
        _paths.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables from the shared folder."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> int:
    """A partition count for a shuffle of ``df``'s rows: the session's, at least the scan's."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The given helper names, lengthened until none clashes with a column (case ignored)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
