"""One ordered pass per key: rows are dealt by key, sorted, and a task keeps the state of the key at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with the rows of a key in one partition, next to each other and in order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def flag_in_order(df: DataFrame, keys: list[str], order: list[str], name: str, fold: Callable[[], Callable[[tuple], bool]], drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds the flag ``name``: what a key's fold says of its rows' ``order`` and ``drop`` columns, row by row."""
    kept = [c for c in df.columns if c not in drop]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T.BooleanType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            flags = []
            rows = zip(*[batch.column(c).to_pylist() for c in [*order, *drop]])
            for own, row in zip(zip(*[batch.column(k).to_pylist() for k in keys]), rows):
                if own != key:
                    key, step = own, fold()
                flags.append(step(row))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(flags, pa.bool_())], [*kept, name])

    return dealt(df, keys, order).mapInArrow(walk, schema)
