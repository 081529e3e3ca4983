"""Keyed stores: newest entry wins, lookups with a default, generations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_stores(*stores: DataFrame) -> DataFrame:
    """``addr, ts, consistent``: per address the newest time, and whether all its entries at that
    time are consistent.  One aggregation: the pair (time, not consistent) is largest for the
    newest time and, within it, for an inconsistent entry."""
    rows = reduce(DataFrame.unionByName, stores)
    best = rows.groupBy("addr").agg(F.max(F.struct("ts", (~F.col("consistent")).alias("bad"))).alias("m"))
    return best.select("addr", F.col("m.ts").alias("ts"), (~F.col("m.bad")).alias("consistent"))


def store_lookup(keys: DataFrame, store: DataFrame) -> DataFrame:
    """``addr`` rows with their entry, (0, false) where there is none."""
    return keys.join(store, "addr", "left").select(*keys.columns, F.coalesce("ts", F.lit(0)).alias("ts"), F.coalesce("consistent", F.lit(False)).alias("consistent"))


def remove_if(store: DataFrame, predicate: Column) -> DataFrame:
    """Entries for which the predicate does not hold (null keeps)."""
    return store.where(~F.coalesce(predicate, F.lit(False)))


def age_out(store: DataFrame, now: int, max_age: int, keep_one_in: int = 4, seed: int = 0) -> DataFrame:
    """Drop entries older than ``max_age``, each kept with chance 1 in ``keep_one_in``, by address hash."""
    lucky = F.pmod(F.xxhash64("addr", F.lit(seed)), F.lit(keep_one_in)) == 0
    return store.where((F.col("ts") >= now - max_age) | lucky)


def latest_in_generations(entries: DataFrame, n: int = 4) -> DataFrame:
    """``addr, ts, consistent, gen``: the entry of the newest of the last ``n`` generations.

    ``entries`` has ``addr, gen, ts, consistent``; within a generation the newest entry counts.
    """
    newest = entries.agg(F.max("gen").alias("top")).first()["top"]
    live = entries.where(F.col("gen") > (newest or 0) - n)
    return live.groupBy("addr").agg(F.max_by(F.struct("ts", "consistent", "gen"), F.struct("gen", "ts")).alias("e")).select("addr", "e.*")
