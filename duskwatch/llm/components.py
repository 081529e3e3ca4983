"""Connected components of a link table, by star contraction in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of a link that is not the smallest of its component.

    ``label`` is the smallest node reachable.  Large-star and small-star steps alternate until
    nothing changes, which takes a number of rounds that grows with the logarithm of the nodes;
    each round is one job over the links that remain, written to the shared folder.  Links with a
    null end and links of a node to itself say nothing and are dropped; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
    edges = written(edges.distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
        state = now
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        roots = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(roots, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = written(small.unionByName(roots.select("hi", F.col("m").alias("lo"))).distinct(), "links")
