"""Connected components of a graph given as edges, by star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_scope, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _least(both: DataFrame) -> DataFrame:
    """Rows (u, v) with m, the least of u and its neighbours; a node with many neighbours is split by the adaptive join."""
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").withColumn("m", F.least("m", "u"))


def components(edges: DataFrame) -> DataFrame:
    """Of each node of the edges (u, v): node and label, the smallest node that it reaches. Loops and repeated edges do not matter.

    Large-star and small-star steps hang every node on ever smaller ones until nothing changes, which takes a number of
    rounds of the order of log2 of the longest chain squared. Each round is written to the shared folder."""
    with scratch_scope(edges.sparkSession):
        return stored(_contracted(edges), "components", keep=True)


def _contracted(edges: DataFrame) -> DataFrame:
    edges = stored(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select("u", "v")  # u > v: each node with its smaller neighbours
        hung = _least(down)
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.groupBy("u").agg(F.min("v").alias("v"))).where("u <> v").distinct()
        edges = stored(small, "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
