"""Connected components by alternating star contraction, for edge lists of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp) with comp the smallest node reachable, for every node of edges(a, b).

    Each round links a node's neighbours to the smallest one: first the larger neighbours
    (large star), then the smaller ones (small star). Both are grouped minima, combined
    before the shuffle, and a join of edges with one row per node, which AQE splits for a
    node of many edges. Every round is checkpointed; the loop ends when a round changes
    nothing. Self-loops keep a node alone. Nulls are dropped. No edges give no rows.
    """
    e = edges.where("a is not null and b is not null")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = cut(e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut(small.where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
