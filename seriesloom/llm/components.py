"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above a node points to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its neighbours below point to the least of these."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)`` of every node that has a link; the component is its least node.

    Nodes are longs, nulls and links to itself are ignored. The two star steps
    repeat until no link changes, a number of rounds that grows with the
    logarithm of the node count; each round is written to the shared folder.
    """
    e = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct()
    before, mark = None, None
    while True:
        now = Stored(_small_star(_large_star(e)), "stars")
        sign = tuple(now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if before is not None:
            before.drop()
        if sign == mark:
            break
        before, mark, e = now, sign, now.df
    stars = now.df
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
