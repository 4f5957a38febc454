"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlode.session import drop_shared, write_shared


def _settled(edges: DataFrame) -> bool:
    """Is every node either a centre or the tip of exactly one edge to a centre?"""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("src").alias("node"), one.alias("out"), none.alias("into")).union(
        edges.select("dst", none, one)
    )
    per_node = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per_node.where(F.col("out") + F.col("into") > 1).where(F.col("out") > 0).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return (
        both.join(low, "src")
        .where(F.col("dst") > F.col("src"))
        .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    ).distinct()
    low = down.groupBy("src").agg(F.min("dst").alias("low"))
    moved = (
        down.join(low, "src")
        .where(F.col("dst") != F.col("low"))
        .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    )
    return moved.union(low.select("src", F.col("low").alias("dst"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each node's component.

    Runs Spark jobs at once, one round after another until only stars are left (about log n
    rounds).  A round is written to the shared folder and the one before it removed.  The
    driver sees no more than whether a round was the last.
    """
    spark = edges.sparkSession
    current, path = write_shared(_small_star(edges.select("src", "dst").where(F.col("src") != F.col("dst"))))
    while not _settled(current):
        after, new_path = write_shared(_small_star(_large_star(current)))
        drop_shared(spark, path)
        current, path = after, new_path
    stars = current.select(F.col("src").alias("node"), F.col("dst").alias("label"))
    return stars.union(stars.select(F.col("label"), F.col("label"))).distinct()
