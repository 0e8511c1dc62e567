"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.storage import discard, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (u, v).  Hang the neighbours of each node on the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = both.join(least, "u")
    if large:
        out = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Smallest node reachable from every node of ``edges`` (u, v): columns ``node, label``.

    Nodes without an edge are not listed.  Every round is written to the shared
    folder; the number of rounds grows with the logarithm of the size of a
    component.  It ends when every node but the smallest hangs on the smallest
    alone.  Raises if ``max_rounds`` do not suffice.
    """
    now = staged(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(now.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if ends.filter((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
        last, now = now, staged(_star(_star(now, True), False), "edges")
        discard(last)
    raise RuntimeError("components did not settle")
