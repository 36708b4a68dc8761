"""Connected components by alternating star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import forget, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("dst"), F.col("src"))).toDF("u", "v")
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    down = materialize(down, "down")
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    return moved.union(least.select(F.col("u").alias("src"), F.col("m").alias("dst"))).where("src <> dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) edges of longs -> (node, root), root being the component's smallest node.

    Nodes without an edge to another node do not appear. Edges may repeat and may point
    either way; rows with a null end and loops are left out. Every round is one table in
    the shared folder, the number of rounds grows with the logarithm of a component's
    size, and only two numbers per round reach the driver. Smallest neighbours are tables of
    their own, so that the joins with the edges are plain ones: Spark can split a node with
    very many edges.
    """
    edges = edges.toDF("src", "dst").where("src <> dst")
    now, before = materialize(_small_star(edges), "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before, old = mark, now
        now = materialize(_small_star(_large_star(old)), "edges")
        forget(old.sparkSession, old)
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(now.select("dst", "dst").distinct())
