"""Connected components of a graph that only the cluster can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.materialize import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v: long); root is the component's smallest node.

    Alternating stars: a large star hangs the larger neighbours of each node on its smallest
    neighbour, a small star the smaller ones; rounds go as the logarithm of the longest path.
    Minima are settled before they meet the edges again, so the join is one that Spark can split
    where a hub has a large part of the edges. Loops and repeated edges don't matter; no edges:
    no rows.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = settle(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")))
        large = settle(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct())
        least = settle(large.groupBy("u").agg(F.min("v").alias("w")))
        now = settle(large.join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").union(least).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
