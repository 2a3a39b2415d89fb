"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.storage import drop_path, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges(src, dst)``; the component is its smallest node.

    Each round turns edges towards smaller neighbours (large star) and gathers a node's smaller neighbours under the
    least of them (small star); it ends when a round changes no edge. Rounds grow with the logarithm of the longest
    path. Every round is one written table, and the one before is dropped. The driver sees two numbers per round.
    Self-loops and rows with a null end are ignored; an empty table gives no rows.
    """
    spark = edges.sparkSession
    current = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    current, path = materialize(current, "edges")
    mark = _fingerprint(current)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        turned = small.select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").union(small.select("a", "m")).toDF("a", "b").distinct()
        after, new_path = materialize(turned, "edges")
        new_mark = _fingerprint(after)
        drop_path(spark, path)
        current, path = after, new_path
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")).head()
    return row.n, row.x, row.s
