"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import discard, store


def _downward(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node now hangs on the smallest node around."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    return _downward(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours hang on the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("_m"))
    moved = links.join(least, "u").where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return _downward(moved.unionByName(least.select("u", F.col("_m").alias("v"))))


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (two long columns, any order, repeats allowed); root is the least node.

    Each round is a few joins and sums over the links alone and is written to the shared folder; rounds grow with the
    logarithm of the longest path. Hubs are summed up before they are shuffled, and their joins can be split.
    """
    a, b = links.columns
    links = store(_downward(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    mark = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        after = store(_small_star(_large_star(links)), "links")
        discard(links)
        links = after
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
