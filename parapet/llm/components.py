"""Connected components over tables of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.storage import remove, written


def large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def roots(links: DataFrame, a: str, b: str) -> DataFrame:
    """Links between ``a`` and ``b`` -> (node, root) for every node that is not its component's least.

    Neighbour lists are never gathered: each step takes minima per node and joins them
    back, so a node with very many links is only a skewed join key.
    """
    spark = links.sparkSession
    now = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
                  "links")
    mark = None
    while True:
        at = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if at == mark or not at[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, before = at, now
        now = written(small_star(large_star(now)), "links")
        remove(spark, before)
