"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import remove, saved, scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b), a component's name being its least node.

    Each round points neighbours at a smaller node; rounds grow with the logarithm of
    the longest path. Every round is written out and then goes. Neighbours are aggregated before the
    shuffle and joined back, so a node may have any number of them.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def written(pairs: DataFrame) -> tuple[DataFrame, str, tuple]:
        """The table, its path, and a mark of its rows that is taken while they are written."""
        seen, path = Observation(), scratch(spark)
        df = saved(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")), path)
        return df, path, (seen.get["n"], seen.get["mark"])

    spark = edges.sparkSession
    now, path, before = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        down = both.join(least(both), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = down.join(least(down), "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()
        now, last, after = written(small)
        remove(spark, path)
        path = last
        if after == before:
            break
        before = after
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
