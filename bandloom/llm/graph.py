"""Connected components as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b longs): root is the smallest node that links reach.

    Alternating large-star and small-star rounds; each round is aggregations and joins on node ids, written to the
    shared folder, and the number of rounds grows with the logarithm of a component's size. Self links and nulls are
    ignored; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    folder = shared_folder(spark, "components")
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = stored(edges.where("a is not null and b is not null and a <> b").select(high, low).distinct(), f"{folder}/start")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
    seen = now.agg(mark).first()[0]
    for k in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(root.withColumnRenamed("m", "v")).distinct(), f"{folder}/{k}")
        mark_now = now.agg(mark).first()[0]
        if mark_now == seen:
            break
        seen = mark_now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
