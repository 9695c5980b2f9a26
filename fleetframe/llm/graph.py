"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    least = least.select("w", F.least("w", "m").alias("m"))
    return (
        both.where("v > u").join(least, F.col("u") == F.col("w"))
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    moved = down.join(least, F.col("u") == F.col("w")).where("v <> m").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots; root is the smallest node of its component.

    `links` has u and v of an ordered type. Each round is written, so a lost executor costs a
    round; the stars' centres are joined, not gathered, so a centre may have any number of links.
    """
    now = written(links.where("u <> v").select("u", "v").distinct(), "links")
    mark = None
    while True:
        now = written(_small_star(_large_star(now)), "stars")
        # Equal marks of two rounds: nothing moved, so every link is node to root.
        after = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = after
