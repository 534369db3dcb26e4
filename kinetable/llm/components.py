"""Connected components of an edge table: alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node of the component.

    Minima are aggregated before the shuffle and joined back, so a hub of any degree is split like any other rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    norm = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    now, mark, turn = scratch.keep(edges.where("a <> b").select(*norm).distinct(), "e0"), None, 0
    while True:
        both = now.unionByName(now.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = both.groupBy(F.col("low").alias("u")).agg(F.min("high").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("high > low").join(least, F.col("low") == F.col("u")).select(F.col("m").alias("low"), "high")
        large = large.where("low <> high").distinct()
        least = large.groupBy(F.col("high").alias("u")).agg(F.min("low").alias("m"))
        small = large.join(least, F.col("high") == F.col("u")).select(F.col("m").alias("a"), F.explode(F.array("low", "high")).alias("b"))
        turn += 1
        before, now = now, scratch.keep(small.where("a <> b").select(*norm).distinct(), f"e{turn}")
        scratch.drop(f"e{turn - 1}")
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("s")).first()
        if (sums["n"], sums["s"]) == mark:
            break
        mark = sums["n"], sums["s"]
    return now.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
