"""Exact, linearly interpolated quantiles for groups of any size.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer.  That is right for groups with a known small bound.  For open-ended
groups a bounded sketch brackets each wanted rank; one more pass counts what
lies outside the bracket and keeps only the distinct values inside it, so the
answer stays exact while no group is gathered whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def bounded_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """One-pass variant for groups whose size has a fixed bound (a clip, a permutation draw, K states)."""
    return df.groupBy(*keys).agg(*[F.percentile(F.col(value), F.lit(float(p))).alias(n) for n, p in probs.items()])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], accuracy: int = 10000
) -> DataFrame:
    """One row per group with a column per wanted probability; NULL values are ignored."""
    names = list(probs)
    overall = not keys
    keys = ["_all"] if overall else list(keys)
    d = df.withColumn("_all", F.lit(0)).select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    eps = 3.0 / accuracy
    edges = sorted({e for p in probs.values() for e in (max(0.0, p - eps), min(1.0, p + eps))})
    sketch = d.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", [float(e) for e in edges], F.lit(accuracy)).alias("_e")
    )

    def edge(x: float):
        return F.col("_e")[edges.index(x)]

    wanted = F.array(*[
        F.struct(
            F.lit(i).alias("q"),
            F.lit(float(p)).alias("prob"),
            edge(max(0.0, p - eps)).alias("lo"),
            edge(min(1.0, p + eps)).alias("hi"),
        )
        for i, p in enumerate(probs.values())
    ])
    brackets = sketch.select(*keys, "_n", wanted.alias("_w"))
    # an overall quantile has one bracket row; otherwise there may be as many as groups, which must not pass the driver
    joined = d.join(F.broadcast(brackets) if overall else brackets.hint("merge"), keys)
    side = F.when(F.col("_v") < F.col("w.lo"), 0).when(F.col("_v") > F.col("w.hi"), 2).otherwise(1)
    counted = (
        joined.select(*keys, "_n", "_v", F.explode("_w").alias("w"))
        .select(*keys, "_n", F.col("w.q").alias("_q"), F.col("w.prob").alias("_prob"), "_v", side.alias("_side"))
        .groupBy(*keys, "_n", "_q", "_prob", "_side", F.when(F.col("_side") == 1, F.col("_v")).alias("_inside"))
        .agg(F.count("*").alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    )
    run = W.partitionBy(*keys, "_q").orderBy("_side", "_inside").rowsBetween(W.unboundedPreceding, 0)
    pos = (F.col("_n") - 1) * F.col("_prob")
    ranked = counted.withColumns({"_cum": F.sum("_c").over(run), "_r0": F.floor(pos) + 1, "_r1": F.ceil(pos) + 1})

    def at_rank(r: str):
        here = (F.col("_cum") - F.col("_c") < F.col(r)) & (F.col(r) <= F.col("_cum"))
        low = F.when(F.col(r) == F.col("_cum"), F.col("_mx"))
        high = F.when(F.col(r) == F.col("_cum") - F.col("_c") + 1, F.col("_mn"))
        outside = F.coalesce(
            F.when(F.col("_side") == 0, low).otherwise(high),
            F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"),
        )
        return F.when(here, F.when(F.col("_side") == 1, F.col("_inside")).otherwise(outside))

    picked = ranked.groupBy(*keys, "_q", "_prob", "_n").agg(
        F.max(at_rank("_r0")).alias("_a"), F.max(at_rank("_r1")).alias("_b")
    )
    frac = (F.col("_n") - 1) * F.col("_prob") - F.floor((F.col("_n") - 1) * F.col("_prob"))
    picked = picked.withColumn("_val", F.col("_a") + (F.col("_b") - F.col("_a")) * frac)
    out = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_q") == i, F.col("_val"))).alias(n) for i, n in enumerate(names)]
    )
    return out.drop("_all")
