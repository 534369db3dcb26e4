"""Mid-ranks and rank counts for groups of any size.

Values are first merged per (group, value), then cut into value ranges taken
from a bounded sketch, so the running counts of one large group are spread
over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.plans.chunks import prefix_sum

EDGES = 64


def value_range(df: DataFrame, keys: Sequence[str], value: str, edges: int = EDGES) -> DataFrame:
    """Add ``_range``: number of sketch edges below the value, growing with the value inside each group."""
    probs = [i / edges for i in range(1, edges)]
    sketch = df.groupBy(*keys).agg(F.percentile_approx(value, probs, F.lit(2000)).alias("_edges"))
    v = F.col(value)
    out = df.join(sketch, list(keys))
    return out.withColumn("_range", F.size(F.filter("_edges", lambda e: e < v)).cast("long")).drop("_edges")


def tie_table(df: DataFrame, keys: Sequence[str], value: str, counts: Mapping[str, str | Column]) -> DataFrame:
    """One row per distinct value and group with summed ``counts`` and their running sums ``cum_<name>`` (inclusive)."""
    keys = list(keys)
    agg = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    agg = value_range(agg, keys, value)
    return prefix_sum(agg, keys, "", {f"cum_{n}": n for n in counts}, bucket=F.col("_range"), order=[value]).drop("_range")


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Add the mid-rank of each row's value in its group (NULL values get NULL)."""
    keys = list(keys)
    t = tie_table(df.select(*keys, value), keys, value, {"_one": F.lit(1)})
    t = t.select(*keys, value, (F.col("cum__one") - F.col("_one") + (F.col("_one") + 1) / 2.0).alias(name))
    return df.join(t, [*keys, value], "left").select(*df.columns, name)
