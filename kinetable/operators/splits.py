"""Seeded splits, folds, subsets and pair picks over whole groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from kinetable.functions.scalar import seeded_uniform, squared_distance
from kinetable.plans.chunks import ordered_index
from kinetable.plans.draws import pick_smallest, seeded_order
from kinetable.plans.ranks import value_range


def subject_holdout(df: DataFrame, group: str, frac: float, seed: int = 0, order: str | None = None) -> DataFrame:
    """Add ``role`` (train / val): whole groups go to validation, round(n frac) of them, at least 1 and at most n - 1.

    With one group its last share by ``order`` is held out.
    """
    groups = df.select(group).distinct()
    n = groups.count()
    if n == 1:
        if order is None:
            raise ValueError("one group needs an order column")
        total = df.count()
        keep = total - max(1, min(round(total * frac), total - 1))
        d = ordered_index(df.withColumn("_g", F.lit(0)), ["_g"], F.floor(F.col(order) / 4096).cast("long"), [order], "_i")
        return d.withColumn("role", F.when(F.col("_i") >= keep, "val").otherwise("train")).drop("_g", "_i")
    k = max(1, min(round(n * frac), n - 1))
    g = groups.withColumns({"_g": F.lit(0), "_k": F.lit(k), "_u": seeded_uniform(seed, group)})
    g = pick_smallest(g, ["_g"], "_u", "_k", [group], "_val").select(group, "_val")
    return df.join(g, group).withColumn("role", F.when(F.col("_val") == 1, "val").otherwise("train")).drop("_val")


def leave_one_group_out(df: DataFrame, group: str, within: str | None = None) -> DataFrame:
    """Add ``fold``: rows of fold f are the test set of fold f and training rows of every other fold.

    One column stands for all folds, so rows are not copied per fold.
    """
    keys = [within] if within else []
    g = df.select(*keys, group).distinct().withColumn("_g", F.lit(0))
    part = keys or ["_g"]
    # order ranges that grow with the group: sketch ranges for numbers, the first character for text
    if isinstance(g.schema[group].dataType, T.NumericType):
        g = ordered_index(value_range(g, part, group), part, F.col("_range"), [group], "fold").drop("_g", "_range")
    else:
        g = ordered_index(g, part, F.ascii(F.col(group)).cast("long"), [group], "fold").drop("_g")
    return df.join(g, [*keys, group])


def kfold_groups(df: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """Add ``fold``: groups in seeded order cut into near-equal runs, larger ones first; sizes differ by at most 1."""
    groups = df.select(group).distinct()
    n = groups.count()
    if not 2 <= folds <= n:
        raise ValueError(f"folds must lie in [2, {n}]")
    g = seeded_order(groups.withColumn("_g", F.lit(0)), ["_g"], [group], seed, "_i").drop("_g")
    size, extra = divmod(n, folds)
    edge = extra * (size + 1)
    fold = F.when(F.col("_i") < edge, F.floor(F.col("_i") / (size + 1))).otherwise(extra + F.floor((F.col("_i") - edge) / size))
    return df.join(g.select(group, fold.cast("int").alias("fold")), group)


def balanced_subset(walks: DataFrame, subject: str, cohort: str, walk: str, seed: int = 0) -> DataFrame:
    """One seeded walk per subject, then every cohort cut to the smallest cohort's count."""
    one = walks.withColumn("_u", seeded_uniform(seed, walk)).groupBy(cohort, subject).agg(F.min(F.struct("_u", F.col(walk).alias("w"))).alias("_m"))
    one = one.select(cohort, subject, F.col("_m.w").alias(walk), F.col("_m._u").alias("_u"))
    sizes = one.groupBy(cohort).agg(F.count("*").alias("_n"))
    k = sizes.agg(F.min("_n")).first()[0]
    picked = pick_smallest(one.withColumn("_k", F.lit(k)), [cohort], "_u", "_k", [walk], "_p").where("_p = 1")
    return picked.select(cohort, subject, walk)


def pick_pairs(lat: DataFrame, n_candidates: int, seed: int = 0) -> DataFrame:
    """Seeded candidate pairs from different videos: clip_a, clip_b, distance; unordered, each once.

    Candidates are drawn by row position, so work grows with their number.
    """
    n = lat.count()
    pos = seeded_order(lat.withColumn("_g", F.lit(0)), ["_g"], ["clip_id"], seed, "_i").select("_i", "clip_id", "video", "mu")
    c = lat.sparkSession.range(n_candidates)
    draw = lambda s: F.floor(seeded_uniform(s, "id") * n).cast("long")
    c = c.select("id", draw(seed + 1).alias("ia"), draw(seed + 2).alias("ib"))
    a = pos.select(F.col("_i").alias("ia"), F.col("clip_id").alias("a"), F.col("video").alias("va"), F.col("mu").alias("ma"))
    b = pos.select(F.col("_i").alias("ib"), F.col("clip_id").alias("b"), F.col("video").alias("vb"), F.col("mu").alias("mb"))
    p = c.join(a, "ia").join(b, "ib").where("va <> vb")
    return p.select(
        F.least("a", "b").alias("clip_a"), F.greatest("a", "b").alias("clip_b"), F.sqrt(squared_distance(F.col("ma"), F.col("mb"))).alias("distance")
    ).distinct()


def spread_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """n of the candidate pairs, evenly spread over their distance order, ends included.

    The candidate count is a parameter, so the order is taken over a bounded table.
    """
    w = W.partitionBy(F.lit(0)).orderBy("distance", "clip_a", "clip_b")
    total = F.count("*").over(W.partitionBy(F.lit(0)))
    p = pairs.withColumns({"_i": F.row_number().over(w) - 1, "_n": total})
    want = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(max(n - 1, 1))).cast("long"))
    return p.where(F.array_contains(want, F.col("_i").cast("long"))).drop("_i", "_n")


def extreme_pair(pairs: DataFrame, how: str) -> DataFrame:
    """The farthest or the median-distance candidate pair."""
    if how == "farthest":
        return pairs.orderBy(F.col("distance").desc(), "clip_a", "clip_b").limit(1)
    if how != "median":
        raise ValueError(f"unknown choice {how!r}")
    w = W.partitionBy(F.lit(0)).orderBy("distance", "clip_a", "clip_b")
    p = pairs.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(W.partitionBy(F.lit(0)))})
    return p.where(F.col("_i") == F.floor(F.col("_n") / 2)).drop("_i", "_n")


def union_cohorts(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def random_row_split(df: DataFrame, ids: Sequence[str], frac: float, seed: int = 0) -> DataFrame:
    """Add ``role``: round(n frac) seeded rows are validation rows."""
    n = df.count()
    d = df.withColumns({"_g": F.lit(0), "_k": F.lit(max(1, round(n * frac))), "_u": seeded_uniform(seed, *ids)})
    p = pick_smallest(d, ["_g"], "_u", "_k", list(ids), "_val")
    return p.withColumn("role", F.when(F.col("_val") == 1, "val").otherwise("train")).drop("_g", "_k", "_u", "_val")
