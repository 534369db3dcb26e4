"""Visibility masks over (clip, frame, joint) cells: seeded and speed-based."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetable.functions.scalar import seeded_uniform
from kinetable.operators.frames import instantaneous_speed, mean_speed

CELL = ["video", "frame", "joint"]


def mask_none(cells: DataFrame) -> DataFrame:
    return cells.select(*CELL).withColumn("visible", F.lit(True))


def mask_uniform(cells: DataFrame, rho: float, seed: int = 0) -> DataFrame:
    """A cell is visible when its uniform exceeds rho."""
    return cells.select(*CELL).withColumn("visible", seeded_uniform(seed, *CELL) > rho)


def _hide_joints(cells: DataFrame, scored: DataFrame, score: str, k: int) -> DataFrame:
    # one row per joint of a clip
    order = F.row_number().over(W.partitionBy("video").orderBy(F.col(score).desc(), "joint"))
    hidden = scored.withColumn("visible", order > k).select("video", "joint", "visible")
    return cells.select(*CELL).join(hidden.hint("merge"), ["video", "joint"]).select(*CELL, "visible")


def mask_topk_speed(pose: DataFrame, n_joints: int, rho: float) -> DataFrame:
    """Hide the floor(rho J) joints with the highest mean speed of the clip."""
    return _hide_joints(pose, mean_speed(pose), "mean_speed", int(rho * n_joints))


def mask_softmax_speed(pose: DataFrame, n_joints: int, rho: float, tau: float = 1.0, seed: int = 0) -> DataFrame:
    """Hide floor(rho J) joints drawn without replacement with weights exp(speed / tau) (Gumbel top-k)."""
    u = F.greatest(seeded_uniform(seed, "video", "joint"), F.lit(1e-12))
    s = mean_speed(pose).withColumn("score", F.col("mean_speed") / F.lit(max(tau, 1e-6)) - F.ln(-F.ln(u)))
    return _hide_joints(pose, s, "score", int(rho * n_joints))


def mask_per_frame_speed(pose: DataFrame, n_joints: int, rho: float) -> DataFrame:
    """Hide the floor(rho J) fastest joints of each frame."""
    order = F.row_number().over(W.partitionBy("video", "frame").orderBy(F.col("speed").desc(), "joint"))
    return instantaneous_speed(pose).select(*CELL, (order > int(rho * n_joints)).alias("visible"))


def mask_limb(pose: DataFrame, limbs: Mapping[str, Sequence[int]], weighted: bool = False, seed: int = 0) -> DataFrame:
    """Hide one limb of the clip, picked uniformly or with weights by its mean speed."""
    if not limbs:
        raise ValueError("no limbs given")
    names = list(limbs)
    if weighted:
        s = mean_speed(pose).groupBy("video").agg(
            *[F.coalesce(F.avg(F.when(F.col("joint").isin(list(limbs[n])), F.col("mean_speed"))), F.lit(0.0)).alias(f"_w{i}") for i, n in enumerate(names)]
        )
    else:
        s = pose.select("video").distinct().withColumns({f"_w{i}": F.lit(1.0) for i in range(len(names))})
    total = sum((F.col(f"_w{i}") for i in range(len(names))), F.lit(0.0))
    w = [F.when(total > 0, F.col(f"_w{i}") / total).otherwise(1.0 / len(names)) for i in range(len(names))]
    u = seeded_uniform(seed, "video")
    pick, run = F.lit(names[-1]), F.lit(0.0)
    choice = None
    for n, x in zip(names[:-1], w[:-1]):
        run = run + x
        choice = F.when(u < run, F.lit(n)) if choice is None else choice.when(u < run, F.lit(n))
    s = s.select("video", (pick if choice is None else choice.otherwise(pick)).alias("limb"))
    hide = F.lit(False)
    for n in names:
        hide = hide | ((F.col("limb") == n) & F.col("joint").isin(list(limbs[n])))
    return pose.select(*CELL).join(s.hint("merge"), "video").select(*CELL, "limb", (~hide).alias("visible"))


def valid_recipe(recipe: int, policy: str) -> bool:
    """Recipes 2 and 3 need a mask that hides something."""
    return recipe == 1 or policy != "none"
