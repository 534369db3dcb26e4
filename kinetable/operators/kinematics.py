"""Speed-based measures per clip, state and body group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.operators.frames import dims_of, instantaneous_speed, norm
from kinetable.plans.quantiles import exact_quantiles
from kinetable.sources.skeletons import bones_dimension, groups_dimension


def kinematic_features(vel: DataFrame, limbs: Mapping[str, Sequence[int]], key: str = "clip_id") -> DataFrame:
    """One row per clip: mean speed, energy, speed per limb, laterality per limb stem, arms minus legs."""
    speed = {n: F.avg(F.when(F.col("joint").isin(list(js)), F.col("speed"))).alias(f"speed_{n}") for n, js in limbs.items()}
    base = vel.groupBy(key).agg(
        F.avg("speed").alias("mean_speed"), F.sum(F.col("speed") * F.col("speed")).alias("kinetic_energy"), *speed.values()
    )
    stems = [n[5:] for n in limbs if n.startswith("left_") and f"right_{n[5:]}" in limbs]
    extra = {f"laterality_{s}": F.col(f"speed_left_{s}") - F.col(f"speed_right_{s}") for s in stems}
    arms, legs = [n for n in limbs if "arm" in n], [n for n in limbs if "leg" in n]
    if arms and legs:
        total = lambda ns: sum((F.col(f"speed_{n}") for n in ns), F.lit(0.0))
        extra["upper_lower_balance"] = total(arms) - total(legs)
    return base.withColumns(extra) if extra else base


def state_joint_velocity(path: DataFrame, vel: DataFrame) -> DataFrame:
    """Mean speed per (state, joint); displacement row m goes with the state of window m."""
    j = vel.join(path.select("video", F.col("m").alias("frame"), "state").hint("merge"), ["video", "frame"])
    return j.groupBy("state", "joint").agg(F.avg("speed").alias("mean_speed"))


def state_region_breakdown(by_joint: DataFrame, regions: Mapping[str, Sequence[int]]) -> DataFrame:
    """Mean over the joints of each region."""
    dim = groups_dimension(by_joint.sparkSession, regions)
    return by_joint.join(F.broadcast(dim), "joint").groupBy("state", "body_group").agg(F.avg("mean_speed").alias("mean_speed"))


def high_velocity_profile(frames: DataFrame, pose: DataFrame, groups: Mapping[str, Sequence[int]], k: int, top_frac: float = 0.1) -> DataFrame:
    """Per recording, state and body group: share (%) of frame-joint cells at or above the joint's speed quantile.

    ``frames`` is video, state, frame.  States a recording does not visit are NULL.
    """
    speed = instantaneous_speed(pose)
    cut = exact_quantiles(speed, ["video", "joint"], "speed", {"cut": 1.0 - top_frac})
    dim = groups_dimension(pose.sparkSession, groups)
    high = speed.join(cut.hint("merge"), ["video", "joint"]).join(F.broadcast(dim), "joint")
    high = high.groupBy("video", "frame", "body_group").agg(
        F.count_if(F.col("speed") >= F.col("cut")).alias("n_high"), F.count("*").alias("n_cells")
    )
    got = frames.join(high.hint("merge"), ["video", "frame"]).groupBy("video", "state", "body_group").agg(
        (100.0 * F.sum("n_high") / F.sum("n_cells")).alias("pct")
    )
    names = F.array(*[F.lit(g) for g in groups])
    grid = frames.select("video").distinct().withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    grid = grid.withColumn("body_group", F.explode(names))
    return grid.join(got, ["video", "state", "body_group"], "left")


def state_velocity_cloud(frames: DataFrame, pose: DataFrame, vel: DataFrame) -> DataFrame:
    """Per state and joint: frame count, mean position and mean velocity over the labelled displacement rows."""
    pv = vel.join(pose.select("video", "frame", "joint", "x", "y").hint("merge"), ["video", "frame", "joint"])
    j = frames.join(pv.hint("merge"), ["video", "frame"])
    return j.groupBy("state", "joint").agg(
        F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("vx").alias("vx"), F.avg("vy").alias("vy")
    )


def speed_cap(frames: DataFrame, vel: DataFrame, pct: float = 99.0) -> DataFrame:
    """One row: percentile of all labelled speeds."""
    return exact_quantiles(frames.join(vel.hint("merge"), ["video", "frame"]), [], "speed", {"cap": pct / 100.0})


def bone_lengths(pose: DataFrame, bones: Sequence[tuple[int, int]], keys: Sequence[str]) -> DataFrame:
    """keys, bone, length: both ends of a bone meet by grouping, so no joint-to-joint join is needed."""
    dims = dims_of(pose)
    dim = bones_dimension(pose.sparkSession, bones)
    ends = dim.select("bone", F.explode(F.array(F.struct(F.col("a").alias("joint"), F.lit(1.0).alias("sign")), F.struct(F.col("b").alias("joint"), F.lit(-1.0).alias("sign")))).alias("e"))
    ends = ends.select("bone", F.col("e.joint").alias("joint"), F.col("e.sign").alias("sign"))
    j = pose.join(F.broadcast(ends), "joint")
    return j.groupBy(*keys, "bone").agg(norm([F.sum(F.col(v) * F.col("sign")) for v in dims]).alias("length"))


def bone_length_cv(pose: DataFrame, bones: Sequence[tuple[int, int]], clip: Sequence[str] = ("video",), frame: str = "frame") -> DataFrame:
    """Per clip and bone: population sd over mean of its length; a zero mean gives 0."""
    lens = bone_lengths(pose, bones, [*clip, frame])
    return lens.groupBy(*clip, "bone").agg(F.avg("length").alias("mean_length"), F.stddev_pop("length").alias("sd")).select(
        *clip, "bone", "mean_length", F.when(F.col("mean_length") > 0, F.col("sd") / F.col("mean_length")).otherwise(0.0).alias("cv")
    )


def bone_plausibility(generated: DataFrame, real: DataFrame, bones: Sequence[tuple[int, int]]) -> DataFrame:
    """One row: mean cv of two pose sets and their ratio."""
    def mean_cv(df, name):
        return bone_length_cv(df, bones).agg(F.avg("cv").alias(name))

    both = mean_cv(generated, "cv_generated").withColumn("_k", F.lit(1)).join(
        F.broadcast(mean_cv(real, "cv_real").withColumn("_k", F.lit(1))), "_k"
    )
    return both.drop("_k").withColumn("ratio", F.when(F.col("cv_real") > 0, F.col("cv_generated") / F.col("cv_real")))


def bone_length_drift(pose: DataFrame, bones: Sequence[tuple[int, int]], key: str = "video", step: str = "frame") -> DataFrame:
    """Per sequence: mean over bones of |length - endpoint mean| / endpoint mean at each step; largest value and its step."""
    lens = bone_lengths(pose, bones, [key, step])
    ends = lens.groupBy(key, "bone").agg(((F.min_by("length", step) + F.max_by("length", step)) / 2.0).alias("_ref"))
    d = lens.join(ends.hint("merge"), [key, "bone"]).withColumn("_d", F.abs(F.col("length") - F.col("_ref")) / F.greatest("_ref", F.lit(1e-12)))
    # the two end steps drift equally but for rounding, so bones are added in one order, the last first, whatever the partitioning
    shares = F.array_sort(F.collect_list(F.struct((-F.col("bone")).alias("o"), "_d")))
    steps = d.groupBy(key, step).agg((F.aggregate(shares, F.lit(0.0), lambda s, e: s + e["_d"]) / F.count("_d")).alias("drift"))
    return steps.groupBy(key).agg(
        F.avg("drift").alias("mean_drift"), F.max("drift").alias("max_drift"),
        (-F.max(F.struct("drift", (-F.col(step)).alias("s")))["s"]).alias("worst_step"),
    )
