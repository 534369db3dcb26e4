"""Per-frame preprocessing of long keypoint tables.

A pose is ``video, frame, joint, x, y [, z]``.  ``DIMS`` name its coordinates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetable.functions.scalar import wrap_angle
from kinetable.plans.chunks import CHUNK, neighbours_known, prefix_sum, shift, spread_positions
from kinetable.plans.quantiles import exact_quantiles

XY = ("x", "y")
EPS = 1e-6


def dims_of(df: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in ("x", "y", "z") if c in df.columns)


def norm(cols: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for c in cols:
        total = total + c * c
    return F.sqrt(total)


def densify_frames(kp: DataFrame, n_joints: int, size: int = CHUNK) -> DataFrame:
    """Shift frames to start at 0 and give every (frame, joint) a row, missing coordinates NULL."""
    dims = dims_of(kp)
    spans = kp.groupBy("video").agg(F.min("frame").alias("_a"), F.max("frame").alias("_b"))
    grid = spread_positions(spans, ["video"], "_a", "_b", "frame", size)
    grid = grid.withColumn("joint", F.explode(F.sequence(F.lit(0), F.lit(n_joints - 1))))
    # sizes are guessed without the rows that explode adds, so a side must never be sent whole to every task
    full = grid.join(kp.select("video", "frame", "joint", *dims).hint("merge"), ["video", "frame", "joint"], "left")
    return full.select("video", (F.col("frame") - F.col("_a")).alias("frame"), "joint", *dims)


def interpolate_missing(pose: DataFrame, size: int = CHUNK) -> DataFrame:
    """Linear between known neighbours, flat beyond the ends, 0 for a joint never seen."""
    dims = dims_of(pose)
    near = neighbours_known(pose, ["video", "joint"], "frame", dims, size)

    def filled(v: str) -> Column:
        a, b = F.col(f"_prev_{v}"), F.col(f"_next_{v}")
        between = a["v"] + (b["v"] - a["v"]) * (F.col("frame") - a["p"]) / (b["p"] - a["p"])
        return F.coalesce(F.col(v), between, a["v"], b["v"], F.lit(0.0))

    return near.select("video", "frame", "joint", *[filled(v).alias(v) for v in dims])


def root_center(pose: DataFrame, root: int, keys: Sequence[str] = ("video", "frame")) -> DataFrame:
    """Subtract the root joint in each frame; a negative root means the mean of the known joints."""
    w = W.partitionBy(*keys)

    def origin(v):
        return F.avg(v).over(w) if root < 0 else F.max(F.when(F.col("joint") == root, F.col(v))).over(w)

    return pose.withColumns({v: F.col(v) - origin(v) for v in dims_of(pose)})


def torso_scale(pose: DataFrame, top: int, bottom: int, n_joints: int, eps: float = EPS) -> DataFrame:
    """video, scale: median distance of two joints, or of all joints from the frame centroid if either is invalid."""
    dims = dims_of(pose)
    w = ("video", "frame")
    if 0 <= top < n_joints and 0 <= bottom < n_joints:
        def at(j, v):
            return F.max(F.when(F.col("joint") == j, F.col(v)))

        d = pose.where(F.col("joint").isin(top, bottom)).groupBy(*w).agg(
            norm([at(top, v) - at(bottom, v) for v in dims]).alias("d")
        )
    else:
        centred = root_center(pose, -1)
        d = centred.select("video", norm([F.col(v) for v in dims]).alias("d"))
    med = exact_quantiles(d, ["video"], "d", {"scale": 0.5})
    ok = F.col("scale").isNotNull() & ~F.isnan("scale") & (F.col("scale") > 0) & (F.col("scale") < float("inf"))
    return med.select("video", F.when(ok, F.greatest("scale", F.lit(eps))).otherwise(F.lit(eps)).alias("scale"))


def normalize_pose(pose: DataFrame, mode: str, root: int, top: int, bottom: int, n_joints: int) -> DataFrame:
    """none, center or center_scale; the scale is measured after centring."""
    if mode not in ("none", "center", "center_scale"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "none":
        return pose
    c = root_center(pose, root)
    if mode == "center":
        return c
    s = torso_scale(c, top, bottom, n_joints)
    return c.join(s.hint("merge"), "video").withColumns({v: F.col(v) / F.col("scale") for v in dims_of(pose)}).drop("scale")


def align_direction(pose: DataFrame, axes: Sequence[str], root: int, eps: float = EPS) -> DataFrame:
    """Turn each recording so that the root's net displacement points along the first ground axis."""
    a, b = axes
    r = pose.where(F.col("joint") == root).groupBy("video").agg(
        F.max_by(F.struct(a, b), "frame").alias("e"), F.min_by(F.struct(a, b), "frame").alias("s")
    )
    r = r.select("video", (F.col(f"e.{a}") - F.col(f"s.{a}")).alias("_da"), (F.col(f"e.{b}") - F.col(f"s.{b}")).alias("_db"))
    j = pose.join(r.hint("merge"), "video")
    moved = F.hypot("_da", "_db") >= eps
    phi = F.atan2("_db", "_da")
    ra = F.when(moved, F.cos(phi) * F.col(a) + F.sin(phi) * F.col(b)).otherwise(F.col(a))
    rb = F.when(moved, F.cos(phi) * F.col(b) - F.sin(phi) * F.col(a)).otherwise(F.col(b))
    return j.withColumns({a: ra, b: rb}).drop("_da", "_db")


def resampled_length(n: Column, src: Column, dst: Column) -> Column:
    return F.greatest(F.bround((n - 1) / src * dst).cast("long") + 1, F.lit(2))


def resample_fps(pose: DataFrame, lengths: DataFrame, dst_fps: float, size: int = CHUNK) -> DataFrame:
    """Linear resampling on normalised time; ``lengths`` is video, n_frames, fps.

    Each source frame emits the target frames that fall in [frame, frame + 1), so
    there is no position join; recordings under 2 frames or already at the rate pass.
    """
    dims = dims_of(pose)
    keep = (F.col("n_frames") < 2) | (F.abs(F.col("fps") - dst_fps) < 1e-9)
    n2 = F.when(keep, F.col("n_frames")).otherwise(resampled_length(F.col("n_frames"), F.col("fps"), F.lit(float(dst_fps))))
    ln = lengths.select("video", (F.col("n_frames") - 1).alias("_s"), (n2 - 1).alias("_t"))
    nxt = shift(pose, ["video", "joint"], "frame", {f"_n_{v}": (v, 1) for v in dims}, size).join(ln.hint("merge"), "video")

    def first_target(f: Column) -> Column:  # smallest i with i * s >= f * t, in whole numbers
        return F.floor((f * F.col("_t") + F.col("_s") - 1) / F.col("_s"))

    lo = first_target(F.col("frame"))
    hi = F.when(F.col("frame") == F.col("_s"), F.col("_t")).otherwise(first_target(F.col("frame") + 1) - 1)
    ids = F.when(F.col("_s") < 1, F.array(F.col("frame"))).otherwise(F.sequence(lo.cast("long"), hi.cast("long")))
    usable = (F.col("_s") < 1) | (lo <= hi)
    out = nxt.where(usable).withColumn("_i", F.explode(ids))
    frac = F.when(F.col("_s") < 1, 0.0).otherwise(F.col("_i") * F.col("_s") / F.col("_t") - F.col("frame"))

    def value(v):
        return F.when(F.col(f"_n_{v}").isNull(), F.col(v)).otherwise(F.col(v) + (F.col(f"_n_{v}") - F.col(v)) * frac)

    return out.select("video", F.col("_i").alias("frame"), "joint", *[value(v).alias(v) for v in dims])


def preprocess_walk(pose: DataFrame, lengths: DataFrame, dst_fps: float, axes: Sequence[str], root: int,
                    align_before_center: bool = False) -> DataFrame:
    """Resample, centre, align.

    Centring first makes the root's path zero, so the default alignment leaves
    every walk as it is; ``align_before_center`` turns the walks for real.
    """
    p = resample_fps(pose, lengths, dst_fps)
    if align_before_center:
        return root_center(align_direction(p, axes, root), root)
    return align_direction(root_center(p, root), axes, root)


def headings(pose: DataFrame, axes: Sequence[str], left: int, right: int) -> DataFrame:
    """video, frame, heading: the hip vector (right - left) turned by 90 degrees in the ground plane."""
    a, b = axes

    def at(j, v):
        return F.max(F.when(F.col("joint") == j, F.col(v)))

    return pose.where(F.col("joint").isin(left, right)).groupBy("video", "frame").agg(
        F.atan2(at(right, a) - at(left, a), -(at(right, b) - at(left, b))).alias("heading")
    )


def egocentric(pose: DataFrame, axes: Sequence[str], root: int, left: int, right: int) -> DataFrame:
    """Root-centred pose turned by minus the heading of its frame; keeps ``heading``."""
    a, b = axes
    c = root_center(pose, root)
    j = c.join(headings(pose, axes, left, right).hint("merge"), ["video", "frame"])
    h = -F.col("heading")
    return j.withColumns({
        a: F.cos(h) * F.col(a) - F.sin(h) * F.col(b), b: F.sin(h) * F.col(a) + F.cos(h) * F.col(b)
    })


def root_channels(pose: DataFrame, axes: Sequence[str], up: str, root: int, left: int, right: int, fps: float,
                  size: int = CHUNK) -> DataFrame:
    """video, frame, v_forward, v_side, omega, height.

    Planar velocity in the heading frame and angular velocity; the heading
    differences are unwrapped as a series of their own.  The first frame is 0.
    """
    a, b = axes
    r = pose.where(F.col("joint") == root).select("video", "frame", a, b, F.col(up).alias("height"))
    r = r.join(headings(pose, axes, left, right).hint("merge"), ["video", "frame"])
    r = shift(r, ["video"], "frame", {"_pa": (a, -1), "_pb": (b, -1), "_ph": ("heading", -1)}, size)
    r = r.withColumn("_d", F.col("heading") - F.col("_ph"))
    r = shift(r, ["video"], "frame", {"_pd": ("_d", -1)}, size)
    step = F.col("_d") - F.col("_pd")
    # a jump of exactly +pi keeps its sign, as series unwrapping does
    back = wrap_angle(step)
    back = F.when((back == -F.pi()) & (step > 0), F.pi()).otherwise(back)
    corr = F.when(F.abs(step) < F.pi(), 0.0).otherwise(back - step)
    r = prefix_sum(r, ["video"], "frame", {"_fix": F.coalesce(corr, F.lit(0.0))}, size)
    h = -F.col("heading")
    da, db = F.coalesce(F.col(a) - F.col("_pa"), F.lit(0.0)), F.coalesce(F.col(b) - F.col("_pb"), F.lit(0.0))
    return r.select(
        "video", "frame",
        ((F.cos(h) * da - F.sin(h) * db) * fps).alias("v_forward"),
        ((F.sin(h) * da + F.cos(h) * db) * fps).alias("v_side"),
        (F.coalesce(F.col("_d") + F.col("_fix"), F.lit(0.0)) * fps).alias("omega"),
        "height",
    )


def walk_features(pose: DataFrame, axes: Sequence[str], up: str, root: int, left: int, right: int, fps: float,
                  feature_set: str = "B") -> DataFrame:
    """video, frame, features: egocentric coordinates in joint order, plus the root channels in set B."""
    ego = egocentric(pose, axes, root, left, right)
    packed = F.array_sort(F.collect_list(F.struct("joint", F.array(*dims_of(pose)).alias("c"))))
    frame = ego.groupBy("video", "frame").agg(packed.alias("p"))
    feats = frame.select("video", "frame", F.flatten(F.transform("p", lambda e: e["c"])).alias("features"))
    if feature_set.upper() == "A":
        return feats
    rc = root_channels(pose, axes, up, root, left, right, fps)
    return feats.join(rc.hint("merge"), ["video", "frame"]).select(
        "video", "frame", F.concat("features", F.array("v_forward", "v_side", "omega", "height")).alias("features")
    )


def build_walk_table(features: DataFrame, walks: DataFrame, min_frames: int = 4) -> DataFrame:
    """Attach composite ids; walks with fewer than ``min_frames`` frames are dropped."""
    n = features.groupBy("video").agg(F.count("*").alias("n_frames")).where(F.col("n_frames") >= min_frames)
    ids = walks.join(n, "video").select(
        "video", "n_frames", F.concat_ws(":", "cohort", "subject", "walk_id").alias("walk_key"),
        F.concat_ws(":", "cohort", "subject").alias("subject_key"),
    )
    return features.join(ids.hint("merge"), "video")


def cohort_vocabulary(df: DataFrame, cohorts: Sequence[str], column: str = "cohort") -> DataFrame:
    """Keep the listed cohorts and number them in the given order."""
    names = F.array(*[F.lit(c) for c in cohorts])
    pos = F.array_position(names, F.col(column).cast("string"))
    return df.where(pos > 0).withColumn("cohort_id", (pos - 1).cast("int"))


def mirror_pose(pose: DataFrame, pairs: Sequence[tuple[int, int]], axis: str | None = "x") -> DataFrame:
    """Swap left and right joints and negate the lateral axis (``axis=None`` for masks)."""
    j = F.col("joint")
    swapped = j
    for a, b in pairs:
        swapped = F.when(j == a, F.lit(b)).when(j == b, F.lit(a)).otherwise(swapped)
    out = pose.withColumn("joint", swapped.cast("int"))
    return out if axis is None else out.withColumn(axis, -F.col(axis))


def velocity(pose: DataFrame, fps: float, size: int = CHUNK) -> DataFrame:
    """Displacement rows frame -> frame + 1 times fps: vx, vy [, vz], speed; F - 1 rows a joint."""
    dims = dims_of(pose)
    n = shift(pose, ["video", "joint"], "frame", {f"_n_{v}": (v, 1) for v in dims}, size)
    n = n.where(F.col(f"_n_{dims[0]}").isNotNull())
    vs = [((F.col(f"_n_{v}") - F.col(v)) * F.lit(float(fps))) for v in dims]
    return n.select("video", "frame", "joint", *[c.alias(f"v{v}") for c, v in zip(vs, dims)], norm(vs).alias("speed"))


def instantaneous_speed(pose: DataFrame, size: int = CHUNK) -> DataFrame:
    """Step length per frame and joint; the last frame repeats the one before."""
    dims = dims_of(pose)
    offs = {f"_n_{v}": (v, 1) for v in dims} | {f"_p_{v}": (v, -1) for v in dims}
    n = shift(pose, ["video", "joint"], "frame", offs, size)
    ahead = norm([F.col(f"_n_{v}") - F.col(v) for v in dims])
    back = norm([F.col(v) - F.col(f"_p_{v}") for v in dims])
    return n.select("video", "frame", "joint", F.coalesce(ahead, back).alias("speed"))


def mean_speed(pose: DataFrame) -> DataFrame:
    return velocity(pose, 1.0).groupBy("video", "joint").agg(F.avg("speed").alias("mean_speed"))


def limb_velocity(vel: DataFrame, limbs: Mapping[str, Sequence[int]], mirror: Sequence[str] = ()) -> DataFrame:
    """Mean signed displacement over each limb's joints; x is negated for the limbs in ``mirror``."""
    tags = F.filter(
        F.array(*[F.when(F.col("joint").isin(list(js)), F.lit(name)) for name, js in limbs.items()]), lambda e: e.isNotNull()
    )
    t = vel.withColumn("limb", F.explode(tags))
    sign = F.when(F.col("limb").isin(list(mirror)), -1.0).otherwise(1.0)
    return t.groupBy("video", "frame", "limb").agg(F.avg(F.col("vx") * sign).alias("vx"), F.avg("vy").alias("vy"))


def flatten_clip(clips: DataFrame, keys: Sequence[str] = ("clip_id", "t")) -> DataFrame:
    """(joint, x, y) rows of a frame to one vector of 2J numbers in joint order."""
    packed = F.array_sort(F.collect_list(F.struct("joint", F.array(*dims_of(clips)).alias("c"))))
    return clips.groupBy(*keys).agg(F.flatten(F.transform(packed, lambda e: e["c"])).alias("vector"))
