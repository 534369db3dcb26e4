"""Rows made by an explode look few to the planner; no such side may be sent whole through the driver."""

import random
from functools import reduce

from pyspark.sql import functions as F

from kinetable.operators import frames as FR
from kinetable.operators import kinematics as KN
from kinetable.operators import limbs as LB
from kinetable.operators import masks as MK
from kinetable.operators import quality as QL
from kinetable.operators import windows as WN


def _joins(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "BroadcastHashJoin" in plan, "SortMergeJoin" in plan


def test_poses_are_never_broadcast(spark):
    kp = spark.range(60).select((F.col("id") % 3).alias("video"), (F.col("id") % 20).alias("frame"), (F.col("id") % 2).cast("int").alias("joint"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    p = FR.interpolate_missing(FR.densify_frames(kp, 2))
    n = WN.recording_lengths(p)
    mask = p.select("video", "frame", "joint", (F.col("frame") % 3 != 0).alias("visible"))
    for df in (
        WN.clip_table(n, 4, 2), WN.clip_windows(p, n, 4, 2), WN.epochs(p, n, 10.0, 0.5), MK.mask_limb(p, {"a": [0], "b": [1]}), MK.mask_topk_speed(p, 2, 0.5),
        QL.mpjpe_by(QL.joint_errors(p, p, mask), ["joint"]), FR.preprocess_walk(p, n.withColumn("fps", F.lit(10.0)), 25.0, ("x", "y"), 0, align_before_center=True),
    ):
        assert _joins(df) == (False, True)


def test_drift_adds_bones_in_one_order(spark):
    # both end steps drift equally but for rounding: the sum's order decides which is larger
    rng = random.Random(1)
    lens = {v: {0: [rng.random() + 1 for _ in range(4)], 2: [rng.random() + 1 for _ in range(4)]} for v in range(300)}
    want = {}
    for v, ends in lens.items():
        ref = [(a + b) / 2.0 for a, b in zip(ends[0], ends[2])]
        drift = {f: reduce(float.__add__, (abs(x - r) / r for x, r in zip(ls[::-1], ref[::-1]))) / 4 for f, ls in ends.items()}
        want[v] = max(drift, key=lambda f: (drift[f], -f))
        ends[1] = ref
    rows = [(v, f, j, 0.0 if j == 0 else ls[j - 1], 0.0) for v, e in lens.items() for f, ls in e.items() for j in range(5)]
    df = spark.createDataFrame(rows, "video int, frame int, joint int, x double, y double").repartition(7)
    got = KN.bone_length_drift(df, [(0, 1), (0, 2), (0, 3), (0, 4)])
    assert {r.video: r.worst_step for r in got.collect()} == want


def test_gains_are_computed_once(spark):
    def gains(batches):
        for pdf in batches:
            yield pdf.assign(peak=pdf["row"] % 7 / 7.0, lag=(pdf["row"] // 5).astype("int32"))

    rows = spark.range(400).select((F.col("id") % 2).alias("video"), F.floor(F.col("id") / 2).alias("row"))
    got = LB.peak_pick(rows.mapInPandas(gains, "video long, row long, peak double, lag int"), ["video"], 0.25, 1, 2)
    found = {r["video"]: (r["n_rows"], r["n_runs"]) for r in got.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("MapInPandas") == 1
    assert found == {0: (200, 29), 1: (200, 29)}


def test_medians_are_not_joined_by_broadcast(spark):
    co = spark.range(300).select((F.col("id") % 30).alias("video"), F.lit("a").alias("pair"), (F.col("id") / 7).alias("cosine"))
    assert _joins(LB.comovement_medians(co)) == (False, True)
