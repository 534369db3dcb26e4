"""Chunked work must not depend on where the chunks are cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetable.operators import frames as FR
from kinetable.operators import states as S
from kinetable.operators import windows as WN
from kinetable.plans.chunks import ordered_index, prefix_sum, shift, spread_positions
from kinetable.plans.quantiles import exact_quantiles


def series(spark, n=50, videos=3):
    rng = np.random.default_rng(1)
    rows = [(v, m, int(rng.integers(0, 3))) for v in range(videos) for m in range(n + v)]
    return spark.createDataFrame(rows, "video long, m long, state int")


@pytest.mark.parametrize("size", [3, 7, 4096])
def test_shift_and_prefix(spark, size):
    p = series(spark)
    got = prefix_sum(shift(p, ["video"], "m", {"prev": ("state", -2), "nxt": ("state", 3)}, size), ["video"], "m", {"run": "state"}, size).toPandas()
    for _, g in got.sort_values("m").groupby("video"):
        s = g["state"].reset_index(drop=True)
        assert (g["run"].to_numpy() == s.cumsum().to_numpy()).all()
        assert s.shift(2).fillna(-1).tolist() == g["prev"].fillna(-1).tolist()
        assert s.shift(-3).fillna(-1).tolist() == g["nxt"].fillna(-1).tolist()


def test_visits_do_not_depend_on_chunk_size(spark):
    p = series(spark)
    a = S.visit_sequence(p, size=4).orderBy("video", "visit").collect()
    b = S.visit_sequence(p).orderBy("video", "visit").collect()
    assert a == b and sum(r["dwell"] for r in a) == p.count()


def test_ordered_index(spark):
    p = series(spark).withColumn("ts", F.col("m") * 10)
    got = ordered_index(p, ["video"], F.floor(F.col("ts") / 70), ["ts"], "i")
    assert got.where("i <> m").count() == 0


def test_spread_positions(spark):
    r = spark.createDataFrame([(1, 5, 23)], "video long, a long, b long")
    assert sorted(x["f"] for x in spread_positions(r, ["video"], "a", "b", "f", 4).collect()) == list(range(5, 24))


@pytest.mark.parametrize("size", [2, 5, 4096])
def test_interpolation(spark, size):
    rows = [(1, 0, 0, 0.0, None), (1, 4, 0, 4.0, None), (1, 0, 1, None, 2.0), (1, 2, 1, 5.0, None)]
    kp = spark.createDataFrame(rows, "video long, frame long, joint int, x double, y double")
    got = FR.interpolate_missing(FR.densify_frames(kp, 3, size), size).orderBy("joint", "frame").collect()
    xs = [[r["x"] for r in got if r["joint"] == j] for j in range(3)]
    assert xs == [[0.0, 1.0, 2.0, 3.0, 4.0], [5.0] * 5, [0.0] * 5]
    assert [r["y"] for r in got if r["joint"] == 1] == [2.0] * 5


@pytest.mark.parametrize("size", [5, 4096])
def test_resample_matches_interp(spark, size):
    f = 61
    kp = spark.createDataFrame([(1, i, 0, float(i * i), float(i)) for i in range(f)], "video long, frame long, joint int, x double, y double")
    ln = spark.createDataFrame([(1, f, 15.0)], "video long, n_frames long, fps double")
    got = FR.resample_fps(kp, ln, 30.0, size).orderBy("frame").toPandas()
    assert len(got) == 121
    want = np.interp(np.linspace(0, 1, 121), np.linspace(0, 1, f), np.arange(f) ** 2)
    assert np.allclose(got["x"], want)


def test_quantiles_are_exact_and_reject_nothing(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 5000), "v": np.round(rng.exponential(size=5000), 3)})
    pdf.loc[pdf.g == 0, "v"] = 1.5
    df = spark.createDataFrame(pdf)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = exact_quantiles(df, ["g"], "v", probs, accuracy=50).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g, list(probs)].to_numpy(float), np.quantile(part["v"], list(probs.values())))
    one = exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert one == pytest.approx(np.median(pdf["v"]))


def test_geometry_and_clips(spark):
    g = WN.Geometry(fps=25.0)
    assert (g.l, g.lo, g.f0, g.f_win) == (4, 4, 16, 6.25)
    path = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 1)], "video long, m long, state int")
    n = spark.createDataFrame([(1, 200)], "video long, n_frames long")
    spans = WN.delta_spans(path, n, g)
    assert S.label_frames_union(spans, F.col("lo"), F.col("hi")).where("state = 0").count() == 12
    ln = spark.createDataFrame([(1, 150), (2, 59)], "video long, n_frames long")
    assert [r["start_frame"] for r in WN.clip_table(ln, 60, 30).orderBy("start_frame").collect()] == [0, 30, 60, 90]


def test_smoothed_curve_with_flat_kernel(spark):
    p = series(spark, 40)
    k = [(i, j, 1.0 / (1 + abs(i - j))) for i in range(3) for j in range(3)]
    sim = spark.createDataFrame(k, "state int, next_state int, s double")
    v = S.visit_sequence(p).select("video", F.col("visit").alias("m"), "state")
    obs = S.transition_lookup(v, sim).groupBy("video").agg(F.avg("s").alias("o"))
    zero = p.select("video").distinct().withColumn("null_mean", F.lit(0.0))
    c = S.similarity_curve(p, sim, zero, 1e4, size=8).join(obs, "video")
    assert c.where(F.abs(F.col("curve") - F.col("o")) > 1e-5).count() == 0
