"""Clusterings by level equal separate ones; the number of jobs does not grow with the levels."""

import math

import numpy as np
import pytest

from kinetable.operators import keyed as K


def cloud(levels, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for v in range(levels):
        k = 1 + v % 3
        for j in range(k):
            rows += [(len(rows) + i, v, (rng.normal(size=2) * 0.3 + [6.0 * j, 3.0 * (j % 2)]).tolist(), "x") for i in range(60)]
    rows += [(len(rows) + i, 90, [0.0, float(i)], "x") for i in range(39)] + [(len(rows) + 100, None, [0.0, 1.0], "x")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "clip_id long, grade long, mu array<double>, level string").drop("level").repartition(4)


def jobs(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), f"count-{np.random.default_rng().integers(1 << 60)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
        return out, len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_levels_equal_separate_fits(spark):
    rows = cloud(3)
    both, labels = K.within_group_repeat(frame(spark, rows), "grade", runs=4, block=50)
    got = {r["level"]: tuple(r)[1:] for r in both.collect()}
    assert got[90] == (39, True, None, None, None, None) and len(got) == 4
    assert [got[v][2] for v in range(3)] == [1, 2, 3] and got[1][4] == pytest.approx(1.0) and [got[v][5] for v in range(3)] == [1, 2, got[2][5]]
    marked = {r["clip_id"]: (r["cluster"], round(r["c0"], 9)) for r in labels.collect()}
    assert len(marked) == 60 * 6
    alone, own = K.within_group_repeat(frame(spark, [r for r in rows if r[1] == 2]), "grade", runs=4)
    assert tuple(alone.first())[:5] == (2, *got[2][:4]) and alone.first()["ari_kmeans"] == pytest.approx(got[2][4])
    assert all(marked[r["clip_id"]] == (r["cluster"], round(r["c0"], 9)) for r in own.collect())


def test_mixture_equals_a_dense_em(spark):
    rows = [r for r in cloud(3) if r[1] == 1]
    levels = K.Levels(frame(spark, rows), "grade", "clip_id", "mu", 40, 30)
    (centres, cost), = K.keyed_kmeans(levels, [(1, 2, 0)]).values()
    x = np.array([r[2] for r in rows])
    near = ((x[:, None] - centres) ** 2).sum(-1)
    assert cost == pytest.approx(near.min(1).sum()) and np.allclose(centres, [x[near.argmin(1) == j].mean(0) for j in range(2)])
    ((w, mean, cov), ll), = K.keyed_mixtures(levels, {(1, 2, 0): centres}).values()
    g, last = np.eye(2)[near.argmin(1)], -math.inf
    while True:
        n = g.sum(0)
        m = g.T @ x / n[:, None]
        c = [((x - m[j]) * g[:, j : j + 1]).T @ (x - m[j]) / n[j] + 1e-5 * np.eye(2) for j in range(2)]
        dens = np.stack([np.log(n[j] / len(x)) - 0.5 * np.einsum("ni,ij,nj->n", x - m[j], np.linalg.inv(c[j]), x - m[j]) - 0.5 * np.linalg.slogdet(2 * np.pi * c[j])[1] for j in range(2)], 1)
        whole = np.logaddexp.reduce(dens, axis=1)
        if whole.sum() - last < 1e-3 * len(x):
            break
        g, last = np.exp(dens - whole[:, None]), whole.sum()
    assert ll == pytest.approx(whole.sum()) and np.allclose(mean, m) and np.allclose(cov, c) and np.allclose(w, n / len(x))


def test_jobs_do_not_grow_with_levels(spark):
    run = lambda rows: jobs(spark, lambda: K.keyed_kmeans(K.Levels(frame(spark, rows), "grade", "clip_id", "mu", 40, 500), [(v, 1, 0) for v in sorted({r[1] for r in rows if r[1] is not None and r[1] < 90})]))[1]
    assert run(cloud(6)) <= run(cloud(1)) + 2


def test_rand_index():
    assert K.rand_index(np.diag([5, 5])) == 1.0 and K.rand_index(np.array([[5, 5]])) == 0.0
    assert K.rand_index(np.array([[3, 1], [1, 3]])) == pytest.approx((6 - 12 * 12 / 28) / (12 - 12 * 12 / 28))


def test_squares_build_no_array_of_rows_by_centres_by_coordinates():
    import tracemalloc

    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(20000, 16)), rng.normal(size=(8, 16))
    x[:4] = c[[1, 1, 7, 0]] = c[3]
    tracemalloc.start()
    got = K._squares(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * got.nbytes
    assert np.allclose(got, ((x[:, None] - c[None]) ** 2).sum(-1)) and np.array_equal(got.argmin(1), K._nearest(x, c)[0]) and got[0].argmin() == 0
