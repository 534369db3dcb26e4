"""Farthest-first starts, permutation thresholds, leave-one-out p values and the interval hook against direct computation."""

import itertools
import math

import numpy as np
import pytest

from kinetable.operators import cluster as CL
from kinetable.operators import inference as I
from kinetable.operators import linear as LN
from kinetable.operators.kernels import shuffled
from kinetable.sources.keypoint_tables import hooked_intervals


def test_farthest_first_with_ties(spark):
    x = np.vstack([np.random.default_rng(1).normal(size=(60, 3)), [[9.0, 0, 0], [9.0, 0, 0]]])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "clip_id long, mu array<double>, step int").repartition(3)
    got = CL.farthest_start(df, 5).orderBy("step").collect()
    chosen = [got[0]["clip_id"]]
    for r in got[1:]:
        d = np.sqrt(((x[:, None] - x[chosen]) ** 2).sum(-1)).min(1)
        assert r["clip_id"] == int(d.argmax()) and r["distance"] == pytest.approx(d.max())
        chosen.append(r["clip_id"])
    start = CL.mixture_start(CL.farthest_start(df, 5)).collect()
    assert [r["weight"] for r in start] == [0.2] * 5 and all(set(r["var"]) == {1.0} for r in start)


def test_em_leaves_an_empty_component_where_it_is(spark):
    lat = spark.createDataFrame([(i, [float(i % 5), 1.0], [-1.0, -2.0]) for i in range(40)], "clip_id long, mu array<double>, logvar array<double>")
    init = spark.createDataFrame([(0, 0.5, [2.0, 1.0], [1.0, 1.0]), (1, 0.5, [900.0, 900.0], [1.0, 1.0])], "component int, weight double, mean array<double>, var array<double>")
    one, far = CL.diag_gmm_em(lat, init, 3).orderBy("component").collect()
    assert far["mean"] == [900.0, 900.0] and far["weight"] == 0.0
    assert one["mean"] == pytest.approx([2.0, 1.0]) and one["var"] == pytest.approx([2.0 + math.exp(-1), math.exp(-2)])


def test_permutation_threshold_counts_planted_components(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)) + 2.0 * rng.normal(size=(400, 1)) * [1, 1, 1, 0, 0, 0] + 1.5 * rng.normal(size=(400, 1)) * [0, 0, 0, 1, -1, 1]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "mu array<double>").repartition(3)
    got = LN.svd_basis(df, significance="perm", draws=30)
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    s = (x - q[1]) / (q[2] - q[0])
    top = [np.linalg.svd(np.stack([rng.permutation(s[:, c]) for c in range(6)], 1), compute_uv=False)[0] for _ in range(200)]
    assert got["n_significant"] == 2 == (np.linalg.svd(s, compute_uv=False) > max(top)).sum()
    assert np.mean(top) - 4 * np.std(top) < got["threshold"] < max(top) * 1.03
    # each draw is the spectrum of columns permuted by the place function, whatever the block size
    one = spark.createDataFrame([(v.tolist(),) for v in s[:50]], "v array<double>").coalesce(1)
    y = np.empty((50, 6))
    for c in range(6):
        y[shuffled(np.arange(50), 50, c, 3), c] = s[:50, c]
    for block in (7, 4096):
        assert LN.permuted_top_values(one, "v", 1, 3, block)[0] == pytest.approx(np.linalg.svd(y, compute_uv=False)[0])
    with pytest.raises(ValueError):
        LN.svd_basis(df, significance="none")


def u_of(pos, neg):
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)


def exact_p(u, i, j):
    """By enumeration of the ranks."""
    sums = np.array([sum(c) for c in itertools.combinations(range(1, i + j + 1), i)]) - i * (i + 1) / 2
    return min(1.0, 2 * (sums >= max(u, i * j - u) - 1e-9).mean())


def normal_p(pos, neg):
    v, c = np.unique(np.concatenate([pos, neg]), return_counts=True)
    i, j = len(pos), len(neg)
    n, u = i + j, u_of(pos, neg)
    var = i * j / 12 * (n + 1 - (c**3 - c).sum() / (n * (n - 1)))
    return 1.0 if var <= 0 else min(1.0, math.erfc(max((max(u, i * j - u) - i * j / 2 - 0.5) / math.sqrt(var), 0) / math.sqrt(2)))


def left_out(pos, neg, p):
    out = [p([x for k, x in enumerate(pos) if k != d], neg) for d in range(len(pos)) if len(pos) > 1]
    return out + [p(pos, [x for k, x in enumerate(neg) if k != d]) for d in range(len(neg)) if len(neg) > 1]


def test_leave_one_out_p_equals_recomputation(spark):
    rng = np.random.default_rng(11)
    groups = {"a": (rng.normal(size=6) + 0.8, rng.normal(size=32)), "b": (np.round(rng.normal(size=6) * 2), np.round(rng.normal(size=15) * 2)), "c": (np.array([1.0]), np.array([2.0, 3.0])), "d": (np.ones(3), np.ones(4))}
    rows = [(g, float(v), label) for g, (pos, neg) in groups.items() for label, side in ((1, pos), (0, neg)) for v in side] + [("a", None, 1), ("e", 1.0, 1)]
    df = spark.createDataFrame(rows, "metric string, value double, label int")
    normal = {r["metric"]: r for r in I.leave_one_out_p(df, ["metric"], "asymptotic").collect()}
    assert set(normal) == set("abcd")
    for g, (pos, neg) in groups.items():
        want = left_out(list(pos), list(neg), normal_p)
        assert normal[g]["n_left_out"] == len(want)
        assert (normal[g]["loo_p_min"], normal[g]["loo_p_max"]) == pytest.approx((min(want), max(want)), abs=1e-12)
    exact = {r["metric"]: r for r in I.leave_one_out_p(df, ["metric"], "exact").collect()}
    pos, neg = groups["a"]
    us = [u_of(np.delete(pos, d), neg) for d in range(6)], [u_of(pos, np.delete(neg, d)) for d in range(32)]
    ends = [exact_p(f(u, key=lambda x, m=i * j / 2: abs(x - m)), i, j) for u, i, j in ((us[0], 5, 32), (us[1], 6, 31)) for f in (min, max)]
    assert (exact["a"]["loo_p_min"], exact["a"]["loo_p_max"]) == pytest.approx((min(ends), max(ends)))
    assert exact["b"]["loo_p_min"] is None and exact["d"]["loo_p_max"] is None
    assert exact["c"]["loo_p_min"] == pytest.approx(min(left_out([1.0], [2.0, 3.0], lambda p, n: exact_p(u_of(p, n), len(p), len(n)))))


def test_interval_hook_is_held_to_the_parsers_rules(spark):
    rows = [(1, {"spans": "1-2;5-4;-3-1;9-99;3-3"}, 10.0, 100), (2, None, 10.0, 100), (3, {"spans": ""}, 10.0, 100)]
    df = spark.createDataFrame(rows, "video long, labels map<string,string>, fps double, n_frames long")

    def spans(labels, fps, n_frames):
        text = labels.get("spans")
        return [tuple(float(x) for x in part.rsplit("-", 1)) for part in text.split(";")] if text else None

    got = sorted(tuple(r) for r in hooked_intervals(df, spans).collect())
    assert got == [(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 4.0, 5.0), (1, 9.0, 10.0)]
    for bad in ([(1.0, float("nan"))], [3], [("a", 1)]):
        with pytest.raises(Exception, match="recording .*video.*1"):
            hooked_intervals(df.where("video = 1"), lambda labels, fps, n, bad=bad: bad).collect()
