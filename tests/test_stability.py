"""The stability battery against the same runs done one by one, and co-assignment against a dense count."""

import numpy as np
import pytest

from kinetable.operators import keyed as K
from kinetable.operators import stability as S


def test_battery_equals_single_runs(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(80, 2)), rng.normal(size=(70, 2)) + [5, 0], rng.normal(size=(50, 2)) + [2, 6]])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "clip_id long, mu array<double>, _level0 int").repartition(3)
    scores, labels = S.stability_battery(df, 3, runs=3, n_subsample=2, n_bootstrap=2, consensus=40, block=64)
    got = {tuple(r)[:4]: r["ari"] for r in scores.collect()}
    assert len(got) == 2 * 3 + 2 * 2 + 2 * 2 + 1
    ids = np.arange(200)
    near = lambda c, x=x: ((x[:, None] - c) ** 2).sum(-1).argmin(1)
    table = lambda a, b: np.histogram2d(a, b, bins=(np.arange(4), np.arange(4)))[0]

    def lloyd(own, seed):
        order = own[np.argsort(K._drawn(own, seed), kind="stable")]
        c = x[order[:3]]
        for _ in range(100):
            lab = near(c, x[own])
            c, old = np.array([x[own][lab == j].mean(0) if (lab == j).any() else c[j] for j in range(3)]), c
            if np.allclose(c, old, rtol=0, atol=1e-12):
                return c

    full = near(lloyd(ids, 0))
    seeds = [near(lloyd(ids, 1 + r)) for r in range(3)]
    assert got["reseed", "kmeans", 0, 2] == pytest.approx(K.rand_index(table(seeds[0], seeds[2])))
    for r in range(2):
        h = K._drawn(ids, 1000 + r)
        own = np.sort(np.argsort(h)[:160])
        assert got["subsample", "kmeans", -1, r] == pytest.approx(K.rand_index(table(full[own], near(lloyd(own, 0), x[own]))))
        boot = ids[K._drawn(ids, 2000 + r) < np.uint64(int((1 - np.exp(-1)) * 2**64))]
        assert 100 < len(boot) < 150 and got["bootstrap", "kmeans", -1, r] == pytest.approx(K.rand_index(table(full[boot], near(lloyd(boot, 0), x[boot]))))
    assert got["cross", "kmeans_vs_gmm", -1, -1] > 0.9 and min(v for k, v in got.items() if k[1] == "gmm") > 0.5
    run = labels.toPandas()
    assert len(run) == 3 * 40 and all((run[run["run"] == r].set_index("clip_id")["cluster"] == seeds[r][run[run["run"] == r]["clip_id"]]).all() for r in range(3))
    share = {(r["a"], r["b"]): r["share"] for r in S.co_assignment(labels).collect()}
    some = sorted(set(run["clip_id"]))
    assert share == {(a, b): pytest.approx(np.mean([s[a] == s[b] for s in seeds])) for a in some for b in some if a < b}
    with pytest.raises(ValueError):
        S.stability_battery(df.limit(3), 3)
