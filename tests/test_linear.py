import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import linear as LN
from kinetable.operators import segments as SG
from kinetable.operators.latent import agreement


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 4))
    y = x @ rng.normal(size=(4, 1)) + rng.normal(size=(120, 1))
    df = spark.createDataFrame([(i, i % 3, int(i // 3), v.tolist(), float(t[0])) for i, (v, t) in enumerate(zip(x, y))], "clip_id long, video int, m long, mu array<double>, y double")
    return df, x, y[:, 0]


def test_ridge_against_normal_equations(data):
    df, x, y = data
    got = LN.ridge_feature_r2(df, ["y"], F.col("clip_id") >= 96).first()["r2"]
    tr, te = slice(0, 96), slice(96, 120)
    m, s = x[tr].mean(0), x[tr].std(0)
    z = (x - m) / s
    c = np.linalg.solve(z[tr].T @ z[tr] + np.eye(4), z[tr].T @ (y[tr] - y[tr].mean()))
    p = z[te] @ c + y[tr].mean()
    assert got == pytest.approx(1 - ((y[te] - p) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum(), abs=1e-9)


def test_pca_and_frechet(data):
    df, x, _ = data
    p, share = LN.pca_project(df, 6)
    w = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(share[:4], w / w.sum()) and share[5] == 0
    c = np.array([r["coords"] for r in p.orderBy("clip_id").collect()])
    assert np.allclose(c[:, :4].var(axis=0, ddof=1), w) and (c[:, 4:] == 0).all()
    assert LN.frechet_distance(df, df).first()[0] == pytest.approx(0.0, abs=1e-6)


def test_ou_and_equivariance(data):
    df, x, _ = data
    fit = LN.ou_fit(df, "mu")
    a = np.concatenate([x[v::3][:-1] for v in range(3)])
    b = np.concatenate([x[v::3][1:] for v in range(3)])
    assert np.allclose(fit["a"], np.linalg.lstsq(a, b, rcond=None)[0].T, atol=1e-8)
    mirror = np.diag([-1.0, 1.0, -1.0, 1.0])
    got = LN.equivariance_fit(LN.apply_map(df, "mu", "mu_mirror", mirror))
    assert np.allclose(got["a"], mirror, atol=1e-6) and got["variance_explained"] == pytest.approx(1.0)
    s = LN.asymmetry_score(df, got["a"]).orderBy("clip_id").toPandas()["score"]
    assert np.allclose(s, np.hypot(x[:, 0], x[:, 2]), atol=1e-6)


def test_project_velocity(data):
    df, x, _ = data
    b = LN.svd_basis(df)
    got = LN.project_velocity(df, b, n=2).orderBy("video", "m").toPandas()
    w = ((x - b["centre"]) / b["scale"]) @ b["vectors"][:2].T
    d = np.concatenate([np.diff((w[v::3] - w[v::3].mean(0)) / (w[v::3].std(0) + 1e-8), axis=0) for v in range(3)])
    assert np.allclose(np.stack(got["z"]), d / (d.std() + 1e-8))


def test_greedy_matching(spark):
    det = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 9.0), (2, 5.0)], "video int, t double")
    ann = spark.createDataFrame([(1, 1.6), (1, 2.1), (1, 20.0), (3, 1.0)], "video int, t double")
    got = {(r["video"], r["tol"]): (r["matched"], r["n_detected"], r["n_annotated"]) for r in SG.match_events(det, ann, [0.5, 1.2]).collect()}
    # 1.6 takes 2.0 first, so 2.1 has only 1.0 left, within 1.2 but not 0.5
    assert got[(1, 0.5)] == (1, 3, 3) and got[(1, 1.2)] == (2, 3, 3)
    assert got[(2, 0.5)] == (0, 1, 0) and got[(3, 1.2)] == (0, 0, 1)
    s = {r["tol"]: (r["precision"], r["recall"]) for r in SG.match_scores(SG.match_events(det, ann, [0.5])).collect()}
    assert s[0.5] == (0.25, 0.25)


@pytest.mark.parametrize("size", [5, 4096])
def test_pelt_equals_full_search(spark, size):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (20, 2)), rng.normal(4, 0.5, (15, 2)), rng.normal(-2, 2, (22, 2))])
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "video int, m long, z array<double>")
    got = [r["break"] for r in SG.pelt_change_points(df, 8.0, min_size=2, jump=1, size=size).orderBy("break").collect()]

    def cost(a, b):
        s = x[a:b]
        return (b - a) * np.linalg.slogdet(np.cov(s.T, bias=True) + 1e-6 * np.eye(2))[1]

    best = {0: (-8.0, [])}
    for t in range(2, len(x) + 1):
        best[t] = min(((best[s][0] + cost(s, t) + 8.0, best[s][1] + [t]) for s in best if t - s >= 2), key=lambda v: v[0])
    assert got == best[len(x)][1]


def test_agreement_values(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1), (2, -1), (None, 1)], "a int, b int")
    r = agreement(df, "a", "b").first()
    assert (r["n"], r["ari"], r["nmi"]) == (4, 1.0, 1.0) and r["ami"] == pytest.approx(1.0)


def test_latent_queries_read_every_dimension(spark, monkeypatch):
    from kinetable.catalog import QUERIES, fits

    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 40))
    x[:, 39] += 2 * x[:, 19]  # the last dimensions of the halves go together
    x[17, 39] += 60.0
    rows = spark.createDataFrame([(i, 0, i, v.tolist()) for i, v in enumerate(x)], "clip_id long, video long, start_frame long, mu array<double>")
    monkeypatch.setattr(fits, "latents", lambda spark, d: rows)
    run = lambda name: QUERIES[name].run(spark, "")
    score = run("equivariance_score").orderBy("clip_id").toPandas()["score"]
    assert np.allclose(score, np.linalg.norm(x[:, :20], axis=1), atol=1e-3)
    c = x - x.mean(0)
    want = np.linalg.svd(np.linalg.qr(c[:, :20])[0].T @ np.linalg.qr(c[:, 20:])[0], compute_uv=False)[:5]
    assert np.allclose(run("canonical_correlation").orderBy("component").toPandas()["correlation"], want, atol=1e-4)
    assert run("typicality").orderBy("log_density").first()["clip_id"] == 17
