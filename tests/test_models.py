"""Small re-derivations: enumeration, direct regressions, brute-force neighbours."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetable.functions import special
from kinetable.operators import entropy as E
from kinetable.operators import excess as X
from kinetable.operators import hmm as H
from kinetable.operators import inference as I
from kinetable.operators import kernels as KE
from kinetable.operators import limbs as LB
from kinetable.operators import neighbours as NB


def toy_windows(spark, n=23, videos=4, d=2):
    rng = np.random.default_rng(3)
    rows = [(v, m, (rng.normal(size=d) + 3 * ((m // 5) % 2)).tolist()) for v in range(videos) for m in range(n)]
    return spark.createDataFrame(rows, "video long, m long, z array<double>")


@pytest.mark.parametrize("kind,lags", [("gaussian", 0), ("ar", 2)])
def test_em_does_not_depend_on_chunks(spark, kind, lags):
    w = toy_windows(spark)
    fits = [H.fit(H.sequence_chunks(w, lags=lags, size=s), [H.Model(2, kind, lags=lags)], n_iter=4)[0] for s in (5, 4096)]
    assert np.allclose(fits[0].history, fits[1].history, rtol=1e-7)
    assert np.allclose(fits[0].a, fits[1].a, atol=1e-6) and np.allclose(fits[0].mean, fits[1].mean, atol=1e-6)
    if kind == "gaussian":
        assert all(b >= a - 1e-3 for a, b in zip(fits[0].history, fits[0].history[1:]))


def test_viterbi_and_loglik_by_enumeration(spark):
    w = toy_windows(spark, n=7, videos=2)
    m = H.fit(H.sequence_chunks(w), [H.Model(2)], n_iter=3)[0]
    for size in (3, 4096):
        s = H.sequence_chunks(w, size=size)
        path = H.decode(s, m, size).orderBy("video", "m").toPandas()
        ll = H.sequence_loglik(s, m).toPandas().set_index("video")["loglik"]
        for v, g in w.toPandas().sort_values("m").groupby("video"):
            lb = H._emission(m, np.stack(g["z"].to_numpy()), np.zeros((0, 2)))
            score = {q: math.log(m.pi[q[0]] + 1e-300) + lb[0, q[0]] + sum(math.log(m.a[a, b]) + lb[t + 1, b] for t, (a, b) in enumerate(zip(q, q[1:])))
                     for q in itertools.product(range(2), repeat=7)}
            assert tuple(path[path.video == v]["state"]) == max(score, key=score.get)
            assert ll[v] == pytest.approx(np.logaddexp.reduce(list(score.values())), abs=1e-8)


def test_nearest_two_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(150, 3)), rng.normal(size=(80, 3)) * 0.01 + 5, np.full((3, 3), 9.0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "clip_id long, mu array<double>")
    got = NB.nearest_two(df, tile=20, pivots=6).orderBy("clip_id").toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :2]
    assert np.allclose(got[["r1", "r2"]], want)
    assert NB.count_duplicates(NB.nearest_two(df, tile=20, pivots=6)).first()["n_duplicates"] == 3


def test_pair_quantile_brute_force(spark):
    x = np.random.default_rng(2).normal(size=(60, 4))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(60, 1)]
    tiles = KE.Tiles(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), 7)
    assert KE.pair_quantile(tiles) == pytest.approx(np.median(d), abs=1e-9)


def test_rank_sum_p_values():
    ranks = np.arange(1, 39)
    assert special.exact_rank_sum_p(ranks, 6, 1.0) == pytest.approx(2 / math.comb(38, 6))
    r = np.array([1, 2.5, 2.5, 4, 5, 6.5, 6.5])
    obs = abs((r[[0, 3, 6]].sum() - 6) / 12 - 0.5)
    hits = [abs((sum(c) - 6) / 12 - 0.5) >= obs - 1e-12 for c in itertools.combinations(r, 3)]
    assert special.exact_rank_sum_p(r, 3, 0.5 + obs) == pytest.approx(np.mean(hits))
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert special.binomial_upper_tail(8, 10) == pytest.approx(56 / 1024)


def test_separated_groups(spark):
    df = spark.createDataFrame([("e", i, float(i), int(i >= 32)) for i in range(38)], "endpoint string, video int, value double, label int")
    r = I.rank_sum_test(df, ["endpoint"], ["video"], draws=10).first()
    assert r["auc"] == 1.0 and r["method"] == "exact" and r["p"] == pytest.approx(2 / 2760681)


def test_peak_pick_matrix(spark):
    m = np.full((8, 5), 0.1)
    for row, (lag, v) in {1: (2, 0.30), 2: (2, 0.33), 3: (3, 0.35), 4: (3, 0.35)}.items():
        m[row, lag] = v
    g = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(m)], "video int, row long, gain array<double>")
    r = LB.peak_pick(LB.peak_rows(g, 2), ["video"], 0.25, 1, 1).first()
    assert r["coupled"] == 0.5 and r["strength"] == pytest.approx(0.3325) and r["n_runs"] == 1


@pytest.mark.parametrize("size", [6, 4096])
def test_lagged_gain_by_regression(spark, size):
    rng = np.random.default_rng(4)
    n, w, tm = 40, 9, 2
    a, b = rng.normal(size=(n, 2)), rng.normal(size=(n, 2))
    rows = [(1, "p", 0, i, *map(float, a[i]), *map(float, b[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "video long, pair string, direction int, frame long, px double, py double, ox double, oy double")
    ln = spark.createDataFrame([(1, n + 1)], "video long, n_frames long")
    got = LB.lagged_coupling(df, ln, LB.CouplingParams(w=w, tau_max=tm), size=size).orderBy("row").toPandas()
    assert got["row"].tolist() == list(range(tm, n - w - tm + 1))
    for t, gain in zip(got["row"], got["gain"]):
        k = np.arange(t, t + w)
        for j, tau in enumerate(range(-tm, tm + 1)):
            y = a[k + tau]
            ssr = []
            for x in (np.column_stack([np.ones(w), a[k]]), np.column_stack([np.ones(w), a[k], b[k]])):
                ssr.append(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())
            assert gain[j] == pytest.approx((ssr[0] - ssr[1]) / ((y - y.mean(0)) ** 2).sum(), abs=1e-8)


def test_direction_entropy_values(spark):
    p = math.pi
    rows = [("one", 0.1)] * 3 + [("two", 0.1), ("two", 0.1 - p)] + [("pi", p), ("pi", -p)] + [("all", -p + (i + 0.5) * p / 4) for i in range(8)]
    got = {r["g"]: r["entropy"] for r in E.direction_entropy(spark.createDataFrame(rows, "g string, a double"), ["g"], "a").collect()}
    assert got["one"] == 0.0 and got["two"] == pytest.approx(1 / 3) and got["pi"] == 0.0 and got["all"] == pytest.approx(1.0)


@pytest.mark.parametrize("counts,n_words", [([2, 1, 1], 6), ([3, 3], 2), ([3, 2, 2], 38), ([2, 2, 2, 1], 246)])
def test_sequential_draws_count_words(counts, n_words):
    k = len(counts)
    _, lw = X._draw_words(np.array(counts), np.eye(k), 4000, 1, np.random.default_rng(0))
    assert np.exp(lw).mean() == pytest.approx(n_words, rel=0.06)


def test_no_repeat_null_by_enumeration(spark):
    seq = [0, 1, 0, 2, 1, 2, 0]
    rng = np.random.default_rng(1)
    s = rng.random((3, 3))
    path = spark.createDataFrame([(1, m, q) for m, q in enumerate(seq)], "video long, m long, state int")
    sim = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(3) for j in range(3)], "state int, next_state int, s double")
    words = {w for w in itertools.permutations(seq) if all(a != b for a, b in zip(w, w[1:]))}
    want = np.mean([np.mean([s[a, b] for a, b in zip(w, w[1:])]) for w in words])
    r = X.excess_similarity(path, sim, 3, draws=3000).first()
    assert r["null_mean"] == pytest.approx(want, abs=0.01) and r["method"] == "sis"
    uni = np.mean([np.mean([s[a, b] for a, b in zip(w, w[1:])]) for w in itertools.permutations(seq)])
    assert r["null_uniform"] == pytest.approx(uni)
    chain = X._chain_words(np.array([3, 2, 2]), s, 150, 1, np.random.default_rng(0)).mean()
    assert chain == pytest.approx(want, abs=0.03)


def test_mixed_model_by_direct_likelihood(spark):
    rng = np.random.default_rng(8)
    rows = []
    for sub in range(12):
        u = rng.normal()
        for j in range(3 + sub % 2):
            c = float(rng.integers(0, 2))
            rows.append((sub, "m", 1.0 + 0.8 * c + u + rng.normal() * 0.5, c))
    df = spark.createDataFrame(rows, "subject_id int, metric string, value double, clinical double")
    got = I.mixed_model(df, ["m"], "clinical", []).first()
    p = pd.DataFrame(rows, columns=["s", "m", "y", "c"])
    x, y = np.column_stack([np.ones(len(p)), p.c]), p.y.to_numpy()
    same = (p.s.to_numpy()[:, None] == p.s.to_numpy()[None]).astype(float)

    def ll(lam):
        v = np.eye(len(p)) + lam * same
        vi = np.linalg.inv(v)
        beta = np.linalg.solve(x.T @ vi @ x, x.T @ vi @ y)
        r = y - x @ beta
        return -0.5 * (len(p) * math.log(r @ vi @ r / len(p)) + np.linalg.slogdet(v)[1]), beta

    best = max((ll(math.exp(g)) for g in np.linspace(-8, 6, 3000)), key=lambda t: t[0])
    assert got["coef"] == pytest.approx(best[1][1], abs=1e-3) and 0 < got["p"] < 0.05


def test_chunks_advance_together():
    rng = np.random.default_rng(8)
    m = H._start(H.Model(3, seed=1), rng.normal(size=(3, 2)), np.eye(2), 1e-3)
    sizes, opens = [5, 1, 40, 17, 40, 2], np.array([True, True, False, True, True, False])
    first = np.concatenate(([0], np.cumsum(sizes)))
    logb = H._emission(m, rng.normal(size=(first[-1], 2)), None)
    vin, vout = np.where(opens[:, None], m.pi, rng.dirichlet(np.ones(3), len(sizes))), rng.uniform(0.1, 1, (len(sizes), 3))
    g, xi, ll = H._forward_backward(m, logb, first, opens, vin, vout)
    moves = np.zeros((3, 3))
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        e = np.exp(logb[a:b])
        forward = [(vin[i] if opens[i] else vin[i] @ m.a) * e[0]]
        for row in e[1:]:
            forward.append(forward[-1] @ m.a * row)
        back = [vout[i]]
        for row in e[:0:-1]:
            back.append(m.a @ (row * back[-1]))
        weight = np.array(forward) * np.array(back[::-1])
        assert np.allclose(g[a:b], weight / weight.sum(1, keepdims=True)) and ll[i] == pytest.approx(np.log(forward[-1].sum()))
        came = np.array(([] if opens[i] else [vin[i]]) + forward[:-1]).reshape(-1, 3)
        into = (e * np.array(back[::-1]))[1 if opens[i] else 0 :]
        for u, v in zip(came, into):
            w = u[:, None] * m.a * v[None]
            moves += w / w.sum()
    assert np.allclose(xi, moves)


def test_models_advance_together():
    # products and weights of models side by side against one model, one chunk and one row at a time
    rng = np.random.default_rng(6)
    first, chunk = np.array([0, 5, 8, 9, 15]), np.array([0, 1, 0, 2])
    models = [H.Model(3, pi=rng.dirichlet(np.ones(3)), a=rng.dirichlet(np.ones(3), 3), seed=s) for s in range(4)]
    logb = rng.normal(size=(4, 15, 3)) * 40
    vin, vout = rng.dirichlet(np.ones(3), (4, 4)), rng.random((4, 4, 3))
    mats = H._transfers(models, logb, first, chunk == 0)
    g, w, ll = H._forward_backwards(models, logb, first, chunk == 0, vin, vout)
    for i, m in enumerate(models):
        one = H._forward_backward(m, logb[i], first, chunk == 0, vin[i], vout[i])
        assert np.allclose(g[i], one[0]) and np.allclose(w[i].sum(0), one[1]) and np.allclose(ll[i], one[2])
        for j, (s, e) in enumerate(zip(first[:-1], first[1:])):
            want = np.eye(3)
            for t in range(s, e):
                want = (want if chunk[j] == 0 and t == s else want @ m.a) * np.exp(logb[i, t] - logb[i, t].max())
                want /= want.max()
            assert np.allclose(mats[i, j], want)
