"""Cases that once gave wrong answers."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.catalog import QUERIES
from kinetable.functions import special
from kinetable.functions.assignment import assign
from kinetable.functions.hashes import Numbers
from kinetable.functions.special import exact_rank_sum_p
from kinetable.operators import chain as C
from kinetable.operators import excess as X
from kinetable.operators import inference as I
from kinetable.operators import kernels as KE
from kinetable.operators import limbs as LB
from kinetable.operators import segments as SG
from kinetable.operators.excess import _chain_words, _draw_words
from kinetable.plans.draws import _smallest, resample_weights, smallest_sums
from kinetable.plans.ranks import mid_ranks
from kinetable.session import cut_lineage


def test_assignment_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = rng.integers(1, 7)
        c = rng.random((n, n)) if rng.random() < 0.8 else rng.integers(0, 3, (n, n)).astype(float)
        got = assign(c)
        assert sorted(got) == list(range(n))
        assert c[np.arange(n), got].sum() == pytest.approx(min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_rank_sum_counts_over_the_smaller_group():
    ranks = np.arange(1, 2001)
    assert exact_rank_sum_p(ranks, 1999, 1.0) == pytest.approx(2 / 2000)
    assert exact_rank_sum_p(ranks[:7], 5, 0.8) == pytest.approx(exact_rank_sum_p(ranks[:7], 2, 0.2))


def test_repeated_events_match_one_by_one(spark):
    d = spark.createDataFrame([(1, 10.0), (1, 10.0)], "video int, t double")
    a = spark.createDataFrame([(1, 10.0), (1, 11.0), (2, 5.0)], "video int, t double")
    m = SG.match_events(d, a, [5.0])
    assert {(r.video, r.matched, r.n_detected, r.n_annotated) for r in m.collect()} == {(1, 2, 2, 2), (2, 0, 0, 1)}
    s = SG.match_scores(m).first()
    assert s.hit_rate == 0.5 and s.precision == 1.0 and s.recall == pytest.approx(2 / 3)
    none = SG.match_scores(SG.match_events(d.limit(0), a, [5.0])).first()
    assert none.precision is None and none.recall == 0.0


def test_missing_frame_is_named(spark):
    p = LB.CouplingParams(w=5, tau_max=1)
    rows = [(7, 0, 0, f, float(f), 1.0, 2.0, float(f % 3)) for f in range(20) if f != 9]
    d = spark.createDataFrame(rows, "video int, pair int, direction int, frame long, px double, py double, ox double, oy double")
    with pytest.raises(Exception, match="video 7.*frames are missing"):
        LB.lagged_coupling(d, spark.createDataFrame([(7, 20)], "video int, n_frames int"), p).collect()


def test_reorderings_against_enumeration():
    rng = np.random.default_rng(3)
    for counts in ([3, 2, 2], [3, 3], [4, 2, 1]):
        counts = np.array(counts)
        s = rng.random((len(counts), len(counts)))
        words = {w for w in itertools.permutations(np.repeat(np.arange(len(counts)), counts)) if all(a != b for a, b in zip(w, w[1:]))}
        v = [s[np.array(w[:-1]), np.array(w[1:])].mean() for w in words]
        st, lw = _draw_words(counts, s, 20_000, 1, rng)
        w = np.exp(lw - lw.max())
        assert np.average(st[w > 0], weights=w[w > 0]) == pytest.approx(np.mean(v), abs=0.01)
        assert _chain_words(counts, s, 4000, 1, rng).mean() == pytest.approx(np.mean(v), abs=0.01)


def test_degenerate_centralities(spark):
    a = np.array([[0.5, 0.3, 0.2], [0.1, 0.8, 0.1], [0.4, 0.4, 0.2]])
    got = C.degenerate_centralities(spark.createDataFrame([(1, a.ravel().tolist())], "one int, a array<double>"), ["one"], 3).toPandas().sort_values("state")
    assert got["out_degree_is_one"].all() and got["right_is_constant"].all()
    x = got["pagerank_85"].to_numpy()
    assert np.allclose(0.85 * x @ a + 0.05, x) and np.allclose(got["pi"].to_numpy() @ a, got["pi"])


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2600, 3))
    c = (x[:, 0] + rng.normal(size=2600) > 0).astype(int)
    return x, c, spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c))], "clip_id long, mu array<double>, cls int")


def test_kernels_use_every_row(points):
    x, c, df = points
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    upper = np.triu_indices(len(x), 1)
    h = np.median(np.sqrt(d2[upper]))
    k = np.exp(-d2 / (2 * h * h))
    got = KE.pairwise_kernel(df).orderBy("clip_id").toPandas()
    assert len(got) == 2600 and np.allclose(got["row_sum"], k.sum(1)) and got["bandwidth"].iloc[0] == pytest.approx(h)

    g = k - np.diag(np.diag(k))
    h2 = np.median(d2[upper])
    g = np.exp(-d2 / (2 * h2))
    np.fill_diagonal(g, 0)
    a, b = c == 0, c == 1
    m, n = a.sum(), b.sum()
    want = g[np.ix_(a, a)].sum() / (m * (m - 1)) + g[np.ix_(b, b)].sum() / (n * (n - 1)) - 2 * g[np.ix_(a, b)].mean()
    r = KE.mmd_test(df.where("cls = 0"), df.where("cls = 1"), draws=19).first()
    assert (r.m, r.n) == (m, n) and r.mmd2 == pytest.approx(want) and r.p_plus_one == pytest.approx(0.05)

    q = np.where(c[:, None] == c[None], 0.0, 2.0)
    hy = np.median(np.sqrt(q[upper])) or 1.0
    lq = np.exp(-q / (2 * hy * hy))
    centre = np.eye(2600) - 1 / 2600
    r = KE.hsic_test(df, "clip_id", "mu", "cls", draws=19).first()
    assert r.n == 2600 and r.hsic == pytest.approx((k @ centre @ lq @ centre).trace() / 2599**2) and r.p_value == pytest.approx(0.05)

    d = np.sqrt(d2)
    own = np.array([d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1) for i in range(2600)])
    far = np.array([d[i, c != c[i]].mean() for i in range(2600)])
    r = KE.silhouette(df, "clip_id", "mu", "cls").first()
    assert r.n == 2600 and r.silhouette == pytest.approx(((far - own) / np.maximum(far, own)).mean())


def test_draws_are_exact_and_permutations_complete(points):
    _, _, df = points
    tiles = KE.Tiles(df.select(F.col("clip_id").alias("id"), F.col("mu").alias("v")))
    cut = KE._thresholds(tiles, 700, 5, 3)
    assert [(KE._bits(np.arange(2600), j + 1, 3) <= cut[j]).sum() for j in range(5)] == [700] * 5
    for n in (1, 2, 7, 1000):
        assert sorted(KE.shuffled(np.arange(n), n, 1, 0)) == list(range(n))


def test_named_rank_sum_method_does_not_switch(spark):
    # 12 of 40 on top without ties: more than 5,000,000 assignments, and the exact p is two of them
    df = spark.createDataFrame([(0, i, float(i), int(i >= 28)) for i in range(40)], "grp long, id long, value double, label int")
    exact = I.rank_sum_test(df, ["grp"], ["id"], method="exact").first()
    assert exact["method"] == "exact" and exact["p"] == pytest.approx(2 / math.comb(40, 12))
    small = I.rank_sum_test(df.where("id >= 22"), ["grp"], ["id"], draws=9, method="permutation").first()
    assert small["method"] == "permutation" and small["p"] >= 0.1


def test_later_batches_only_for_recordings_left_short(spark, monkeypatch):
    # two batches suffice for every recording here, so no more are drawn
    rng = np.random.default_rng(3)
    rows = [(v, m, int(q)) for v in range(6) for m, q in enumerate(rng.integers(0, 5, 40))]
    path = spark.createDataFrame(rows, "video long, m long, state int")
    s = rng.random((5, 5))
    sim = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(5) for j in range(5)], "state int, next_state int, s double")
    batches = []

    def watched(df):
        out = cut_lineage(df)
        if "batch" in out.columns:
            batches.append(out.agg(F.max("batch")).first()[0])
        return out

    monkeypatch.setattr(X, "cut_lineage", watched)
    null = X.no_repeat_null(path, sim, 5, draws=100).collect()
    assert {r["method"] for r in null} == {"sis"} and min(r["ess"] for r in null) >= 100
    assert max(b for b in batches if b is not None) == 2


def test_stacked_words_equal_single_ones():
    rng = np.random.default_rng(5)
    counts = [rng.multinomial(n, [0.2] * 5) for n in (3, 50, 17, 50, 8)] + [np.array([5, 1, 0, 0, 0])]
    s = rng.random((5, 5))
    stacked = X._draw_stack(counts, s, 40, 1, [np.random.default_rng(i) for i in range(6)])
    for i, (st, lw) in enumerate(stacked):
        one = X._draw_words(counts[i], s, 40, 1, np.random.default_rng(i))
        assert np.array_equal(st, one[0]) and np.array_equal(lw, one[1])


def _groups(spark):
    rng = np.random.default_rng(11)
    rows = [(g, i, float(np.round(rng.normal(), 1)), int(rng.random() < 0.3)) for g in ("a", "b") for i in range(400)]
    return spark.createDataFrame(rows, "g string, id long, value double, label int")


def test_permutation_sums_equal_labelled_draws(spark):
    # the sums of the drawn ranks against the rows labelled draw by draw
    d = _groups(spark)
    a = I.auc_table(d, ["g"])
    null = I.permuted_labels(d.join(a.select("g", "n_pos"), "g"), ["g"], ["id"], "n_pos", 7, 0)
    want = {(r["g"], r["draw"]): r["u"] for r in I.auc_table(null, ["g", "draw"], "value", "_lab").collect()}
    ranked = mid_ranks(d, ["g"], "value").join(a.select("g", "n_pos"), "g")
    for ranges in (4, 1024):
        sums = smallest_sums(ranked, ["g"], ["id"], "rank", "n_pos", 7, 0, ranges).join(a.select("g", "n_pos"), "g").collect()
        assert {(r["g"], r["draw"]): r["sum"] - r["n_pos"] * (r["n_pos"] + 1) / 2 for r in sums} == want


def test_resampled_auc_equals_weighted_rows(spark):
    # reps side by side against one weighted table a rep, with a last block that is not full
    d = _groups(spark)
    boot = resample_weights(d, ["g", "label"], ["id"], 7, 0)
    want = {(r["g"], r["rep"]): r["auc"] for r in I.auc_table(boot, ["g", "rep"], "value", "label", "weight").collect()}
    got = {(r["g"], r["rep"]): r["auc"] for r in I.resampled_auc(d, ["g"], ["id"], 7, 0, wide=4).collect()}
    assert got == pytest.approx(want, abs=1e-15) and len(got) == 14


def test_rows_do_not_move_once_a_draw(spark, monkeypatch):
    # no step copies the rows per draw into the tie table
    d = _groups(spark)

    def refuse(*_):
        raise AssertionError("rows were copied per draw")

    monkeypatch.setattr(I, "permuted_labels", refuse)
    monkeypatch.setattr(I, "resample_weights", refuse)
    assert I.rank_sum_test(d, ["g"], ["id"], draws=5, method="permutation").count() == 2
    assert I.bootstrap_auc_ci(d, ["g"], ["id"], reps=5).count() == 2


def test_rank_sum_of_large_groups_is_exact_without_counting():
    # the counts of 300 of 1,500 rows do not fit a double; smaller groups agree with them, with ties and in the tails
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=150), rng.integers(0, 9, 150), np.r_[np.zeros(70), np.ones(80)]):
        values, at, n = np.unique(x, return_inverse=True, return_counts=True)
        w = np.rint(2 * (n.cumsum() - (n - 1) / 2.0)[at]).astype(int)
        ways = special.subset_sum_counts(w, 35)
        for z in (-3, 0, 2, 5):
            least = int(35 * w.mean() + z * math.sqrt(35 * 115 / 149) * w.std())
            assert special.subset_tail(w, 35, least) == pytest.approx(ways[least:].sum() / ways.sum(), rel=1e-7)
    ranks = np.arange(1.0, 1501.0)
    u, sd = 0.53 * 300 * 1200, math.sqrt(300 * 1200 * 1501 / 12)
    assert exact_rank_sum_p(ranks, 300, 0.53) == pytest.approx(math.erfc((u - 180000 - 0.5) / sd / math.sqrt(2)), abs=1e-4)
    assert exact_rank_sum_p(ranks, 1200, 0.47) == pytest.approx(exact_rank_sum_p(ranks, 300, 0.53), rel=1e-9)


def test_packed_draws_equal_distributed_ones(spark):
    # all draws over packed groups against the paths for groups too large to pack, with rows missing and equal values
    d = _groups(spark).where("g = 'a' OR id % 7 > 0")
    a = I.auc_table(d, ["g"])
    ranked = mid_ranks(d, ["g"], "value").join(a.select("g", "n_pos"), "g")
    for most in (500, 4_000_000):
        packed, far = (smallest_sums(ranked, ["g"], ["id"], "rank", "n_pos", 30, 4, most=m).collect() for m in (most, 0))
        assert {(r["g"], r["draw"]): r["sum"] for r in packed} == {(r["g"], r["draw"]): r["sum"] for r in far} and len(packed) == 60
    packed, far = (I.resampled_auc(d, ["g"], ["id"], 30, 4, most=m).collect() for m in (4_000_000, 0))
    assert {(r["g"], r["rep"]): r["auc"] for r in packed} == pytest.approx({(r["g"], r["rep"]): r["auc"] for r in far}, abs=1e-15)


def test_numbers_equal_seeded_uniforms():
    texts, heads = [str(i).encode() for i in (0, 7, 10, 99, 123456, 10**12)] + [b"", b"x" * 51], [f"0:{j}:".encode() for j in (1, 9, 10, 200000)]
    want = [[int(hashlib.md5(h + t).hexdigest()[:13], 16) for t in texts] for h in heads]
    assert Numbers(texts)(heads).tolist() == want
    assert _smallest(np.array([[5, 3, 3, 1, 3]], "u8"), 3).tolist() == [[0, 1, 1, 1, 0]]


def test_registered_draws_are_the_operators_own():
    # 19 draws and 25 reps before
    assert "range(1, 200001)" in QUERIES["rank_sum_permutation_p"].sql and "/ 200001.0" in QUERIES["rank_sum_permutation_p"].sql
    assert "range(1, 10001)" in QUERIES["bootstrap_auc_ci"].sql


def test_packed_surrogates_equal_copied_ones(spark):
    # recordings of few frames are rolled where they lie; the path for long ones copies rows per draw
    rng = np.random.default_rng(8)
    rows = [(v, "LA-LL", f, *map(float, rng.normal(size=4))) for v, n in ((1, 40), (2, 33), (3, 9)) for f in range(n - 1)]
    pairs = spark.createDataFrame(rows, "video long, pair string, frame long, ax double, ay double, bx double, by double")
    lengths = spark.createDataFrame([(1, 40), (2, 33), (3, 9)], "video long, n_frames long")
    p = LB.CouplingParams(w=8, tau_max=3, dtau=1, ell_min=2, c=0.25)
    packed, mixed = ({r["video"]: (r["coupled"], r["p"]) for r in LB.coupling_surrogate_p(pairs, lengths, p, 9, size=n).collect()} for n in (4096, 35))
    copied = {r["video"]: (r["coupled"], r["p"]) for r in LB._copied_surrogates(pairs, lengths, p, 9, 0, 4096).collect()}
    assert packed == copied and set(packed) == {1, 2}
    # chunks of the long path have sums of their own, so they may differ by rounding
    assert mixed[2] == copied[2] and mixed[1] == pytest.approx(copied[1])
