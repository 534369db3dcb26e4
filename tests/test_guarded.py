"""Degenerate states are refitted with a higher floor, then tied; the way there is in the output."""

import numpy as np
import pytest

from kinetable.operators import hmm as H


def frame(spark, series):
    rows = [(v, m, z.tolist()) for v, x in series.items() for m, z in enumerate(x)]
    return spark.createDataFrame(rows, "video long, m long, z array<double>")


def test_near_singular_thin_state_ends_tied_with_its_history(spark):
    rng = np.random.default_rng(6)
    series = {}
    for v in range(4):
        x = rng.normal(size=(60, 2)) * 2000
        t = rng.normal(size=3)
        x[20:23] = np.stack([t * 1e6 + 5e7, t * 1e6 + 5e7], 1) + rng.normal(size=(3, 2)) * 1e-4  # on a line: 12 rows in all
        series[v] = x
    s = H.sequence_chunks(frame(spark, series))
    got = H.fit_guarded(s, [2], restarts=2, n_iter=15)[2]
    first, *rest = got.attempts
    assert first["condition"] > 1e8 and first["verdict"] == "ill-conditioned: floor x 10" and rest[0]["floor"] == pytest.approx(1e-2)
    assert len(got.attempts) == 3
    bounded = H.fit_guarded(s, [2], restarts=2, n_iter=15, most_condition=1e16)[2]
    assert [a["covariance"] for a in bounded.attempts] == ["full", "tied"] and bounded.attempts[0]["least_rows"] == 12
    assert bounded.attempts[0]["verdict"] == "thin state: tied" and bounded.model.covariance == "tied"
    assert np.allclose(bounded.model.cov[0], bounded.model.cov[1])
    for g in (got, bounded):
        assert all(b >= a - 1e-6 * abs(a) for a, b in zip(g.model.history, g.model.history[1:]))
    table = H.attempts(spark, {2: bounded}).orderBy("attempt").collect()
    assert [r["verdict"] for r in table] == ["thin state: tied", "kept, still degenerate"]


def test_bound_on_states_and_leave_one_out(spark):
    rng = np.random.default_rng(7)
    w = frame(spark, {v: rng.normal(size=(6, 1)) + 4 * (v % 2) for v in range(3)})
    s = H.sequence_chunks(w, folds=H.leave_one_out(w))
    assert H.allowed_states(s, range(2, 11)) == [2, 3]
    with pytest.raises(ValueError):
        H.allowed_states(s, [7, 8])
    _, score = H.select(s, [2], criterion="loo", n_iter=4)
    want = []
    for fold in range(3):
        m = H.fit(s, [H.Model(2, fold=fold)], 4)
        held = H.expected_counts(s, m, score_held_out=True)[0]
        want.append(held["ll"][0] / held["n"][0])
    assert score["score"].iloc[0] == pytest.approx(np.mean(want))
