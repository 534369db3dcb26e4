import numpy as np
import pyarrow as pa
import pytest

from kinetable.operators import filters as FL


def frame(spark, x):
    return spark.createDataFrame([(1, i, [float(a) for a in np.atleast_1d(v)]) for i, v in enumerate(x)], "video int, m long, z array<double>")


def test_design_passes_the_band_only():
    sos = FL.butterworth_sections(4, 1.0, 3.0, 25.0)

    def gain(f):
        z = np.exp(2j * np.pi * f / 25.0)
        return np.prod([abs((s[0] + s[1] / z + s[2] / z**2) / (s[3] + s[4] / z + s[5] / z**2)) for s in sos])

    assert gain(1.0) == pytest.approx(2**-0.5, abs=1e-6) and gain(3.0) == pytest.approx(2**-0.5, abs=1e-6)
    assert gain(1.7) == pytest.approx(1.0, abs=1e-3) and gain(0.2) < 0.01 and gain(9.0) < 0.01
    with pytest.raises(ValueError):
        FL.butterworth_sections(4, 1.0, 13.0, 25.0)


def test_chunks_and_zero_phase(spark):
    t = np.arange(260) / 25.0
    x = np.column_stack([np.sin(2 * np.pi * 1.7 * t) + 5.0, np.sin(2 * np.pi * 9.0 * t)])
    a = np.stack(FL.bandpass(frame(spark, x), 25.0, 1.0, 3.0, size=31).orderBy("m").toPandas()["z"])
    b = np.stack(FL.bandpass(frame(spark, x), 25.0, 1.0, 3.0).orderBy("m").toPandas()["z"])
    assert np.allclose(a, b, atol=1e-9) and a.shape == x.shape
    mid = slice(80, 180)
    assert np.allclose(a[mid, 0], np.sin(2 * np.pi * 1.7 * t[mid]), atol=0.03) and np.abs(a[mid, 1]).max() < 0.01


def test_outliers_are_bridged(spark):
    x = np.linspace(0, 10, 41)
    x[20] = 500.0
    got = np.stack(FL.filter_walk(frame(spark, x), 30.0, 15.0, do_filter=False, size=7).orderBy("m").toPandas()["z"])[:, 0]
    assert len(got) == 20 and np.allclose(got, np.linspace(0, 10, 20), atol=1e-9)


def direct_walk(x, src, dst):
    sos = FL.butterworth_sections(4, 0.01, min(dst, src) / 2 - 1e-6, src)
    pad, rest = FL.pad_length(sos), FL._rest_state(sos)[:, :, None]
    if len(x) > pad:
        y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
        for _ in range(2):
            y = FL._filter(sos, y.copy(), rest * y[0])[0][::-1]
        x = y[pad:-pad]
    dev = np.abs(x - np.median(x, axis=0))
    out = dev > 3 * 1.4826 * np.median(dev, axis=0) + 1e-9
    at = np.linspace(0, len(x) - 1, max(round(len(x) * dst / src), 2))
    keep = [~o if (~o).sum() >= 2 else np.ones(len(x), bool) for o in out.T]
    return np.column_stack([np.interp(at, np.flatnonzero(k), v[k]) for k, v in zip(keep, x.T)])


def test_query_filters_its_walks(spark, monkeypatch):
    from kinetable.catalog import QUERIES, fits

    t = np.arange(120) / 10.0
    x = np.column_stack([np.sin(2 * np.pi * 0.4 * t) + 5.0 + t / 9, np.sin(2 * np.pi * 4.0 * t) + t % 1.7])
    x[60] += 40.0
    monkeypatch.setattr(fits, "windows", lambda spark, d: frame(spark, x))
    got = QUERIES["filter_walk"].run(spark, "").orderBy("m").toPandas()[["z0", "z1"]].to_numpy()
    assert np.allclose(got, direct_walk(x, 10.0, 5.0), atol=1e-5)


def test_recordings_are_filtered_together(spark, monkeypatch):
    rng = np.random.default_rng(4)
    series = {v: rng.normal(size=(n, 1 + v % 3)).cumsum(0) for v, n in enumerate([90, 27, 28, 61, 200, 1, 90, 133])}
    rows = [(v, i, z.tolist()) for v, x in series.items() for i, z in enumerate(x)]
    steps = []
    many = FL._filter_many
    monkeypatch.setattr(FL, "_filter_many", lambda sos, y, z, n: (steps.append(y.shape), many(sos, y, z, n))[1])
    sos = FL.butterworth_sections(4, 1.0, 3.0, 25.0)
    pad, rest = FL.pad_length(sos), FL._rest_state(sos)[:, :, None]
    chunks = pa.array([x.tolist() for x in series.values()])
    for i, y, z in FL._filtered(sos, chunks, [None] * len(series)):
        x = series[i]
        one = [FL._filter(sos, x[:, [c]], rest * x[0, [c]]) for c in range(x.shape[1])]
        assert np.array_equal(y, np.hstack([a for a, _ in one])) and np.array_equal(z, np.concatenate([b for _, b in one], axis=2))
    assert steps[0] == (200, sum(x.shape[1] for x in series.values()))  # all columns advance in one call
    data = spark.createDataFrame(rows, "video int, m long, z array<double>").repartition(5)
    for size in (4096, 64):
        got = FL.bandpass(data, 25.0, 1.0, 3.0, size=size).orderBy("video", "m").toPandas()
        for v, part in got.groupby("video"):
            x = series[v]
            if len(x) > pad:
                y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
                for _ in range(2):
                    y = FL._filter(sos, y.copy(), rest * y[0])[0][::-1]
                x = y[pad:-pad]
            assert part["m"].tolist() == list(range(len(x))) and np.allclose(np.stack(part["z"].to_numpy()), x, atol=1e-8)
        assert set(got["video"]) == set(series)
