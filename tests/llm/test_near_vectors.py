"""p-stable hashing against all cosines: loose and tight clusters, copies, awkward vectors, recall at the threshold."""

import numpy as np
from pyspark.sql import functions as F

from kinetable.llm.near_vectors import near_vectors, pairs_within, plan_tables, same_cell

SCHEMA = "vec_id long, embedding array<double>, label int, node string, ball string, v string, c string"


def truth(rows, least=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in ok}
    unit = {i: u / np.linalg.norm(u) for i, u in unit.items()}
    links, root = np.zeros(len(rows), int), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[[a, b]] += 1
                root[top(a)] = top(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    least_id = {k: min((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    return sorted(((rows[i][0], int(links[i]), least_id[top(i)]) for i in range(len(rows))), key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0, "x", "y", "z", "w") for i, v in rows], SCHEMA).repartition(4)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(df, **more).collect()), key=str)


def test_clusters_of_every_width_equal_all_cosines(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for spread, size in ((0.0, 30), (0.01, 200), (0.03, 120), (0.04, 150), (0.06, 60), (0.5, 200)):  # near 0.04 balls only partly link
        centre = rng.standard_normal(24)
        for _ in range(size):
            rows.append((n, (centre + spread * 4.9 * rng.standard_normal(24)).tolist()))
            n += 1
    assert got(spark, rows, recall=1 - 1e-9, block=32) == truth(rows)


def test_awkward_vectors(spark):
    rows = [
        (0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]),
        (7, [2.0, 4.0]), (None, [1.0, 2.0]), (8, [1e-200, 2e-200]), (9, [1e200, 2e200]), (10, [1.0, 2.0, 0.0]), (11, [-1.0, -2.0]), (None, [0.0, 0.0, 1.0]), (12, [5.0]), (13, [3.0]),
    ]
    assert got(spark, rows) == truth(rows)
    kept = near_vectors(spark.createDataFrame([(i, v, 0, "", "", "", "") for i, v in rows], SCHEMA)).where("kept")
    assert sorted(r["vec_id"] for r in kept.collect() if r["vec_id"] is not None) == [0, 1, 2, 3, 4, 5, 6, 10, 11, 12]


def test_empty_table(spark):
    assert got(spark, []) == []


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):  # pairs whose cosine lies in 0.950 to 0.951
        a = rng.standard_normal(32)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(32)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.95 + 0.001 * rng.random()
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    linked = sum(n for _, n, _ in got(spark, rows)) / 600
    assert linked >= 0.96


def test_plan_grows_with_the_logarithm():
    assert same_cell(0.3, 2.0) > 0.86 and same_cell(1.414, 2.0) < 0.5
    small, large = plan_tables(1000, 0.95, 0.99, 2.0, 16), plan_tables(10**9, 0.95, 0.99, 2.0, 16)
    assert small[0] < large[0] < 30 and large[1] < 200


def test_pairs_within_groups_in_slices():
    bounds = np.array([0, 1, 4, 4 + 60])
    seen = sorted((int(a), int(b)) for i, j in pairs_within(bounds, 100) for a, b in zip(i, j))
    assert seen == [(a, b) for lo, hi in zip(bounds, bounds[1:]) for a in range(lo, hi) for b in range(a + 1, hi)]
