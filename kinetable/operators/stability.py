"""How stable a clustering is: reseeded, subsampled and bootstrapped runs, two methods, and how often points go together.

All runs of a method are fitted together (see ``keyed``): a run is a seed and a rule that says which rows it holds, both from
hashes of the row ids, so rows are never copied per run.  Agreement comes from contingency tables summed over
blocks, in one job for all pairs of runs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.functions.scalar import seeded_uniform
from kinetable.operators.keyed import Levels, _drawn, _log_parts, _squares, keyed_kmeans, keyed_mixtures, rand_index

BITS = 12


def _smallest(levels: Levels, wanted: dict[int, int]) -> dict[int, int]:
    """For each seed the hash that exactly the wanted number of rows does not exceed; bins of the hash are refined until they are single values."""
    low, left = dict.fromkeys(wanted, 0), dict(wanted)
    shift = 64
    while shift > 0:
        width = min(BITS, shift)
        shift -= width

        def counts(model: tuple, ids: np.ndarray, x: np.ndarray, shift=shift, width=width) -> np.ndarray:
            seed, start = model
            h = _drawn(ids, seed)
            top = shift + width
            own = np.ones(len(h), bool) if top == 64 else (h >> np.uint64(top)) == np.uint64(start >> top)
            return np.bincount(((h[own] >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype("i8"), minlength=1 << width)

        for (_, seed), n in levels.sums({(0, s): (s, low[s]) for s in wanted}, counts).items():
            upto = np.cumsum(n)
            i = int(np.searchsorted(upto, left[seed]))
            left[seed] -= int(upto[i - 1]) if i else 0
            low[seed] |= i << shift
    return low


def stability_battery(
    points: DataFrame, k: int, ident: str = "clip_id", vec: str = "mu", runs: int = 20, n_subsample: int = 10, share: float = 0.8, n_bootstrap: int = 10, consensus: int = 400, seed: int = 0, block: int = 4096
) -> tuple[DataFrame, DataFrame]:
    """(scores, labels) of k-means and full mixtures with ``k`` clusters.

    scores: kind, method, run_a, run_b, ari.  reseed: every pair of ``runs`` reseeded runs.  subsample: each of ``n_subsample`` runs on
    a ``share`` of the rows (exactly, k + 1 at least) against the clustering of all rows, on the rows it holds.  bootstrap: the
    same on the distinct rows of a resample, each row being drawn at least once with probability 1 - 1/e.  cross: k-means
    against mixture.
    labels: run, id, cluster of at most ``consensus`` seeded points in the reseeded k-means runs (see co_assignment).
    """
    spark = points.sparkSession
    level = next(f"_level{i}" for i in range(len(points.columns) + 1) if f"_level{i}" not in points.columns)
    levels = Levels(points.withColumn(level, F.lit(0)), level, ident, vec, k + 1, block)
    if not levels.kept:
        raise ValueError(f"fewer than {k + 1} rows")
    n = levels.sizes[0]
    wanted = {seed + 1000 + r: min(n, max(k + 1, round(n * share))) for r in range(n_subsample)}
    edge = _smallest(levels, wanted) if wanted else {}
    drawn = np.uint64(min(2**64 - 1, int((1 - math.exp(-1)) * 2**64)))

    def member(key: tuple, ids: np.ndarray) -> np.ndarray:
        kind, r = key[3:]
        if kind == "subsample":
            return _drawn(ids, seed + 1000 + r) <= np.uint64(edge[seed + 1000 + r])
        return _drawn(ids, seed + 2000 + r) < drawn if kind == "bootstrap" else np.ones(len(ids), bool)

    keys = [(0, k, seed, "full", 0), *((0, k, seed + 1 + r, "reseed", r) for r in range(runs))]
    keys += [(0, k, seed, kind, r) for kind, m in (("subsample", n_subsample), ("bootstrap", n_bootstrap)) for r in range(m)]
    means = {key: c for key, (c, _) in keyed_kmeans(levels, keys, member=member).items()}
    mixtures = {key: m for key, (m, _) in keyed_mixtures(levels, means, member=member).items()}

    full = keys[0]
    again = [key for key in keys if key[3] == "reseed"]
    pairs = [("reseed", method, a, b) for method in ("kmeans", "gmm") for i, a in enumerate(again) for b in again[i + 1 :]]
    pairs += [(key[3], method, full, key) for method in ("kmeans", "gmm") for key in keys if key[3] in ("subsample", "bootstrap")]

    def tables(models: tuple, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        centres, mixed = models
        label = {("kmeans", key): _squares(x, c).argmin(1) for key, c in centres.items()} | {("gmm", key): _log_parts(m, x).argmax(1) for key, m in mixed.items()}
        count = lambda a, b, own: np.bincount(a[own] * k + b[own], minlength=k * k)
        out = [count(label[method, a], label[method, b], member(b, ids)) for _, method, a, b in pairs]
        return np.concatenate([*out, count(label["kmeans", full], label["gmm", full], np.ones(len(ids), bool))]).astype(float)

    found = np.split(levels.sums({(0,): (means, mixtures)}, tables)[0,], len(pairs) + 1)
    rows = [(kind, method, a[4] if kind == "reseed" else -1, b[4], rand_index(t.reshape(k, k))) for (kind, method, a, b), t in zip(pairs, found)]
    rows.append(("cross", "kmeans_vs_gmm", -1, -1, rand_index(found[-1].reshape(k, k))))
    scores = spark.createDataFrame(rows, "kind string, method string, run_a int, run_b int, ari double")

    some = points.select(F.col(ident).cast("long").alias("id"), F.col(vec).alias("v")).orderBy(seeded_uniform(seed + 101, "id"), "id").limit(consensus).collect()
    x = np.array([r["v"] for r in some], float)
    labels = [(key[4], r["id"], int(c)) for key in again for r, c in zip(some, _squares(x, means[key]).argmin(1))]
    return scores, spark.createDataFrame(labels, f"run int, {ident} long, cluster int")


def co_assignment(labels: DataFrame, ident: str = "clip_id") -> DataFrame:
    """a, b, share: in what share of the runs (run, id, cluster) two points go together, a < b; the points are few by contract."""
    n = labels.groupBy(ident).agg(F.count_distinct("run").alias("runs"))
    one, two = labels.select("run", "cluster", F.col(ident).alias("a")), labels.select("run", "cluster", F.col(ident).alias("b"))
    met = one.join(two, ["run", "cluster"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    ids = labels.select(ident).distinct()
    every = ids.select(F.col(ident).alias("a")).join(ids.select(F.col(ident).alias("b")), F.col("a") < F.col("b"))
    every = every.join(n.withColumnRenamed(ident, "a"), "a").join(met, ["a", "b"], "left")
    return every.select("a", "b", (F.coalesce("c", F.lit(0)) / F.col("runs")).alias("share"))
