"""One clustering per level of a label, all levels in the same jobs.

Rows are packed once into blocks of one level.  A pass sends every candidate model of every level (K, run) to the blocks,
each partition returns one sum per candidate, and the new parameters follow from those sums.  So the number of jobs
depends on the number of rounds, not on the number of levels, and a large level is spread over many blocks.
Parameters of all levels are held at the driver: levels x candidates x K (d + d^2) numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.session import cut_lineage

Member = Callable[[tuple, np.ndarray], np.ndarray]
_ROUND = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _drawn(ids: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each id under a seed."""
    x = ids.astype("u8") + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    for shift, factor in zip((30, 27), _ROUND):
        x = (x ^ (x >> np.uint64(shift))) * factor
    return x ^ (x >> np.uint64(31))


def block_arrays(row) -> tuple[np.ndarray, np.ndarray]:
    """Ids and points of a block; the points of one coordinate lie side by side."""
    ids = np.frombuffer(row.ids, "<i8")
    return ids, np.frombuffer(row.data, "<f8").reshape(-1, len(ids)).T


class Levels:
    """Blocks (level, ids, data) of the levels with at least ``least`` rows, and their sizes."""

    def __init__(self, points: DataFrame, level: str, ident: str, vec: str, least: int, block: int):
        p = points.where(F.col(level).isNotNull()).select(F.col(level).cast("long").alias("level"), F.col(ident).cast("long").alias("id"), F.col(vec).alias("v"))
        self.sizes = {r["level"]: r["n"] for r in p.groupBy("level").agg(F.count("*").alias("n")).collect()}  # one row a level
        self.kept = sorted(k for k, n in self.sizes.items() if n >= least)
        sizes = {k: -(-n // block) for k, n in self.sizes.items()}
        parts = F.create_map(*[x for k in self.kept for x in (F.lit(k), F.lit(sizes[k]))]) if self.kept else None

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", kind="stable")
            return pd.DataFrame({"level": pdf["level"].iloc[:1], "ids": [pdf["id"].to_numpy().astype("<i8").tobytes()], "data": [np.stack(pdf["v"].to_numpy()).astype("<f8").T.tobytes()]})

        if self.kept:
            p = p.where(F.col("level").isin(self.kept)).withColumn("part", F.pmod(F.xxhash64("id"), F.element_at(parts, F.col("level"))))
            self.blocks = cut_lineage(p.groupBy("level", "part").applyInPandas(pack, "level long, ids binary, data binary"))

    def sums(self, models: dict[tuple, object], statistic: Callable[[object, np.ndarray, np.ndarray], np.ndarray]) -> dict[tuple, np.ndarray]:
        """``statistic(model, ids, rows)`` of every model (level, ...) summed over its level, in one job."""
        keys = list(models)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    ids, x = block_arrays(r)
                    for i, key in enumerate(keys):
                        if key[0] == r.level:
                            s = statistic(models[key], ids, x)
                            total[i] = total[i] + s if i in total else s
            if total:
                yield pd.DataFrame({"key": list(total), "s": [np.ravel(s) for s in total.values()]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"key": pdf["key"].iloc[:1], "s": [np.sum(np.stack(pdf["s"].to_numpy()), axis=0)]})

        parts = self.blocks.mapInPandas(partial, "key int, s array<double>").groupBy("key").applyInPandas(add, "key int, s array<double>")
        return {keys[r["key"]]: np.array(r["s"]) for r in parts.collect()}

    def starts(self, wanted: Sequence[tuple], member: Member | None = None) -> dict[tuple, np.ndarray]:
        """For each (level, k, seed, ...) the k rows with the smallest hash under the seed, of those the run holds."""

        def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, list] = {}
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    ids, x = block_arrays(r)
                    for i, key in enumerate(wanted):
                        if key[0] == r.level:
                            k, h = key[1], _drawn(ids, key[2])
                            near = np.arange(len(ids)) if member is None else np.flatnonzero(member(key, ids))
                            if len(near) > k:
                                near = near[h[near] <= np.partition(h[near], k - 1)[k - 1]]
                            near = near[np.argsort(h[near], kind="stable")][:k]
                            best[i] = sorted([*best.get(i, []), *((int(h[j]), int(ids[j]), x[j].tolist()) for j in near)])[:k]
            rows = [(i, str(h).zfill(20), ident, v) for i, b in best.items() for h, ident, v in b]
            yield pd.DataFrame(rows, columns=["key", "h", "id", "v"])

        def keep(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf.sort_values(["h", "id"]).head(wanted[int(pdf["key"].iloc[0])][1])

        schema = "key int, h string, id long, v array<double>"
        got = self.blocks.mapInPandas(least, schema).groupBy("key").applyInPandas(keep, schema).orderBy("key", "h", "id").collect()
        out = {}
        for i, key in enumerate(wanted):
            c = np.array([r["v"] for r in got if r["key"] == i])
            out[key] = c[np.arange(key[1]) % len(c)]
        return out


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, one centre and coordinate after the other: no array of rows x centres x coordinates."""
    out = np.zeros((len(c), len(x)))
    for row, centre in zip(out, c):
        for v, at in zip(x.T, centre):
            t = v - at
            t *= t
            row += t
    return out.T


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of equally near ones, and its squared distance."""
    squares = _squares(x, c).T
    least, near = squares[0], np.zeros(len(x), "i8")
    for j in range(1, len(c)):
        near[squares[j] < least] = j
        least = np.minimum(least, squares[j])
    return near, least


def keyed_kmeans(levels: Levels, wanted: Sequence[tuple], rounds: int = 100, member: Member | None = None) -> dict[tuple, tuple[np.ndarray, float]]:
    """(centres, cost) for each (level, k, seed, ...); a round is one job for all that still move.  An empty centre stays.

    ``member(key, ids)`` may restrict a run to some rows.
    """
    centres = levels.starts(wanted, member)
    d = centres[wanted[0]].shape[1]
    cost = dict.fromkeys(wanted, math.inf)
    live = list(wanted)

    def statistic(model: tuple, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        key, c = model
        x = x if member is None else x[member(key, ids)]
        near, least = _nearest(x, c)
        sums = [np.bincount(near, minlength=len(c)), *(np.bincount(near, v, len(c)) for v in x.T)]
        return np.append(np.column_stack(sums).ravel(), least.sum())

    for _ in range(rounds):
        found = levels.sums({k: (k, centres[k]) for k in live}, statistic)
        still = []
        for key, s in found.items():
            n, total = s[:-1].reshape(key[1], d + 1)[:, :1], s[:-1].reshape(key[1], d + 1)[:, 1:]
            new = np.where(n > 0, total / np.maximum(n, 1), centres[key])
            cost[key] = float(s[-1])
            if not np.allclose(new, centres[key], rtol=0, atol=1e-12):
                still.append(key)
                centres[key] = new
        live = still
        if not live:
            break
    return {k: (centres[k], cost[k]) for k in wanted}


def _log_parts(model: tuple, x: np.ndarray) -> np.ndarray:
    w, mean, cov = model
    out = np.empty((len(w), len(x)))
    for j in range(len(w)):
        low = np.linalg.cholesky(cov[j])
        y = x.T - mean[j][:, None]
        if len(y) > 8:
            y = np.linalg.solve(low, y)
        else:
            for i in range(len(y)):
                for before in range(i):
                    y[i] -= low[i, before] * y[before]
                y[i] /= low[i, i]
        y *= y
        out[j] = math.log(max(w[j], 1e-300)) - 0.5 * (y.sum(0) + len(y) * math.log(2 * math.pi)) - np.log(np.diag(low)).sum()
    return out.T


def keyed_mixtures(levels: Levels, starts: dict[tuple, np.ndarray], ridge: float = 1e-5, tol: float = 1e-3, rounds: int = 100, member: Member | None = None) -> dict[tuple, tuple[tuple, float]]:
    """((weights, means, covariances), log-likelihood) for each (level, k, seed): full covariances, started from hard clusters.

    A mixture stops when its likelihood a row gains less than ``tol``; the parameters returned are those that were scored.
    """
    d = next(iter(starts.values())).shape[1]

    def moments(g: np.ndarray, x: np.ndarray, ll: float) -> np.ndarray:
        return np.concatenate([g.sum(0), (g.T @ x).ravel(), *(((x.T * own) @ x).ravel() for own in g.T), [ll]])

    def held(key: tuple, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x if member is None else x[member(key, ids)]

    def hard(model: tuple, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        c, x = model[1], held(model[0], ids, x)
        return moments(np.eye(len(c))[_nearest(x, c)[0]], x, 0.0)

    def soft(model: tuple, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = held(model[0], ids, x)
        parts = _log_parts(model[1], x).T
        top = parts.max(0)
        g = np.exp(parts - top)
        whole = g.sum(0)
        g /= whole
        return np.append(moments(g.T, x, (top + np.log(whole)).sum()), len(x))

    def step(key: tuple, s: np.ndarray) -> tuple:
        k = key[1]
        n = np.maximum(s[:k], 10 * np.finfo(float).eps)
        mean = s[k : k + k * d].reshape(k, d) / n[:, None]
        cov = s[k + k * d : -1].reshape(k, d, d) / n[:, None, None] - np.einsum("ki,kj->kij", mean, mean)
        return n / n.sum(), mean, (cov + cov.transpose(0, 2, 1)) / 2 + ridge * np.eye(d)

    now = {key: step(key, s) for key, s in levels.sums({k: (k, c) for k, c in starts.items()}, hard).items()}
    done: dict[tuple, tuple[tuple, float]] = {}
    before = dict.fromkeys(now, -math.inf)
    for turn in range(rounds):
        live = {k: (k, m) for k, m in now.items() if k not in done}
        if not live:
            break
        for key, s in levels.sums(live, soft).items():
            ll, n, s = float(s[-2]), s[-1], s[:-1]
            if ll - before[key] < tol * n or turn == rounds - 1:
                done[key] = (now[key], ll)
            else:
                now[key], before[key] = step(key, s), ll
    return done


def rand_index(table: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table."""
    pairs = lambda v: float((v * (v - 1) / 2).sum())
    both, rows, cols, n = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), table.sum()
    chance = rows * cols / (n * (n - 1) / 2) if n > 1 else 0.0
    most = (rows + cols) / 2
    return 1.0 if most == chance else float((both - chance) / (most - chance))


def within_group_repeat(
    points: DataFrame, level: str, ident: str = "clip_id", vec: str = "mu", runs: int = 20, least: int = 40, most_k: int = 6, stable: float = 0.5, ridge: float = 1e-5, seed: int = 0, block: int = 4096
) -> tuple[DataFrame, DataFrame]:
    """The clustering repeated inside every level of a label: (summary, labels).

    summary: level, n, skipped (fewer than ``least`` rows), k_bic (best of 1 to ``most_k`` full mixtures), k (2 at least), ari_kmeans
    (mean over pairs of ``runs`` reseeded k-means runs at k), n_stable (k_bic where that exceeds ``stable``, else 1).
    labels: level, id column, cluster of the mixture at k, c0 and c1 (first two principal coordinates in the level).
    """
    spark = points.sparkSession
    levels = Levels(points, level, ident, vec, least, block)
    summary_schema = "level long, n long, skipped boolean, k_bic int, k int, ari_kmeans double, n_stable int"
    skipped = [(k, n, True, None, None, None, None) for k, n in levels.sizes.items() if k not in levels.kept]
    if not levels.kept:
        empty = points.select(F.col(level).cast("long").alias("level"), ident, F.lit(0).alias("cluster"), F.lit(0.0).alias("c0"), F.lit(0.0).alias("c1")).where("false")
        return spark.createDataFrame(skipped, summary_schema), empty
    first = keyed_kmeans(levels, [(v, k, seed) for v in levels.kept for k in range(1, most_k + 1)])
    mixtures = keyed_mixtures(levels, {key: c for key, (c, _) in first.items()}, ridge)
    d = next(iter(first.values()))[0].shape[1]
    cost = lambda key: -2 * mixtures[key][1] + (key[1] * (d + d * (d + 1) // 2 + 1) - 1) * math.log(levels.sizes[key[0]])
    k_bic = {v: min(range(1, most_k + 1), key=lambda k: cost((v, k, seed))) for v in levels.kept}
    chosen = {v: max(2, k) for v, k in k_bic.items()}

    reseeded = keyed_kmeans(levels, [(v, chosen[v], seed + 1 + r) for v in levels.kept for r in range(runs)])
    by_level = {(v,): [reseeded[v, chosen[v], seed + 1 + r][0] for r in range(runs)] for v in levels.kept}
    pairs = [(a, b) for a in range(runs) for b in range(a + 1, runs)]

    def contingency(centres: list[np.ndarray], ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        k = len(centres[0])
        labels = [_nearest(x, c)[0] for c in centres]
        return np.concatenate([np.bincount(labels[a] * k + labels[b], minlength=k * k) for a, b in pairs]).astype(float)

    tables = levels.sums(by_level, contingency)
    ari = {v: float(np.mean([rand_index(t.reshape(chosen[v], chosen[v])) for t in np.split(tables[v,], len(pairs))])) for v in levels.kept}
    rows = [(v, levels.sizes[v], False, k_bic[v], chosen[v], ari[v], k_bic[v] if k_bic[v] >= 2 and ari[v] > stable else 1) for v in levels.kept]

    final = {v: mixtures[v, chosen[v], seed][0] for v in levels.kept}
    axes = {}
    for v in levels.kept:
        _, mean, cov = mixtures[v, 1, seed][0]
        vectors = np.linalg.eigh(cov[0])[1][:, ::-1][:, :2]
        axes[v] = mean[0], vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, x = block_arrays(r)
                mean, vectors = axes[r.level]
                c = (x - mean) @ vectors
                yield pd.DataFrame({"level": r.level, "id": ids, "cluster": _log_parts(final[r.level], x).argmax(1), "c0": c[:, 0], "c1": c[:, 1] if c.shape[1] > 1 else 0.0})

    labels = levels.blocks.mapInPandas(label, "level long, id long, cluster int, c0 double, c1 double")
    return spark.createDataFrame(rows + skipped, summary_schema), labels.withColumnRenamed("id", ident)
