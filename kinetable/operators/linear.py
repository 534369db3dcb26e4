"""Linear maps over latents.  Spark sums moments; d x d algebra runs on the sums."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.operators.kernels import numbered, shuffled
from kinetable.operators.neighbours import nearest_two, neighbour_ratios, twonn_mle
from kinetable.plans.chunks import shift
from kinetable.plans.quantiles import exact_quantiles


def gram(df: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sum and sum of outer products of a vector column; one row per partition leaves the tasks."""

    def run(batches):
        n, s, q = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                n += len(x)
                s = x.sum(0) if s is None else s + x.sum(0)
                q = x.T @ x if q is None else q + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [list(s)], "q": [list(q.ravel())]})

    part = df.select(F.col(vec).alias("v")).mapInPandas(run, "n long, s array<double>, q array<double>")
    long = part.select(F.lit("n").alias("k"), F.lit(0).alias("i"), F.col("n").cast("double").alias("x")).unionByName(
        part.select(F.lit("s").alias("k"), F.posexplode("s").alias("i", "x"))
    ).unionByName(part.select(F.lit("q").alias("k"), F.posexplode("q").alias("i", "x")))
    got = long.groupBy("k", "i").agg(F.sum("x").alias("x")).toPandas().sort_values(["k", "i"])
    take = lambda k: got.loc[got.k == k, "x"].to_numpy()
    s = take("s")
    return int(take("n")[0]), s, take("q").reshape(len(s), len(s))


def covariance(df: DataFrame, vec: str, ddof: int = 1) -> tuple[np.ndarray, np.ndarray]:
    n, s, q = gram(df, vec)
    m = s / n
    return m, (q - n * np.outer(m, m)) / (n - ddof)


def apply_map(df: DataFrame, vec: str, name: str, matrix: np.ndarray, offset: np.ndarray | None = None) -> DataFrame:
    """Add ``name`` = (vec - offset) @ matrix.T, in Arrow batches."""
    b = df.sparkSession.sparkContext.broadcast((np.asarray(matrix, float), offset))

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        a, o = b.value
        x = np.stack(v.to_numpy()).astype(float)
        return pd.Series(list((x if o is None else x - o) @ a.T))

    return df.withColumn(name, project(vec))


def _root(m: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh((m + m.T) / 2)
    return (v * np.sqrt(np.maximum(w, 0.0))) @ v.T


def frechet_distance(a: DataFrame, b: DataFrame, vec: str = "mu") -> DataFrame:
    """|m1 - m2|^2 + tr(C1 + C2 - 2 (C1 C2)^(1/2)) between Gaussian fits of two sets."""
    (m1, c1), (m2, c2) = covariance(a, vec), covariance(b, vec)
    r = _root(c1)
    d = float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2.0 * np.trace(_root(r @ c2 @ r)))
    return a.sparkSession.createDataFrame([(max(d, 0.0),)], "frechet double")


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns turned so that the largest entry is positive."""
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def pca_project(df: DataFrame, n: int, vec: str = "mu") -> tuple[DataFrame, np.ndarray]:
    """Adds ``coords`` (zero-padded to n) on the leading axes of the centred data; returns the variance shares too."""
    m, c = covariance(df, vec)
    w, v = np.linalg.eigh(c)
    v = _signed(v[:, ::-1][:, :n])
    share = np.maximum(w[::-1], 0.0) / max(np.maximum(w, 0.0).sum(), 1e-300)
    basis = np.zeros((n, len(m)))
    basis[: v.shape[1]] = v.T
    return apply_map(df, vec, "coords", basis, m), np.pad(share[:n], (0, max(0, n - len(share))))


def robust_scale(df: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Median and interquartile range per coordinate (1 where the range is 0)."""
    long = df.select(F.posexplode(vec).alias("dim", "v"))
    q = exact_quantiles(long, ["dim"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).orderBy("dim").toPandas()
    iqr = (q["q3"] - q["q1"]).to_numpy()
    return q["q2"].to_numpy(), np.where(iqr > 0, iqr, 1.0)


def permuted_top_values(df: DataFrame, vec: str, draws: int, seed: int = 0, block: int = 4096) -> np.ndarray:
    """The largest singular value of the rows after an independent permutation of every column, for each draw.

    Rows are numbered; a column's value at row i moves to a place that a seeded permutation of 0..n-1 computes from i alone.
    Values meet again in blocks of places, each block gives d x d sums, and nothing but those sums is kept.
    """
    rows = numbered(df.select(F.col(vec).alias("v")))
    n = rows.count()

    def move(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            i, x = pdf["i"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype("<f8")
            for draw in range(draws):
                place = np.stack([shuffled(i, n, draw * x.shape[1] + c, seed) for c in range(x.shape[1])], 1)
                lane, column = place // block, np.broadcast_to(np.arange(x.shape[1]), x.shape)
                order = np.argsort(lane, axis=None, kind="stable")
                lanes = lane.ravel()[order]
                cuts = np.flatnonzero(np.diff(lanes, prepend=-1))
                parts = [np.split(a.ravel()[order], cuts[1:]) for a in (place - lane * block, column, x)]
                yield pd.DataFrame({
                    "draw": draw, "lane": lanes[cuts], "rows": [p.astype("<i4").tobytes() for p in parts[0]],
                    "columns": [p.astype("<i4").tobytes() for p in parts[1]], "data": [p.astype("<f8").tobytes() for p in parts[2]],
                })

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        at, column, v = (np.concatenate([np.frombuffer(b, k) for b in pdf[c]]) for c, k in (("rows", "<i4"), ("columns", "<i4"), ("data", "<f8")))
        x = np.zeros((at.max() + 1, column.max() + 1))
        x[at, column] = v
        return pd.DataFrame({"draw": pdf["draw"].iloc[:1], "q": [(x.T @ x).ravel()]})

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        q = np.sum(np.stack(pdf["q"].to_numpy()), axis=0)
        d = int(round(len(q) ** 0.5))
        return pd.DataFrame({"draw": pdf["draw"].iloc[:1], "top": [float(np.sqrt(max(np.linalg.eigvalsh(q.reshape(d, d))[-1], 0.0)))]})

    moved = rows.mapInPandas(move, "draw int, lane long, rows binary, columns binary, data binary")
    blocks = moved.groupBy("draw", "lane").applyInPandas(sums, "draw int, q array<double>")
    got = blocks.groupBy("draw").applyInPandas(top, "draw int, top double").toPandas()  # one row a draw
    return got.sort_values("draw")["top"].to_numpy()


def svd_basis(df: DataFrame, vec: str = "mu", var_target: float = 0.9, significance: str | None = None, draws: int = 100, seed: int = 0) -> dict:
    """Axes of the robustly scaled data: centre, scale, vectors, singular values, variance shares, n_components.

    significance ``mp`` or ``perm`` adds the threshold and n_significant, the singular values above it: of Marchenko-Pastur, or the
    largest one of ``draws`` copies whose columns were permuted.
    """
    if significance not in (None, "mp", "perm"):
        raise ValueError(f"unknown significance: {significance}")
    centre, scale = robust_scale(df, vec)
    scaled = apply_map(df, vec, "_s", np.diag(1.0 / scale), centre)
    n, _, q = gram(scaled, "_s")
    w, v = np.linalg.eigh(q)
    w, v = np.maximum(w[::-1], 0.0), _signed(v[:, ::-1])
    share = w / w.sum()
    out = {"centre": centre, "scale": scale, "vectors": v.T, "share": share, "n_components": int(np.searchsorted(np.cumsum(share), var_target) + 1)}
    out["singular"] = np.sqrt(w)
    if significance:
        out["threshold"] = float((1.0 + np.sqrt(len(w) / n)) * np.sqrt(n - 1)) if significance == "mp" else float(permuted_top_values(scaled, "_s", draws, seed).max())
        out["n_significant"] = int((out["singular"] > out["threshold"]).sum())
    return out


def basis_dimension(df: DataFrame, basis: dict, ident: str, vec: str = "mu") -> DataFrame:
    """Two-neighbour dimension of the scaled data."""
    scaled = apply_map(df, vec, "_s", np.diag(1.0 / basis["scale"]), basis["centre"])
    return twonn_mle(neighbour_ratios(nearest_two(scaled, ident, "_s"), ident))


def weights(df: DataFrame, basis: dict, vec: str, n: int | None = None) -> DataFrame:
    """Add ``w``: scores on the first n axes."""
    n = n or basis["n_components"]
    return apply_map(df, vec, "w", basis["vectors"][:n] / basis["scale"][None, :], basis["centre"])


def project_velocity(df: DataFrame, basis: dict, vec: str = "mu", pos: str = "m", n: int | None = None) -> DataFrame:
    """video, pos, z: scores standardised per walk (population sd + 1e-8), differenced, divided by one pooled sd (+ 1e-8)."""
    w = weights(df, basis, vec, n).select("video", pos, "w")
    long = w.select("video", pos, F.posexplode("w").alias("dim", "v"))
    st = long.groupBy("video", "dim").agg(F.avg("v").alias("mn"), (F.stddev_pop("v") + 1e-8).alias("sd"))
    s = long.join(st, ["video", "dim"]).select("video", "dim", pos, ((F.col("v") - F.col("mn")) / F.col("sd")).alias("v"))
    d = shift(s, ["video", "dim"], pos, {"_n": ("v", 1)}).where("_n IS NOT NULL").select("video", "dim", pos, (F.col("_n") - F.col("v")).alias("d"))
    g = d.agg((F.stddev_pop("d") + 1e-8).alias("_g")).withColumn("_k", F.lit(1))
    d = d.withColumn("_k", F.lit(1)).join(F.broadcast(g), "_k")
    packed = F.array_sort(F.collect_list(F.struct("dim", (F.col("d") / F.col("_g")).alias("v"))))
    return d.groupBy("video", pos).agg(F.transform(packed, lambda e: e["v"]).alias("z"))


def static_weights(df: DataFrame, basis: dict, vec: str = "mu", n: int | None = None) -> DataFrame:
    """video, dim, weight: mean score of each walk."""
    w = weights(df, basis, vec, n).select("video", F.posexplode("w").alias("dim", "v"))
    return w.groupBy("video", "dim").agg(F.avg("v").alias("weight"))


def ridge_feature_r2(df: DataFrame, features: Sequence[str], role: Column, vec: str = "mu", alpha: float = 1.0) -> DataFrame:
    """feature, r2: ridge on train-standardised latents; ``role`` is true on held-out rows.  One pass of moments, one of scores."""
    f = list(features)
    both = df.withColumn("_test", role).withColumn("_zy", F.concat(vec, F.array(*[F.col(c).cast("double") for c in f])))
    n, s, q = gram(both.where(~F.col("_test")), "_zy")
    d = len(s) - len(f)
    mean = s / n
    cov = q / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:d], 0.0))
    sd = np.where(sd > 0, sd, 1.0)
    xx, xy = n * cov[:d, :d] / np.outer(sd, sd), n * cov[:d, d:] / sd[:, None]
    coef = np.linalg.solve(xx + alpha * np.eye(d), xy) / sd[:, None]
    p = apply_map(both.where("_test"), vec, "_p", coef.T, mean[:d])
    long = p.select(F.posexplode("_p").alias("i", "p"), "_zy").select("i", (F.col("p") + F.element_at(F.array(*[F.lit(float(m)) for m in mean[d:]]), F.col("i") + 1)).alias("p"), F.element_at("_zy", F.col("i") + d + 1).alias("y"))
    r = long.groupBy("i").agg((1.0 - F.sum((F.col("y") - F.col("p")) ** 2) / (F.var_pop("y") * F.count("*") + 1e-12)).alias("r2"))
    return r.select(F.element_at(F.array(*[F.lit(c) for c in f]), F.col("i") + 1).alias("feature"), "r2")


def held_out_by_time(df: DataFrame, pos: str = "pos", total: str = "n", share: float = 0.2) -> Column:
    """True on the last share of each video: needs the position and the count of the video's rows."""
    return F.col(pos) >= F.floor(F.col(total) * (1.0 - share))


def canonical_correlation(df: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """component, correlation of the leading pairs of linear combinations."""
    both = df.withColumn("_ab", F.concat(a, b))
    d = len(df.select(a).first()[0])
    _, c = covariance(both, "_ab")
    white = lambda m: (lambda w, v: (v / np.sqrt(np.maximum(w, 1e-12))) @ v.T)(*np.linalg.eigh(m))
    r = np.linalg.svd(white(c[:d, :d]) @ c[:d, d:] @ white(c[d:, d:]), compute_uv=False)
    return df.sparkSession.createDataFrame([(i + 1, float(min(x, 1.0))) for i, x in enumerate(r[: min(k, d, len(c) - d)])], "component int, correlation double")


def equivariance_fit(pairs: DataFrame, vec: str = "mu", mirrored: str = "mu_mirror") -> dict:
    """Least squares mu_mirror ~ A mu + b: a, b, variance_explained."""
    both = pairs.withColumn("_xy", F.concat(vec, mirrored, F.array(F.lit(1.0))))
    n, s, q = gram(both, "_xy")
    d = (len(s) - 1) // 2
    x = list(range(d)) + [2 * d]
    xx, xy, yy = q[np.ix_(x, x)], q[np.ix_(x, range(d, 2 * d))], q[d:2 * d, d:2 * d]
    w = np.linalg.pinv(xx) @ xy
    rss = np.trace(yy) - 2 * np.trace(w.T @ xy) + np.trace(w.T @ xx @ w)
    tss = np.trace(yy) - (s[d:2 * d] ** 2).sum() / n + 1e-12
    return {"a": w[:-1].T, "b": w[-1], "variance_explained": float(1.0 - rss / tss)}


def asymmetry_score(df: DataFrame, a: np.ndarray, vec: str = "mu", tol: float = 0.0) -> DataFrame:
    """Adds ``score``: length of the latent inside the eigenspace of A with real part below ``tol``."""
    w, v = np.linalg.eig(a)
    basis = np.real(v[:, np.real(w) < tol])
    q = np.linalg.qr(basis)[0] if basis.shape[1] else np.zeros((len(a), 1))
    out = apply_map(df, vec, "_p", q.T)
    return out.withColumn("score", F.sqrt(F.aggregate("_p", F.lit(0.0), lambda s, x: s + x * x))).drop("_p")


def ou_fit(rows: DataFrame, vec: str = "z", pos: str = "m", stride_seconds: float = 1.0) -> dict:
    """Lag-one map per step, reversion matrix -log(A) / step and the return times 1 / max(rate, 1e-6); pairs never cross recordings."""
    p = shift(rows.select("video", pos, vec), ["video"], pos, {"_n": (vec, 1)}).where("_n IS NOT NULL")
    _, _, q = gram(p.withColumn("_ab", F.concat(vec, "_n")), "_ab")
    d = len(q) // 2
    a = q[d:, :d] @ np.linalg.pinv(q[:d, :d])
    w, v = np.linalg.eig(a.astype(complex))
    theta = -np.real(v @ np.diag(np.log(w)) @ np.linalg.inv(v)) / stride_seconds
    return {"a": a, "reversion": theta, "timescales": np.sort(1.0 / np.clip(np.real(np.linalg.eigvals(theta)), 1e-6, None))}


def score_clips(clips: DataFrame, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], values: str = "x", mask: str = "visible", keep: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Run a frozen encoder over clip rows (flat values and mask arrays) in Arrow batches: keep, mu, logvar."""
    b = clips.sparkSession.sparkContext.broadcast(encode)
    keep = list(keep)
    kinds = {f.name: f.dataType.simpleString() for f in clips.schema.fields}

    def run(batches):
        for pdf in batches:
            if len(pdf):
                mu, lv = b.value(np.stack(pdf[values].to_numpy()).astype(float), np.stack(pdf[mask].to_numpy()).astype(float))
                out = pdf[keep].copy()
                out["mu"], out["logvar"] = list(np.asarray(mu, float)), list(np.asarray(lv, float))
                yield out

    return clips.select(*keep, values, mask).mapInPandas(run, ", ".join([f"{c} {kinds[c]}" for c in keep] + ["mu array<double>", "logvar array<double>"]))


class LinearEncoder:
    """mu = (x * mask) @ weight; constant width.  For tests and as an example of the encoder hook."""

    def __init__(self, weight: np.ndarray, logvar: float = -1.0):
        self.weight, self.logvar = np.asarray(weight, float), logvar

    def __call__(self, x: np.ndarray, mask: np.ndarray):
        mu = (x * mask) @ self.weight
        return mu, np.full_like(mu, self.logvar)


def mask_jitter(encoded: DataFrame) -> DataFrame:
    """One row from (clip_id, draw, mu): mean squared scatter over masks, variance between clips, their ratio."""
    long = encoded.select("clip_id", F.posexplode("mu").alias("dim", "v"))
    clip = long.groupBy("clip_id", "dim").agg(F.var_pop("v").alias("within"), F.avg("v").alias("mean"))
    dim = clip.groupBy("dim").agg(F.avg("within").alias("within"), F.var_pop("mean").alias("between"))
    return dim.agg(F.sum("within").alias("jitter"), F.sum("between").alias("between")).withColumn("ratio", F.col("jitter") / F.col("between"))


def latent_recovery(full: DataFrame, masked: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean distance of masked from full encodings by severity or limb."""
    j = masked.join(full.select("clip_id", F.col("mu").alias("_f")), "clip_id")
    d = F.sqrt(F.aggregate(F.zip_with("mu", "_f", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return j.groupBy(*by).agg(F.avg(d).alias("drift"))
