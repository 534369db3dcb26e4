"""The two nearest neighbours and the intrinsic-dimension estimates built on them.

The search is the ring tiles of ``density``: a tile is sent once a group of tiles that may have to meet it, distances are
screened by squared norms, and only the pairs that can count are taken from differences.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.operators.density import nearest_k
from kinetable.plans.chunks import prefix_sum
from kinetable.plans.draws import resample_weights
from kinetable.plans.ranks import value_range

TILE = 512
PIVOTS = 64


def nearest_two(points: DataFrame, ident: str = "clip_id", vec: str = "mu", tile: int = TILE, pivots: int = PIVOTS, seed: int = 0) -> DataFrame:
    """ident, r1, r2: distances to the first and second nearest other point (duplicates count, at distance 0)."""
    near = nearest_k(points, 2, ident, vec, tile, pivots, seed)
    return near.select(ident, F.col("distances")[0].alias("r1"), F.col("distances")[1].alias("r2"))


def neighbour_ratios(near: DataFrame, ident: str = "clip_id") -> DataFrame:
    """ident, mu = r2 / r1; points with a duplicate (r1 = 0) are dropped."""
    return near.where("r1 > 0").select(ident, (F.col("r2") / F.col("r1")).alias("mu"))


def count_duplicates(near: DataFrame) -> DataFrame:
    return near.agg(F.count_if(F.col("r1") <= 0).alias("n_duplicates"), F.count("*").alias("n"))


def _ranked(ratios: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted position i (1-based), total n and ln mu for each ratio, spread over value ranges."""
    keys = list(keys)
    r = value_range(ratios.where("mu IS NOT NULL"), keys, "mu")
    w = F.col("weight") if "weight" in ratios.columns else F.lit(1)
    r = prefix_sum(r, keys, "", {"i": w}, bucket=F.col("_range"), order=["mu", *[c for c in ("clip_id",) if c in ratios.columns]]).drop("_range")
    n = r.groupBy(*keys).agg(F.sum(w).alias("n"))
    return r.join(n, keys).withColumn("x", F.ln("mu"))


def twonn_mle(ratios: DataFrame, discard: float = 0.1) -> DataFrame:
    """d_hat = M / sum(ln mu) after dropping the top share (biased high by the trim), standard error d / sqrt(M), M."""
    r = _ranked(ratios.withColumn("_g", F.lit(0)), ["_g"])
    kept = r.where(F.col("i") <= F.floor(F.col("n") * (1.0 - discard)))
    g = kept.agg(F.count("*").alias("n_used"), F.sum("x").alias("s"))
    return g.select("n_used", (F.col("n_used") / F.col("s")).alias("d_hat"), (F.sqrt("n_used") / F.col("s")).alias("standard_error"))


def twonn_least_squares(ratios: DataFrame, discard: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    """Slope through the origin of -ln(1 - F) on ln mu over the kept share: d_hat, se, r2 (uncentred), n_used, d_mle (untrimmed)."""
    overall = not keys
    keys = ["_g"] if overall else list(keys)
    r = _ranked(ratios.withColumn("_g", F.lit(0)) if overall else ratios, keys)
    w = F.col("weight") if "weight" in ratios.columns else F.lit(1)
    y = -F.log1p(-(F.col("i") / F.col("n")))
    keep = F.greatest(F.lit(2), F.least(F.floor(F.col("n") * (1.0 - discard)), F.col("n")))
    ok = (F.col("i") <= keep) & (F.col("i") < F.col("n"))
    r = r.withColumn("y", F.when(ok, y)).withColumn("xk", F.when(ok, F.col("x")))
    g = r.groupBy(*keys).agg(
        F.sum(F.col("xk") * F.col("xk") * w).alias("sxx"), F.sum(F.col("xk") * F.col("y") * w).alias("sxy"), F.sum(F.col("y") * F.col("y") * w).alias("syy"),
        F.sum(F.when(ok, w).otherwise(0)).alias("n_used"), (F.max("n") / F.sum(F.col("x") * w)).alias("d_mle"),
    )
    slope = F.col("sxy") / F.col("sxx")
    rss = F.col("syy") - F.col("sxy") * slope
    out = g.select(*keys, "n_used", slope.alias("d_hat"), F.sqrt(F.greatest(rss, F.lit(0.0)) / F.greatest(F.col("n_used") - 1, F.lit(1)) / F.col("sxx")).alias("standard_error"),
                   (1.0 - rss / F.col("syy")).alias("r2"), "d_mle")
    return out.drop("_g") if overall else out


def twonn_bootstrap(ratios: DataFrame, reps: int = 100, discard: float = 0.1, seed: int = 0) -> DataFrame:
    """Standard deviation of the least-squares estimate over resampled ratios."""
    b = resample_weights(ratios.withColumn("_g", F.lit(0)), ["_g"], ["clip_id"], reps, seed).select("rep", "clip_id", "mu", "weight")
    return twonn_least_squares(b, discard, ["rep"]).agg(F.stddev_samp("d_hat").alias("bootstrap_se"), F.count("*").alias("reps"))
