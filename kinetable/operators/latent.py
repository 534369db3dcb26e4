"""Measures over latent tables ``clip_id, video, start_frame, mu, logvar``."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetable.functions.scalar import log_sum_exp
from kinetable.plans.chunks import prefix_sum
from kinetable.plans.draws import seeded_order


def long_latents(lat: DataFrame, keep: Sequence[str] = ("clip_id",)) -> DataFrame:
    """One row per (clip, dim): mu and logvar."""
    z = lat.select(*keep, F.posexplode(F.arrays_zip("mu", "logvar")).alias("dim", "z"))
    return z.select(*keep, "dim", F.col("z.mu").alias("mu"), F.col("z.logvar").alias("logvar"))


def kl_term(mu: Column, logvar: Column) -> Column:
    return 0.5 * (mu * mu + F.exp(logvar) - logvar - 1.0)


def kl_per_dim(lat: DataFrame, floor: float | None = None) -> DataFrame:
    """dim, kl (mean), mu_rms, mean_var, active (kl > 0.01); ``floor`` adds the free-bits value max(floor, kl)."""
    g = long_latents(lat).groupBy("dim").agg(
        F.avg(kl_term(F.col("mu"), F.col("logvar"))).alias("kl"), F.sqrt(F.avg(F.col("mu") * F.col("mu"))).alias("mu_rms"),
        F.avg(F.exp("logvar")).alias("mean_var"),
    )
    g = g.withColumn("active", F.col("kl") > 0.01)
    return g if floor is None else g.withColumn("kl_floored", F.greatest(F.col("kl"), F.lit(float(floor))))


def kl_totals(per_dim: DataFrame) -> DataFrame:
    return per_dim.agg(F.sum("kl").alias("total_kl"), F.count_if("active").alias("n_active"), F.count("*").alias("n_dims"))


def kl_by_window(lat: DataFrame, width: int) -> DataFrame:
    """Fold flat dims into (window, dim of window) and sum the mean KL of each."""
    k = kl_per_dim(lat).select((F.floor(F.col("dim") / width)).alias("window"), (F.col("dim") % width).alias("inner"), "kl")
    return k.groupBy("window").agg(F.sum("kl").alias("kl"))


def kl_per_clip(lat: DataFrame) -> DataFrame:
    """KL of each clip, kept inside its row."""
    terms = F.zip_with("mu", "logvar", kl_term)
    return lat.select("clip_id", F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("kl"))


def active_units(lat: DataFrame, threshold: float = 0.01) -> DataFrame:
    g = long_latents(lat).groupBy("dim").agg(F.var_pop("mu").alias("variance"))
    return g.withColumn("active", F.col("variance") > threshold)


def precision_spectrum(lat: DataFrame, threshold: float = 2.0) -> DataFrame:
    """rank, dim, precision: mean 1 / variance per dim, largest first.  One row per dim."""
    g = long_latents(lat).groupBy("dim").agg(F.avg(F.exp(-F.col("logvar"))).alias("precision"))
    order = W.partitionBy(F.lit(0)).orderBy(F.col("precision").desc(), "dim")
    return g.withColumn("rank", F.row_number().over(order)).withColumn("above", F.col("precision") > threshold)


def map_mismatch(read: DataFrame, write: DataFrame) -> DataFrame:
    """latent, joint, mismatch: |r / max r - w / max w| of two (latent, joint, value) maps."""
    every = W.partitionBy(F.lit(0))  # d x J rows
    j = read.withColumnRenamed("value", "r").join(write.withColumnRenamed("value", "w"), ["latent", "joint"])
    return j.select("latent", "joint", F.abs(F.col("r") / F.max("r").over(every) - F.col("w") / F.max("w").over(every)).alias("mismatch"))


def equal_width_bins(df: DataFrame, keys: Sequence[str], value: str, bins: int, name: str) -> DataFrame:
    """Bin index over each key's own range, right edge inclusive; a constant variable falls into bin 0."""
    lim = df.groupBy(*keys).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    pos = (F.col(value) - F.col("_mn")) / (F.col("_mx") - F.col("_mn")) * bins
    b = F.when(F.col("_mx") > F.col("_mn"), F.least(F.floor(pos), F.lit(bins - 1))).otherwise(0)
    return df.join(lim, list(keys)).withColumn(name, b).drop("_mn", "_mx")


def latent_factor_rows(lat: DataFrame, factors: DataFrame) -> DataFrame:
    """clip_id, dim, mu, factor, value: each latent coordinate beside each factor of the clip."""
    z = lat.select("clip_id", F.posexplode("mu").alias("dim", "mu"))
    return z.join(factors, "clip_id")


def mutual_information(rows: DataFrame, bins: int = 20) -> DataFrame:
    """dim, factor, mi, h_factor from a bins x bins histogram (natural logs)."""
    b = equal_width_bins(rows, ["dim"], "mu", bins, "_bi")
    b = equal_width_bins(b, ["factor"], "value", bins, "_bj")
    cells = b.groupBy("dim", "factor", "_bi", "_bj").agg(F.count("*").alias("n"))
    pair = W.partitionBy("dim", "factor")  # at most bins x bins rows
    n = F.sum("n").over(pair)
    c = cells.withColumns({
        "p": F.col("n") / n, "pi": F.sum("n").over(W.partitionBy("dim", "factor", "_bi")) / n,
        "nj": F.sum("n").over(W.partitionBy("dim", "factor", "_bj")), "pj": F.sum("n").over(W.partitionBy("dim", "factor", "_bj")) / n,
    })
    return c.groupBy("dim", "factor").agg(
        F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pi") * F.col("pj")))).alias("mi"),
        F.sum(-F.col("p") * F.ln("pj")).alias("h_factor"),
    )


def mig(mi: DataFrame) -> DataFrame:
    """factor, gap: (largest - second largest MI) / factor entropy; averaged with :func:`mean_gap`."""
    top = mi.groupBy("factor").agg(F.slice(F.sort_array(F.collect_list("mi"), asc=False), 1, 2).alias("t"), F.max("h_factor").alias("h"))
    return top.select("factor", F.when(F.col("h") > 0, (F.col("t")[0] - F.col("t")[1]) / F.col("h")).otherwise(0.0).alias("gap"))


def mean_gap(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.avg("gap").alias("score"))


def sap(rows: DataFrame, order: DataFrame, test_share: float = 0.2) -> DataFrame:
    """factor, gap: difference of the two best single-dim held-out R2; the last share of rows by position is held out.

    ``order`` is clip_id, pos, n.  Two passes of sums give slope, intercept and R2.
    """
    cut = F.col("n") - F.floor(F.col("n") * test_share)
    r = rows.join(order, "clip_id").withColumn("_test", F.col("pos") >= cut)
    fit = r.where(~F.col("_test")).groupBy("dim", "factor").agg(F.regr_slope("value", "mu").alias("s"), F.regr_intercept("value", "mu").alias("i"))
    t = r.where("_test").join(fit, ["dim", "factor"])
    e = F.col("value") - (F.col("s") * F.col("mu") + F.col("i"))
    sc = t.groupBy("dim", "factor").agg((1.0 - F.sum(e * e) / (F.var_pop("value") * F.count("*"))).alias("r2"))
    top = sc.groupBy("factor").agg(F.slice(F.sort_array(F.collect_list(F.greatest("r2", F.lit(0.0))), asc=False), 1, 2).alias("t"))
    return top.select("factor", (F.col("t")[0] - F.col("t")[1]).alias("gap"))


def row_positions(lat: DataFrame, pos: str, size: int = 4096) -> DataFrame:
    """clip_id, pos, n in the order of an integer position column."""
    p = prefix_sum(lat.select("clip_id", pos).withColumn("_g", F.lit(0)), ["_g"], pos, {"_i": F.lit(1)}, size)
    n = lat.agg(F.count("*").alias("n")).withColumn("_g", F.lit(0))
    return p.join(F.broadcast(n), "_g").select("clip_id", (F.col("_i") - 1).alias("pos"), "n")


def shuffle_within(factors: DataFrame, states: DataFrame, seed: int = 0) -> DataFrame:
    """Factor values permuted among the clips of one state: clip_id, factor, value."""
    f = factors.join(states, "clip_id")
    a = seeded_order(f, ["factor", "state"], ["clip_id"], seed, "_i")
    b = seeded_order(f, ["factor", "state"], ["clip_id"], seed + 1, "_i").select("factor", "state", "_i", F.col("value").alias("_v"))
    return a.join(b, ["factor", "state", "_i"]).select("clip_id", "factor", F.col("_v").alias("value"))


def selectivity(lat: DataFrame, factors: DataFrame, states: DataFrame, score, seed: int = 0) -> DataFrame:
    """score, shuffled_score, selectivity; ``score(rows) -> one-row DataFrame(score)`` over latent_factor_rows."""
    real = score(latent_factor_rows(lat, factors)).withColumn("_k", F.lit(1))
    null = score(latent_factor_rows(lat, shuffle_within(factors, states, seed))).withColumnRenamed("score", "shuffled_score").withColumn("_k", F.lit(1))
    return real.join(F.broadcast(null), "_k").drop("_k").withColumn("selectivity", F.col("score") - F.col("shuffled_score"))


def rate_distortion(points: DataFrame) -> DataFrame:
    """model, rate, bits, distortion, knee: ordered by rate; the knee is the largest |second difference|.  One row per model."""
    w = W.partitionBy(F.lit(0)).orderBy("rate", "model")
    second = F.lead("distortion").over(w) - 2 * F.col("distortion") + F.lag("distortion").over(w)
    p = points.withColumns({"bits": F.col("rate") / math.log(2.0), "_c": F.abs(second), "_i": F.row_number().over(w)})
    first = F.max(F.struct("_c", (-F.col("_i")).alias("i"))).over(W.partitionBy(F.lit(0)))
    known = F.col("_c").isNotNull() & (F.col("_c") == first["_c"]) & (F.col("_i") == -first["i"])
    return p.withColumn("knee", F.coalesce(known, F.lit(False))).drop("_c", "_i")


def component_scores(lat: DataFrame, components: DataFrame) -> DataFrame:
    """clip_id, mu, logvar and ``logp``: array over components of ln w + ln N(mu; mean, diag var).

    ``components`` is component, weight, mean, var; a mixture has few of them,
    so they travel as one broadcast row.
    """
    packed = components.agg(F.array_sort(F.collect_list(F.struct("component", "weight", "mean", "var"))).alias("_comp")).withColumn("_k", F.lit(1))
    j = lat.withColumn("_k", F.lit(1)).join(F.broadcast(packed), "_k").drop("_k")

    def one(c):
        terms = F.zip_with(F.zip_with("mu", c["mean"], lambda x, m: (x - m) * (x - m)), c["var"], lambda d, v: d / v + F.ln(v))
        return F.ln(c["weight"]) - 0.5 * (F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) + F.size("mu") * math.log(2 * math.pi))

    return j.withColumn("logp", F.transform("_comp", one))


def responsibilities(lat: DataFrame, components: DataFrame) -> DataFrame:
    """clip_id, gamma (array over components), entropy of the assignment, KL of gamma against the weights."""
    s = component_scores(lat, components).withColumn("_z", log_sum_exp(F.col("logp")))
    g = s.withColumn("gamma", F.transform("logp", lambda x: F.exp(x - F.col("_z"))))
    ent = F.aggregate(F.transform("gamma", lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    kl = F.aggregate(
        F.zip_with("gamma", "_comp", lambda p, c: F.when(p > 0, p * (F.ln(p) - F.ln(c["weight"]))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x
    )
    return g.select("clip_id", "gamma", ent.alias("assignment_entropy"), kl.alias("kl_y"))


def kl_to_components(lat: DataFrame, components: DataFrame) -> DataFrame:
    """clip_id, kl_z: sum over components of gamma * KL(q(z|x) || N(mean, var))."""
    s = component_scores(lat, components).withColumn("_z", log_sum_exp(F.col("logp")))

    def kl(c):
        pairs = F.zip_with(F.zip_with("mu", c["mean"], lambda x, m: (x - m) * (x - m)), F.col("logvar"), lambda d, lv: F.struct(d.alias("d"), lv.alias("lv")))
        terms = F.zip_with(pairs, c["var"], lambda e, v: F.ln(v) - e["lv"] + (F.exp(e["lv"]) + e["d"]) / v - 1.0)
        return 0.5 * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    total = F.aggregate(F.zip_with("logp", "_comp", lambda p, c: F.exp(p - F.col("_z")) * kl(c)), F.lit(0.0), lambda a, x: a + x)
    return s.select("clip_id", total.alias("kl_z"))


def mean_responsibility(resp: DataFrame) -> DataFrame:
    """component, occupancy."""
    return resp.select(F.posexplode("gamma").alias("component", "g")).groupBy("component").agg(F.avg("g").alias("occupancy"))


def quantize_residual(lat: DataFrame, codebooks: DataFrame, layers: int) -> DataFrame:
    """clip_id, codes (one per layer), quantized, residual_norm; nearest code by squared distance, ties to the smaller code.

    ``codebooks`` is layer, code, vec; the model's books travel as one broadcast row.
    """
    book = codebooks.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("code", "vec"))).alias("b"))
    packed = book.agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", "b"))), lambda e: e["b"]).alias("_books")).withColumn("_k", F.lit(1))
    d = lat.withColumn("_k", F.lit(1)).join(F.broadcast(packed), "_k").select(
        "clip_id", "_books", F.col("mu").alias("_r"), F.transform("mu", lambda x: F.lit(0.0)).alias("quantized"), F.array().cast("array<int>").alias("codes")
    )
    for layer in range(layers):
        def near(e):
            dist = F.aggregate(F.zip_with("_r", e["vec"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
            return F.struct(dist.alias("d"), e["code"].cast("int").alias("code"), e["vec"].alias("vec"))

        d = d.withColumn("_best", F.array_min(F.transform(F.col("_books")[layer], near)))
        d = d.select(
            "clip_id", "_books", F.zip_with("_r", "_best.vec", lambda x, y: x - y).alias("_r"),
            F.zip_with("quantized", "_best.vec", lambda x, y: x + y).alias("quantized"),
            F.concat("codes", F.array(F.col("_best.code"))).alias("codes"),
        )
    nrm = F.sqrt(F.aggregate("_r", F.lit(0.0), lambda s, x: s + x * x))
    return d.select("clip_id", "codes", "quantized", nrm.alias("residual_norm"))


def agreement(df: DataFrame, a: str, b: str, noise: int | None = -1) -> DataFrame:
    """One row: n, ari, nmi (arithmetic mean), ami.  Rows with a missing label or noise are left out.

    Only the contingency table leaves the rows; ami's expectation runs over its marginals.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if noise is not None:
        d = d.where((F.col(a) != noise) & (F.col(b) != noise))
    cells = d.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    every = W.partitionBy(F.lit(0))  # classes x clusters rows
    c = cells.withColumns({
        "na": F.sum("n").over(W.partitionBy("a")), "nb": F.sum("n").over(W.partitionBy("b")), "t": F.sum("n").over(every),
    })
    comb = lambda x: x * (x - 1) / 2.0
    n, na, nb, t = F.col("n"), F.col("na"), F.col("nb"), F.col("t")
    s = c.agg(
        F.max("t").alias("n"), F.sum(comb(n)).alias("sij"), F.sum(comb(na) * n / na).alias("sa"), F.sum(comb(nb) * n / nb).alias("sb"),
        F.sum(n / t * F.ln(n * t / (na * nb))).alias("mi"), F.sum(-n / t * F.ln(na / t)).alias("ha"), F.sum(-n / t * F.ln(nb / t)).alias("hb"),
        F.array_sort(F.collect_set(F.struct("a", "na"))).alias("_ma"), F.array_sort(F.collect_set(F.struct("b", "nb"))).alias("_mb"),
    )
    expect = F.col("sa") * F.col("sb") / comb(F.col("n"))
    half = (F.col("sa") + F.col("sb")) / 2.0
    mean_h = (F.col("ha") + F.col("hb")) / 2.0
    emi = expected_mi(F.transform("_ma", lambda e: e["na"]), F.transform("_mb", lambda e: e["nb"]), F.col("n"))
    s = s.withColumn("_emi", emi)
    return s.select(
        "n", F.when(half == expect, 1.0).otherwise((F.col("sij") - expect) / (half - expect)).alias("ari"),
        F.when(mean_h == 0, 1.0).otherwise(F.col("mi") / mean_h).alias("nmi"),
        F.when(mean_h == F.col("_emi"), 1.0).otherwise((F.col("mi") - F.col("_emi")) / (mean_h - F.col("_emi"))).alias("ami"),
    )


def expected_mi(rows: Column, cols: Column, n: Column) -> Column:
    """Expected MI of two random labelings with the given class sizes (hypergeometric sum)."""
    @F.pandas_udf("double")
    def emi(ra: pd.Series, cb: pd.Series, total: pd.Series) -> pd.Series:
        def one(a, b, t):
            t = int(t)
            lg = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, t + 1)))])
            out = 0.0
            for x in map(int, a):
                for y in map(int, b):
                    k = np.arange(max(1, x + y - t), min(x, y) + 1)
                    w = lg[x] + lg[y] + lg[t - x] + lg[t - y] - lg[t] - lg[k] - lg[x - k] - lg[y - k] - lg[t - x - y + k]
                    out += float((k / t * np.log(t * k / (x * y)) * np.exp(w)).sum())
            return out

        return pd.Series([one(*r) for r in zip(ra, cb, total)], dtype=float)

    return emi(rows, cols, n)


def composition_matrix(df: DataFrame, subject: str, cluster: str, k: int, noise: int = -1) -> DataFrame:
    """subject, cluster, share over k clusters; noise is left out and a subject with nothing left has a zero row."""
    wide = df.groupBy(subject).agg(
        F.count_if(F.col(cluster) != noise).alias("_n"), *[F.count_if(F.col(cluster) == c).alias(f"_c{c}") for c in range(k)]
    )
    long = wide.select(subject, "_n", F.posexplode(F.array(*[F.col(f"_c{c}") for c in range(k)])).alias("cluster", "n"))
    return long.select(subject, "cluster", F.when(F.col("_n") > 0, F.col("n") / F.col("_n")).otherwise(0.0).alias("share"))


def dominant_clusters(comp: DataFrame, subject: str) -> DataFrame:
    """subject, dominant, max_share (ties to the smaller cluster)."""
    top = comp.groupBy(subject).agg(F.max(F.struct("share", (-F.col("cluster")).alias("c"))).alias("_t"))
    return top.select(subject, (-F.col("_t.c")).alias("dominant"), F.col("_t.share").alias("max_share"))


def concentrated_share(dominant: DataFrame, cut: float = 0.8) -> DataFrame:
    return dominant.agg(F.avg(F.when(F.col("max_share") > cut, 1.0).otherwise(0.0)).alias("concentrated"))
