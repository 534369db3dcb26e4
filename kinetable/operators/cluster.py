"""Clusterings, mixtures and probes on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.functions.scalar import seeded_uniform
from kinetable.functions.special import binomial_upper_tail
from kinetable.operators.latent import agreement
from kinetable.operators.linear import covariance
from kinetable.session import cut_lineage


def _features(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec)))


def kmeans_labels(df: DataFrame, k: int, vec: str = "mu", n_init: int = 10, seed: int = 0) -> DataFrame:
    """Add ``cluster``: the best of ``n_init`` seeded runs by training cost."""
    d = _features(df, vec)
    fits = [KMeans(k=k, seed=seed + i, maxIter=100).fit(d) for i in range(n_init)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(d).withColumnRenamed("prediction", "cluster").drop("features")


def run_agreement(runs: DataFrame, a: int, b: int) -> DataFrame:
    """agreement of two runs of a long (run, clip_id, cluster) table."""
    x = runs.where(F.col("run") == a).select("clip_id", F.col("cluster").alias("a"))
    y = runs.where(F.col("run") == b).select("clip_id", F.col("cluster").alias("b"))
    return agreement(x.join(y, "clip_id"), "a", "b")


def k_robustness(df: DataFrame, k: int, vec: str = "mu", n_init: int = 3, seed: int = 0) -> DataFrame:
    """k, ari of the K clustering against K - 1 and K + 1."""
    runs = None
    for q in (k - 1, k, k + 1):
        r = kmeans_labels(df, q, vec, n_init, seed).select("clip_id", "cluster", F.lit(q).alias("run"))
        runs = r if runs is None else runs.unionByName(r)
    runs = cut_lineage(runs)
    out = [run_agreement(runs, k, q).select(F.lit(q).alias("k"), "ari") for q in (k - 1, k + 1)]
    return out[0].unionByName(out[1])


def cluster_stability(df: DataFrame, k: int, vec: str = "mu", n_runs: int = 3, share: float = 0.8, seed: int = 0) -> DataFrame:
    """kind (reseed / subsample), run_a, run_b, ari over reseeded runs and seeded subsamples."""
    runs = None
    for i in range(n_runs):
        for kind, rows in (("reseed", df), ("subsample", df.where(seeded_uniform(seed + i, "clip_id") < share))):
            r = kmeans_labels(rows, k, vec, 1, seed + i).select("clip_id", "cluster", F.lit(i).alias("run"), F.lit(kind).alias("kind"))
            runs = r if runs is None else runs.unionByName(r)
    runs = cut_lineage(runs)
    out = None
    for kind in ("reseed", "subsample"):
        for a in range(n_runs):
            for b in range(a + 1, n_runs):
                g = run_agreement(runs.where(F.col("kind") == kind), a, b).select(F.lit(kind).alias("kind"), F.lit(a).alias("run_a"), F.lit(b).alias("run_b"), "ari")
                out = g if out is None else out.unionByName(g)
    return out


def gmm_bic(df: DataFrame, ks: Sequence[int], vec: str = "mu", seed: int = 0) -> DataFrame:
    """k, loglik, bic, best, modal (best K is at least 3) of full-covariance mixtures."""
    points = cut_lineage(df.select(vec))  # every K reads the same rows
    d = _features(points, vec)
    n, dim = d.count(), len(points.select(vec).first()[0])
    rows = []
    for k in ks:
        if k == 1:  # one Gaussian in closed form, without a ridge, as the mixtures have none
            ll = -0.5 * n * (dim * math.log(2 * math.pi) + float(np.linalg.slogdet(covariance(points, vec, ddof=0)[1])[1]) + dim)
        else:
            ll = float(GaussianMixture(k=k, seed=seed, maxIter=50).fit(d).summary.logLikelihood)
        rows.append((k, ll, -2 * ll + (k * dim + k * dim * (dim + 1) // 2 + k - 1) * math.log(n)))
    best = min(rows, key=lambda r: r[2])[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best, best >= 3) for r in rows], "k int, loglik double, bic double, best boolean, modal boolean")


def _gap(centres: np.ndarray):
    """Squared distance to the nearest of a few centres."""

    @F.pandas_udf("double")
    def gap(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        return pd.Series(np.min([((x - c) ** 2).sum(1) for c in centres], axis=0))

    return gap


def farthest_start(points: DataFrame, k: int, ident: str = "clip_id", vec: str = "mu", seed: int = 0) -> DataFrame:
    """step, ident, distance, mean: a seeded first point, then always the point farthest from those chosen so far.

    Each step is one pass: the distance to the nearest chosen point (at most ``k`` vectors are sent), then the maximum; ties
    go to the smallest id.  The first point has no distance.
    """
    spark = points.sparkSession
    first = points.select(ident, vec).orderBy(seeded_uniform(seed, ident), ident).first()
    if first is None:
        raise ValueError("no points")
    chosen = [(0, first[0], None, list(first[1]))]

    for step in range(1, k):
        far = points.select(F.col(ident).alias("id"), F.col(vec).alias("v"), _gap(np.array([c[3] for c in chosen], float))(vec).alias("d2"))
        r = far.agg(F.max_by(F.struct("id", "v", "d2"), F.struct("d2", (-F.col("id")).alias("o"))).alias("r")).first()["r"]
        chosen.append((step, r["id"], math.sqrt(r["d2"]), list(r["v"])))
    return spark.createDataFrame(chosen, f"step int, {ident} long, distance double, mean array<double>")


def mixture_start(start: DataFrame) -> DataFrame:
    """component, weight, mean, var of a mixture with equal weights and unit variances at the chosen points."""
    n = F.lit(float(start.count()))
    return start.select(F.col("step").alias("component"), (1.0 / n).alias("weight"), "mean", F.transform("mean", lambda v: F.lit(1.0)).alias("var"))


def diag_gmm_em(lat: DataFrame, init: DataFrame, n_iter: int = 10, floor: float = 1e-3) -> DataFrame:
    """component, weight, mean, var after EM whose M-step adds the posterior variance; an empty component does not move.

    Each pass is one map over clips and one sum per component; K x d parameters are held at the driver.
    """
    got = init.orderBy("component").collect()  # one row a component
    names = [r["component"] for r in got]
    w, m, v = (np.array([r[c] for r in got], float) for c in ("weight", "mean", "var"))

    def moments(batches, par):
        w, m, v = par
        total = 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            x, s2 = np.stack(pdf["mu"].to_numpy()).astype(float), np.exp(np.stack(pdf["logvar"].to_numpy()).astype(float))
            lp = np.stack([math.log(max(w[j], 1e-300)) - 0.5 * ((x - m[j]) ** 2 / v[j] + np.log(v[j]) + math.log(2 * math.pi)).sum(1) for j in range(len(w))], 1)
            g = np.exp(lp - np.logaddexp.reduce(lp, axis=1)[:, None])
            total = total + np.concatenate([g.sum(0)[:, None], g.T @ x, g.T @ (x * x + s2)], axis=1)
        if np.ndim(total):
            yield pd.DataFrame({"i": np.arange(len(total)), "s": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "s": [np.sum(np.stack(pdf["s"].to_numpy()), axis=0)]})

    rows, d = lat.select("mu", "logvar"), m.shape[1]
    for _ in range(n_iter):
        parts = rows.mapInPandas(lambda b, par=(w, m, v): moments(b, par), "i int, s array<double>")
        sums = parts.groupBy("i").applyInPandas(add, "i int, s array<double>").orderBy("i").collect()
        s = np.array([r["s"] for r in sums])
        nk, moved = s[:, :1], s[:, :1] > 1e-6
        mean = s[:, 1:d + 1] / np.maximum(nk, 1e-8)
        var = np.maximum(s[:, d + 1:] / np.maximum(nk, 1e-8) - mean * mean, floor)
        w, m, v = (nk / nk.sum())[:, 0], np.where(moved, mean, m), np.where(moved, var, v)
    out = [(n, float(a), b.tolist(), c.tolist()) for n, a, b, c in zip(names, w, m, v)]
    kind = init.schema["component"].dataType.simpleString()
    return lat.sparkSession.createDataFrame(out, f"component {kind}, weight double, mean array<double>, var array<double>")


def _standardised(train: DataFrame, test: DataFrame):
    sc = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(train)
    return sc.transform(train), sc.transform(test)


def balanced_accuracy(pred: DataFrame, label: str = "y", guess: str = "prediction") -> DataFrame:
    """accuracy, balanced accuracy (mean recall over classes), number of classes and rows."""
    c = pred.groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col(label) == F.col(guess)).alias("hit"))
    return c.agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"), F.count("*").alias("n_classes"), F.sum("n").alias("n"))


def grouped_probe(df: DataFrame, label: str, fold: str = "fold", vec: str = "mu", task: str = "class") -> DataFrame:
    """Out-of-fold probe: balanced accuracy of a logistic model, or R2 of a ridge model for ordinal labels.

    A training fold with one class predicts it.  ``fold`` comes from kfold_groups.
    """
    d = _features(df.where(F.col(label).isNotNull()), vec)
    if task == "class":
        d = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(d).transform(d)
    else:
        d = d.withColumn("y", F.col(label).cast("double"))
    d = cut_lineage(d.select("features", "y", fold))
    out = None
    for f in [r[0] for r in d.select(fold).distinct().orderBy(fold).collect()]:
        tr, te = _standardised(d.where(F.col(fold) != f), d.where(F.col(fold) == f))
        only = [r[0] for r in tr.select("y").distinct().limit(2).collect()]
        if task == "class" and len(only) == 1:
            p = te.withColumn("prediction", F.lit(only[0]))
        elif task == "class":
            p = LogisticRegression(featuresCol="scaled", labelCol="y", maxIter=100, regParam=0.01).fit(tr).transform(te)
        else:
            p = LinearRegression(featuresCol="scaled", labelCol="y", regParam=0.01, solver="normal").fit(tr).transform(te)
        p = p.select("y", "prediction")
        out = p if out is None else out.unionByName(p)
    if task == "class":
        return balanced_accuracy(out)
    return out.agg((1.0 - F.sum((F.col("y") - F.col("prediction")) ** 2) / (F.var_pop("y") * F.count("*"))).alias("r2"), F.count("*").alias("n"))


def mlp_probe(df: DataFrame, label: str, role: str = "role", vec: str = "mu", hidden: Sequence[int] = (128, 64), seed: int = 0, max_iter: int = 60) -> DataFrame:
    """accuracy, balanced accuracy and chance (1 / classes) of a small network on the validation rows."""
    d = _features(df.where(F.col(label).isNotNull()), vec)
    ix = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(d)
    d = ix.transform(d)
    tr, te = _standardised(d.where(F.col(role) == "train"), d.where(F.col(role) == "val"))
    size = len(df.select(vec).first()[0])
    m = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="y", layers=[size, *hidden, len(ix.labels)], seed=seed, maxIter=max_iter)
    return balanced_accuracy(m.fit(tr).transform(te)).withColumn("chance", F.lit(1.0 / len(ix.labels)))


def disentanglement_score(gap_a, gap_b):
    """sqrt(a b), NULL if either is negative."""
    return F.when((gap_a >= 0) & (gap_b >= 0), F.sqrt(gap_a * gap_b))


def classifier_two_sample(a: DataFrame, b: DataFrame, ident: str = "clip_id", vec: str = "mu", seed: int = 0) -> DataFrame:
    """accuracy, auc and one-sided binomial p of telling two sets apart after a seeded half split."""
    d = a.select(ident, vec).withColumn("y", F.lit(1.0)).unionByName(b.select(ident, vec).withColumn("y", F.lit(0.0)))
    d = _features(d, vec).withColumn("_u", seeded_uniform(seed, "y", ident))
    tr, te = _standardised(d.where("_u < 0.5"), d.where("_u >= 0.5"))
    p = LogisticRegression(featuresCol="scaled", labelCol="y", maxIter=200, regParam=0.01).fit(tr).transform(te)
    auc = BinaryClassificationEvaluator(labelCol="y").evaluate(p)
    hit, n = p.agg(F.count_if(F.col("y") == F.col("prediction")), F.count("*")).first()
    return a.sparkSession.createDataFrame([(hit / n, float(auc), binomial_upper_tail(hit, n), n)], "accuracy double, auc double, p_value double, n long")


def dci(df: DataFrame, factors: Sequence[str], vec: str = "mu", n_trees: int = 100, depth: int = 3, order: str = "pos", total: str = "n", share: float = 0.2, seed: int = 0) -> DataFrame:
    """disentanglement, completeness and held-out RMSE from boosted-tree importances (last share of rows by position held out)."""
    d = cut_lineage(_features(df, vec).withColumn("_test", F.col(order) >= F.col(total) - F.floor(F.col(total) * share)))
    imp, rmse = [], []
    for f in factors:
        t = d.withColumn("y", F.col(f).cast("double"))
        m = GBTRegressor(featuresCol="features", labelCol="y", maxIter=n_trees, maxDepth=depth, stepSize=0.1, seed=seed).fit(t.where(~F.col("_test")))
        imp.append(m.featureImportances.toArray())
        e = m.transform(t.where("_test")).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
        rmse.append(float(e))
    r = np.array(imp).T + 1e-12
    ent = lambda p, base: -(p * np.log(p)).sum(-1) / math.log(base)
    rows, cols = r / r.sum(1, keepdims=True), (r / r.sum(0, keepdims=True)).T
    dis = float(((1 - ent(rows, r.shape[1])) * r.sum(1) / r.sum()).sum())
    return df.sparkSession.createDataFrame([(dis, float((1 - ent(cols, r.shape[0])).mean()), float(np.mean(rmse)))], "disentanglement double, completeness double, rmse double")


def typicality(df: DataFrame, k: int, vec: str = "mu", seed: int = 0) -> DataFrame:
    """clip_id, log_density under a full-covariance mixture of k components fitted to the rows."""
    g = GaussianMixture(k=k, seed=seed, maxIter=50).fit(_features(df, vec))
    par = [(float(w), x.mean.toArray(), x.cov.toArray() + 1e-5 * np.eye(len(x.mean))) for w, x in zip(g.weights, g.gaussians)]
    b = df.sparkSession.sparkContext.broadcast(par)

    @F.pandas_udf("double")
    def dens(v: pd.Series) -> pd.Series:
        x, out = np.stack(v.to_numpy()).astype(float), []
        for w, m, c in b.value:
            low = np.linalg.cholesky(c)
            y = np.linalg.solve(low, (x - m).T)
            out.append(math.log(max(w, 1e-300)) - 0.5 * ((y * y).sum(0) + len(m) * math.log(2 * math.pi)) - np.log(np.diag(low)).sum())
        return pd.Series(np.logaddexp.reduce(np.array(out), axis=0))

    return df.select("clip_id", dens(vec).alias("log_density"))
