"""Queries that fit and decode state models."""

from pyspark.sql import functions as F

from kinetable.catalog.registry import register
from kinetable.operators import hmm as H
from kinetable.operators.splits import kfold_groups
from kinetable.sources.tables import event_code, state_paths, table
from kinetable.plans.chunks import ordered_index


def windows(spark, d, recordings=None):
    """video, m, z, code: two numbers and a symbol per event in time order; a recording is a user, or one of ``recordings`` groups of users."""
    video = F.col("user_id") if recordings is None else F.col("user_id") % recordings
    e = table(spark, d, "events").select(
        video.alias("video"), "ts", "event_id", F.array(F.log1p("value"), F.get_json_object("props", "$.k").cast("double") / 50.0).alias("z"), event_code().cast("double").alias("code")
    )
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long")
    return ordered_index(e, ["video"], day, ["ts", "event_id"], "m").select("video", "m", "z", "code")


@register("gaussian_hmm", ints="state", doubles="pi mean0 mean1", digits=4)
def _(spark, d):
    s = H.sequence_chunks(windows(spark, d))
    m = H.fit(s, [H.Model(3, seed=r) for r in range(2)], n_iter=8)
    return H.parameters(spark, max(m, key=lambda x: x.loglik)).select("state", "pi", F.col("mean")[0].alias("mean0"), F.col("mean")[1].alias("mean1"))


@register("gaussian_hmm_cv", ints="k", doubles="score", digits=4)
def _(spark, d):
    w = windows(spark, d)
    folds = kfold_groups(w.select("video").distinct(), "video", 3)
    _, score = H.select(H.sequence_chunks(w, folds=folds), [2, 3], folds=3, n_iter=5)
    return spark.createDataFrame(score)


@register("gaussian_hmm_bic", ints="k", doubles="loglik bic aic", digits=3)
def _(spark, d):
    _, score = H.select(H.sequence_chunks(windows(spark, d)), [2, 3], criterion="bic", covariance="diag", n_iter=5)
    return spark.createDataFrame(score)


@register("ar_hmm", ints="state", doubles="pi", digits=4)
def _(spark, d):
    m = H.fit(H.sequence_chunks(windows(spark, d), lags=1), [H.Model(2, "ar", lags=1)], n_iter=6)
    return H.parameters(spark, m[0])


@register("categorical_hmm", ints="k", doubles="loglik bic", digits=3)
def _(spark, d):
    w = windows(spark, d).withColumn("code", F.array("code"))
    _, score = H.select(H.sequence_chunks(w, "code"), [2, 3], criterion="bic", kind="categorical", n_symbols=5, n_iter=5)
    return spark.createDataFrame(score)


@register("viterbi_decode", ints="video m state")
def _(spark, d):
    s = H.sequence_chunks(windows(spark, d))
    return H.decode(s, H.fit(s, [H.Model(3)], n_iter=5)[0])


@register("sequence_loglik", ints="video n", doubles="loglik", digits=4)
def _(spark, d):
    s = H.sequence_chunks(windows(spark, d))
    return H.sequence_loglik(s, H.fit(s, [H.Model(2)], n_iter=4)[0])


@register("align_and_average_refits", ints="state", doubles="pi", digits=4)
def _(spark, d):
    s = H.sequence_chunks(windows(spark, d), lags=1)
    return H.parameters(spark, H.align(H.fit(s, [H.Model(2, "ar", lags=1, seed=r) for r in range(3)], n_iter=4)))


@register("gaussian_hmm_guarded", texts="covariance verdict", ints="k attempt", doubles="floor loglik condition least_rows", digits=2)
def _(spark, d):
    return H.attempts(spark, H.fit_guarded(H.sequence_chunks(windows(spark, d)), [2, 3, 4], restarts=2))


@register("gaussian_hmm_loo", ints="k", doubles="score", digits=4)
def _(spark, d):
    w = windows(spark, d, 8)
    _, score = H.select(H.sequence_chunks(w, folds=H.leave_one_out(w)), [2, 3], criterion="loo")
    return spark.createDataFrame(score)
