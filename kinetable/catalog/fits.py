"""Queries on linear maps, clusterings, probes and change points."""

import numpy as np
from pyspark.sql import functions as F

from kinetable.catalog.inference import u01
from kinetable.catalog.latent import COMP, LV, components, factors
from kinetable.catalog.models import windows
from kinetable.catalog.registry import register
from kinetable.operators import cluster as CL
from kinetable.operators import filters as FL
from kinetable.operators import latent as L
from kinetable.operators import linear as LN
from kinetable.operators import segments as SG
from kinetable.operators import windows as WN
from kinetable.operators.splits import kfold_groups, random_row_split
from kinetable.sources.tables import latents, table


@register("frechet_distance", doubles="frechet")
def _(spark, d):
    lat = latents(spark, d)
    return LN.frechet_distance(lat.where("video % 2 = 0"), lat.where("video % 2 = 1"))


@register("pca_project", ints="clip_id", doubles="c0 c1", digits=4)
def _(spark, d):
    p, _ = LN.pca_project(latents(spark, d), 2)
    return p.select("clip_id", F.col("coords")[0].alias("c0"), F.col("coords")[1].alias("c1"))


@register("svd_basis", ints="component", doubles="share")
def _(spark, d):
    b = LN.svd_basis(latents(spark, d))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(b["share"])], "component int, share double")


@register("svd_permutation", ints="component significant", doubles="singular threshold")
def _(spark, d):
    b = LN.svd_basis(windows(spark, d), "z", significance="perm")
    return spark.createDataFrame([(i, int(x > b["threshold"]), float(x), b["threshold"]) for i, x in enumerate(b["singular"])], "component int, significant int, singular double, threshold double")


@register("project_velocity", ints="video m", doubles="z0", digits=4)
def _(spark, d):
    w = windows(spark, d)
    return LN.project_velocity(w, LN.svd_basis(w, "z"), "z").select("video", "m", F.col("z")[0].alias("z0"))


@register("static_weights", ints="video dim", doubles="weight", digits=4)
def _(spark, d):
    w = windows(spark, d)
    return LN.static_weights(w, LN.svd_basis(w, "z"), "z", 2)


@register("ridge_feature_r2", texts="feature", doubles="r2")
def _(spark, d):
    lat = latents(spark, d)
    f = factors(spark, d).groupBy("clip_id").pivot("factor", ["label", "head", "tail"]).agg(F.first("value"))
    rows = lat.join(f, "clip_id").join(L.row_positions(lat, "start_frame"), "clip_id")
    return LN.ridge_feature_r2(rows, ["label", "head", "tail"], LN.held_out_by_time(rows))


def halves(a, b):
    """The first and second half of mu."""
    half = F.expr("size(mu) div 2").cast("int")
    return F.slice("mu", F.lit(1), half).alias(a), F.slice("mu", half + 1, F.size("mu") - half).alias(b)


@register("canonical_correlation", ints="component", doubles="correlation")
def _(spark, d):
    lat = latents(spark, d)
    return LN.canonical_correlation(lat.select(*halves("a", "b")), "a", "b")


@register("equivariance_score", ints="clip_id", doubles="score", digits=4)
def _(spark, d):
    lat = latents(spark, d).select("clip_id", "mu")
    a, b = halves("a", "b")
    pairs = lat.select("*", a, b).withColumn("mu_mirror", F.concat(F.transform("a", lambda x: -x), "b"))
    return LN.asymmetry_score(lat, LN.equivariance_fit(pairs)["a"])


@register("ou_fit", ints="component", doubles="timescale")
def _(spark, d):
    t = LN.ou_fit(windows(spark, d))["timescales"]
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(t)], "component int, timescale double")


@register("mask_jitter", doubles="jitter between ratio")
def _(spark, d):
    from kinetable.functions.scalar import seeded_uniform

    lat = latents(spark, d).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(4))))
    mask = F.transform(F.sequence(F.lit(0), F.size("mu") - 1), lambda i: (seeded_uniform(0, F.col("clip_id"), F.col("draw"), i) > 0.3).cast("double"))
    enc = LN.LinearEncoder(np.cos(np.outer(np.arange(64), np.arange(1, 5))))
    return LN.mask_jitter(LN.score_clips(lat.select("clip_id", "draw", F.col("mu").alias("x"), mask.alias("visible")), enc, keep=["clip_id", "draw"]))


@register("score_clips", ints="clip_id", doubles="mu0", sql="SELECT vec_id AS clip_id, CAST(embedding[1] AS DOUBLE) + 2 * CAST(embedding[2] AS DOUBLE) AS mu0 FROM embeddings")
def _(spark, d):
    w = np.zeros((64, 1))
    w[0, 0], w[1, 0] = 1.0, 2.0
    c = latents(spark, d).select("clip_id", F.col("mu").alias("x"), F.transform("mu", lambda v: F.lit(1.0)).alias("visible"))
    return LN.score_clips(c, LN.LinearEncoder(w)).select("clip_id", F.col("mu")[0].alias("mu0"))


def _em_sql(start: str, turns: int, floor: float = 1e-3) -> str:
    """CTEs it0 (component, dim, w, m, v) to it{turns}: diagonal EM, one set of CTEs a turn."""
    out = [f"it0 AS MATERIALIZED ({start})"]
    for t in range(turns):
        out += [
            f"lp{t} AS MATERIALIZED (SELECT clip_id, component, any_value(ln(w)) - 0.5 * sum(pow(mu - m, 2) / v + ln(v) + ln(2 * pi())) AS lp FROM lv JOIN it{t} USING (dim) GROUP BY 1, 2)",
            f"g{t} AS MATERIALIZED (SELECT clip_id, component, exp(lp - mx) / sum(exp(lp - mx)) OVER (PARTITION BY clip_id) AS g FROM (SELECT *, max(lp) OVER (PARTITION BY clip_id) AS mx FROM lp{t}))",
            f"nk{t} AS MATERIALIZED (SELECT component, sum(g) AS nk, avg(g) AS w FROM g{t} GROUP BY 1)",
            f"it{t + 1} AS MATERIALIZED (SELECT o.component, o.dim, any_value(nk.w) AS w, CASE WHEN any_value(nk) > 1e-6 THEN sum(g * mu) / any_value(nk) ELSE any_value(o.m) END AS m, "
            f"CASE WHEN any_value(nk) > 1e-6 THEN greatest(sum(g * (mu * mu + exp(logvar))) / any_value(nk) - pow(sum(g * mu) / any_value(nk), 2), {floor}) ELSE any_value(o.v) END AS v "
            f"FROM it{t} o JOIN nk{t} nk ON nk.component = o.component JOIN g{t} g ON g.component = o.component JOIN lv ON lv.clip_id = g.clip_id AND lv.dim = o.dim GROUP BY 1, 2)",
        ]
    return ", ".join(out)


def _em_rows(c):
    z = F.arrays_zip(F.col("mean").alias("m"), F.col("var").alias("v"))
    return c.select("component", "weight", F.posexplode(z).alias("dim", "e")).select("component", "dim", "weight", F.col("e.m").alias("mean"), F.col("e.v").alias("var"))


_EM_OUT = " SELECT component, dim, w AS weight, m AS mean, v AS var FROM it10"


@register("diag_gmm_em", ints="component dim", doubles="weight mean var",
          sql=f"WITH {LV}, {COMP}, {_em_sql('SELECT cm.component, dim, w, m, v FROM cm JOIN cw ON cw.component = cm.component', 10)}" + _EM_OUT)
def _(spark, d):
    return _em_rows(CL.diag_gmm_em(latents(spark, d), components(spark, d)))


def _farthest_sql(k: int) -> str:
    """CTEs ch0 to ch{k - 1} (step, clip_id, distance): each the point farthest from those before."""
    out = [f"pts AS (SELECT vec_id AS clip_id, embedding::DOUBLE[] AS e FROM embeddings), ch0 AS MATERIALIZED (SELECT 0 AS step, clip_id, NULL::DOUBLE AS distance, e FROM pts ORDER BY {u01("'0'", 'clip_id')}, clip_id LIMIT 1)"]
    for i in range(1, k):
        before = " UNION ALL ".join(f"SELECT e FROM ch{j}" for j in range(i))
        out.append(f"ch{i} AS MATERIALIZED (SELECT {i} AS step, p.clip_id, min(list_distance(p.e, c.e)) AS distance, any_value(p.e) AS e FROM pts p, ({before}) c GROUP BY p.clip_id ORDER BY distance DESC, clip_id LIMIT 1)")
    return ", ".join(out)


@register("farthest_start", ints="step clip_id", doubles="distance",
          sql=f"WITH {_farthest_sql(6)} " + " UNION ALL ".join(f"SELECT step, clip_id, distance FROM ch{i}" for i in range(6)))
def _(spark, d):
    return CL.farthest_start(latents(spark, d), 6)


_SEEDED = " UNION ALL ".join(f"SELECT step AS component, generate_subscripts(e, 1) - 1 AS dim, 1.0 / 6 AS w, unnest(e) AS m, 1.0 AS v FROM ch{i}" for i in range(6))


@register("diag_gmm_em_farthest", ints="component dim", doubles="weight mean var", digits=5, sql=f"WITH {LV}, {_farthest_sql(6)}, {_em_sql(_SEEDED, 10)}" + _EM_OUT)
def _(spark, d):
    lat = latents(spark, d)
    return _em_rows(CL.diag_gmm_em(lat, CL.mixture_start(CL.farthest_start(lat, 6))))


@register("kmeans_labels", ints="cluster n")
def _(spark, d):
    return CL.kmeans_labels(latents(spark, d), 5, n_init=2).groupBy("cluster").agg(F.count("*").alias("n"))


@register("k_robustness", ints="k", doubles="ari")
def _(spark, d):
    return CL.k_robustness(latents(spark, d), 4, n_init=1)


@register("cluster_stability", texts="kind", ints="run_a run_b", doubles="ari")
def _(spark, d):
    return CL.cluster_stability(latents(spark, d), 3, n_runs=2)


@register("gmm_bic_select", ints="k best modal", doubles="loglik bic", digits=2)
def _(spark, d):
    return CL.gmm_bic(windows(spark, d), [1, 2, 3], "z")


@register("typicality", ints="clip_id", doubles="log_density", digits=3)
def _(spark, d):
    return CL.typicality(latents(spark, d).select("clip_id", "mu"), 2)


@register("grouped_probe", ints="n_classes n", doubles="accuracy balanced_accuracy", digits=3)
def _(spark, d):
    lat = kfold_groups(latents(spark, d).withColumn("grp", F.col("clip_id") % 25), "grp", 3).withColumn("cls", F.col("video") % 2)
    return CL.grouped_probe(lat, "cls")


@register("ordinal_probe", ints="n", doubles="r2", digits=3)
def _(spark, d):
    lat = kfold_groups(latents(spark, d).withColumn("grp", F.col("clip_id") % 25), "grp", 3)
    return CL.grouped_probe(lat, "video", task="ordinal")


@register("mlp_probe", ints="n", doubles="accuracy balanced_accuracy chance", digits=3)
def _(spark, d):
    lat = random_row_split(latents(spark, d), ["clip_id"], 0.3).withColumn("cls", F.col("video") % 2)
    return CL.mlp_probe(lat, "cls", max_iter=15)


@register("classifier_two_sample", ints="n", doubles="accuracy auc p_value", digits=3)
def _(spark, d):
    lat = latents(spark, d)
    return CL.classifier_two_sample(lat.where("video < 5"), lat.where("video >= 5"))


@register("dci", doubles="disentanglement completeness rmse", digits=3)
def _(spark, d):
    lat = latents(spark, d)
    f = factors(spark, d).groupBy("clip_id").pivot("factor", ["head", "tail"]).agg(F.first("value"))
    rows = lat.select("clip_id", "start_frame", F.concat(F.slice("mu", 1, 4), F.slice("mu", 61, 4)).alias("mu")).join(f, "clip_id").join(L.row_positions(lat, "start_frame"), "clip_id")
    return CL.dci(rows, ["head", "tail"], n_trees=8)


@register(
    "mean_jump_change_points", ints="video break",
    sql="WITH e AS (SELECT user_id AS video, row_number() OVER w - 1 AS m, count(*) OVER (PARTITION BY user_id) AS n, ln(1 + value) AS a, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50.0 AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "p AS (SELECT *, coalesce(sum(a) OVER w, 0) AS pa, coalesce(sum(b) OVER w, 0) AS pb, sum(a) OVER (PARTITION BY video) AS ta, sum(b) OVER (PARTITION BY video) AS tb FROM e WINDOW w AS (PARTITION BY video ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "c AS (SELECT video, m, n, CASE WHEN m = 0 THEN 0 ELSE sqrt(pow(pa / m - (ta - pa) / (n - m), 2) + pow(pb / m - (tb - pb) / (n - m), 2)) END AS cost FROM p), l AS (SELECT video, avg(cost) + stddev_pop(cost) AS lim, max(n) AS n FROM c GROUP BY 1) "
    "SELECT c.video, c.m AS \"break\" FROM c JOIN l USING (video) WHERE cost > lim UNION ALL SELECT video, n FROM l",
)
def _(spark, d):
    return SG.mean_jump_change_points(windows(spark, d))


@register("match_events", doubles="tol precision recall f1 hit_rate")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("video"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_type")
    m = SG.match_events(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), [3600.0, 7200.0])
    return SG.match_scores(m)


@register("pelt_change_points", ints="video break")
def _(spark, d):
    return SG.pelt_change_points(windows(spark, d), 10.0)


@register("change_point_validation", doubles="tol precision recall f1 hit_rate penalty", digits=4)
def _(spark, d):
    w = windows(spark, d)
    events = w.where("code = 2").select("video", F.col("m").cast("double").alias("t"))
    roles = w.select("video").distinct().select("video", F.when(F.col("video") % 5 < 2, "tune").otherwise("test").alias("role"))
    return SG.change_point_validation(w, events, roles, [5.0, 20.0], [2.0, 5.0], 1.0)


SEAM = (
    "WITH e AS (SELECT user_id AS video, row_number() OVER w - 1 AS m, ln(1 + value) AS a, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50.0 AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT m, sqrt(pow(a - lag(a) OVER w, 2) + pow(b - lag(b) OVER w, 2)) AS step, sqrt(a * a + b * b) AS own FROM e WINDOW w AS (PARTITION BY video ORDER BY m)) "
)


@register("seam_jump_pose", doubles="border interior ratio",
          sql=SEAM + "SELECT avg(CASE WHEN m % 8 = 0 THEN step END) AS border, avg(CASE WHEN m % 8 <> 0 THEN step END) AS interior, avg(CASE WHEN m % 8 = 0 THEN step END) / avg(CASE WHEN m % 8 <> 0 THEN step END) AS ratio FROM s WHERE step IS NOT NULL")
def _(spark, d):
    return WN.seam_jump(windows(spark, d), WN.Geometry(fps=25.0))


@register("seam_jump_delta", doubles="border interior ratio",
          sql=SEAM + "SELECT avg(CASE WHEN (m + 1) % 8 = 0 THEN own END) AS border, avg(CASE WHEN (m + 1) % 8 <> 0 THEN own END) AS interior, avg(CASE WHEN (m + 1) % 8 = 0 THEN own END) / avg(CASE WHEN (m + 1) % 8 <> 0 THEN own END) AS ratio FROM s")
def _(spark, d):
    return WN.seam_jump(windows(spark, d), WN.Geometry(fps=25.0), "delta")


@register("bandpass", ints="video m", doubles="z0 z1")
def _(spark, d):
    b = FL.bandpass(windows(spark, d), 10.0, 0.5, 3.0)
    return b.select("video", "m", F.col("z")[0].alias("z0"), F.col("z")[1].alias("z1"))


@register("filter_walk", ints="video m", doubles="z0 z1")
def _(spark, d):
    b = FL.filter_walk(windows(spark, d), 10.0, 5.0)
    return b.select("video", "m", F.col("z")[0].alias("z0"), F.col("z")[1].alias("z1"))
