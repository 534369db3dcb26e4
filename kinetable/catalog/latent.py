"""Queries over latent tables (the embeddings), codes and clusters."""

from pyspark.sql import functions as F

from kinetable.catalog.inference import Q0, _resampled, u01
from kinetable.catalog.registry import register
from kinetable.catalog.sqltext import LAT
from kinetable.operators import kernels as KE
from kinetable.operators import latent as L
from kinetable.operators import neighbours as NB
from kinetable.operators import quality as QL
from kinetable.sources.tables import latents, state_paths, table

LV = f"{LAT}, lv AS (SELECT *, 0.5 * mu - 1.0 AS logvar FROM lat)"
KL = "0.5 * (mu * mu + exp(logvar) - logvar - 1.0)"


@register("kl_per_dim", ints="dim active", doubles="kl mu_rms mean_var kl_floored",
          sql=f"WITH {LV} SELECT dim, avg({KL}) AS kl, sqrt(avg(mu * mu)) AS mu_rms, avg(exp(logvar)) AS mean_var, avg({KL}) > 0.01 AS active, greatest(0.2, avg({KL})) AS kl_floored FROM lv GROUP BY 1")
def _(spark, d):
    return L.kl_per_dim(latents(spark, d), floor=0.2)


@register("kl_totals", ints="n_active n_dims", doubles="total_kl", sql=f"WITH {LV}, k AS (SELECT dim, avg({KL}) AS kl FROM lv GROUP BY 1) SELECT sum(kl) AS total_kl, sum(CASE WHEN kl > 0.01 THEN 1 ELSE 0 END) AS n_active, count(*) AS n_dims FROM k")
def _(spark, d):
    return L.kl_totals(L.kl_per_dim(latents(spark, d)))


@register("kl_by_window", ints="window", doubles="kl", sql=f"WITH {LV}, k AS (SELECT dim, avg({KL}) AS kl FROM lv GROUP BY 1) SELECT dim // 8 AS \"window\", sum(kl) AS kl FROM k GROUP BY 1")
def _(spark, d):
    return L.kl_by_window(latents(spark, d), 8)


@register("kl_per_clip", ints="clip_id", doubles="kl", sql=f"WITH {LV} SELECT clip_id, sum({KL}) AS kl FROM lv GROUP BY 1")
def _(spark, d):
    return L.kl_per_clip(latents(spark, d))


@register("active_units", ints="dim active", doubles="variance", digits=8, sql=f"WITH {LV} SELECT dim, var_pop(mu) AS variance, var_pop(mu) > 0.01 AS active FROM lv GROUP BY 1")
def _(spark, d):
    return L.active_units(latents(spark, d))


@register("precision_spectrum", ints="dim rank above", doubles="precision",
          sql=f"WITH {LV}, p AS (SELECT dim, avg(exp(-logvar)) AS precision FROM lv GROUP BY 1) SELECT dim, precision, row_number() OVER (ORDER BY precision DESC, dim) AS rank, precision > 2 AS above FROM p")
def _(spark, d):
    return L.precision_spectrum(latents(spark, d))


@register("map_mismatch", ints="latent joint", doubles="mismatch",
          sql=f"WITH {LV}, r AS (SELECT dim // 8 AS latent, dim % 8 AS joint, avg(abs(mu)) AS value FROM lv GROUP BY 1, 2), w AS (SELECT dim // 8 AS latent, dim % 8 AS joint, avg(exp(logvar)) AS value FROM lv GROUP BY 1, 2) "
          "SELECT latent, joint, abs(r.value / max(r.value) OVER () - w.value / max(w.value) OVER ()) AS mismatch FROM r JOIN w USING (latent, joint)")
def _(spark, d):
    z = L.long_latents(latents(spark, d)).groupBy((F.floor(F.col("dim") / 8)).alias("latent"), (F.col("dim") % 8).alias("joint"))
    return L.map_mismatch(z.agg(F.avg(F.abs("mu")).alias("value")), z.agg(F.avg(F.exp("logvar")).alias("value")))


FAC = (
    "fac AS (SELECT vec_id AS clip_id, 'label' AS factor, CAST(label AS DOUBLE) AS value FROM embeddings UNION ALL SELECT vec_id, 'head', CAST(embedding[1] AS DOUBLE) + 0.5 * CAST(embedding[2] AS DOUBLE) FROM embeddings "
    "UNION ALL SELECT vec_id, 'tail', CAST(embedding[64] AS DOUBLE) * CAST(embedding[63] AS DOUBLE) FROM embeddings)"
)


def factors(spark, d):
    e = latents(spark, d)
    m = F.col("mu")
    return e.select(
        "clip_id", F.col("video").cast("double").alias("label"), (m[0] + 0.5 * m[1]).alias("head"), (m[63] * m[62]).alias("tail")
    ).unpivot("clip_id", ["label", "head", "tail"], "factor", "value")


def mi_sql(src="rows"):
    b = lambda v: f"CASE WHEN mx{v} > mn{v} THEN least(CAST(floor(({v} - mn{v}) / (mx{v} - mn{v}) * 20) AS BIGINT), 19) ELSE 0 END"
    return (
        f"lim AS (SELECT *, min(mu) OVER (PARTITION BY dim) AS mnmu, max(mu) OVER (PARTITION BY dim) AS mxmu, min(value) OVER (PARTITION BY factor) AS mnvalue, max(value) OVER (PARTITION BY factor) AS mxvalue FROM {src}), "
        f"bn AS (SELECT dim, factor, {b('mu')} AS bi, {b('value')} AS bj, count(*) AS n FROM lim GROUP BY 1, 2, 3, 4), "
        "pp AS (SELECT dim, factor, n / sum(n) OVER (PARTITION BY dim, factor) AS p, sum(n) OVER (PARTITION BY dim, factor, bi) / sum(n) OVER (PARTITION BY dim, factor) AS pi, "
        "sum(n) OVER (PARTITION BY dim, factor, bj) / sum(n) OVER (PARTITION BY dim, factor) AS pj FROM bn), "
        "mi AS (SELECT dim, factor, sum(p * ln(p / (pi * pj))) AS mi, sum(-p * ln(pj)) AS h_factor FROM pp GROUP BY 1, 2)"
    )


ROWS = f"{LAT}, {FAC}, rows AS (SELECT l.clip_id, dim, mu, factor, value FROM lat l JOIN fac USING (clip_id))"
MIG = "mg AS (SELECT factor, (max(CASE WHEN r = 1 THEN mi END) - max(CASE WHEN r = 2 THEN mi END)) / max(h_factor) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY mi DESC) AS r FROM mi) GROUP BY 1)"


def factor_rows(spark, d):
    return L.latent_factor_rows(latents(spark, d), factors(spark, d))


@register("mutual_information", ints="dim", texts="factor", doubles="mi h_factor", sql=f"WITH {ROWS}, {mi_sql()} SELECT * FROM mi")
def _(spark, d):
    return L.mutual_information(factor_rows(spark, d))


@register("mig", texts="factor", doubles="gap", sql=f"WITH {ROWS}, {mi_sql()}, {MIG} SELECT * FROM mg")
def _(spark, d):
    return L.mig(L.mutual_information(factor_rows(spark, d)))


@register(
    "sap", texts="factor", doubles="gap",
    sql=f"WITH {ROWS}, od AS (SELECT vec_id AS clip_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings), rr AS (SELECT r.*, pos >= n - CAST(floor(n * 0.2) AS BIGINT) AS t FROM rows r JOIN od USING (clip_id)), "
    "ft AS (SELECT dim, factor, regr_slope(value, mu) AS s, regr_intercept(value, mu) AS i FROM rr WHERE NOT t GROUP BY 1, 2), "
    "sc AS (SELECT rr.dim, rr.factor, greatest(1.0 - sum(pow(value - (s * mu + i), 2)) / (var_pop(value) * count(*)), 0) AS r2 FROM rr JOIN ft USING (dim, factor) WHERE t GROUP BY 1, 2) "
    "SELECT factor, max(CASE WHEN r = 1 THEN r2 END) - max(CASE WHEN r = 2 THEN r2 END) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY r2 DESC) AS r FROM sc) GROUP BY 1",
)
def _(spark, d):
    lat = latents(spark, d)
    return L.sap(factor_rows(spark, d), L.row_positions(lat, "start_frame"))


@register(
    "selectivity", doubles="score shuffled_score selectivity",
    sql=f"WITH {LAT}, {FAC}, st AS (SELECT vec_id AS clip_id, label % 3 AS state FROM embeddings), fs AS (SELECT * FROM fac JOIN st USING (clip_id) WHERE factor <> 'label'), "
    f"a AS (SELECT *, row_number() OVER (PARTITION BY factor, state ORDER BY {u01(Q0, 'factor', 'state', 'clip_id')}, clip_id) AS i FROM fs), b AS (SELECT *, row_number() OVER (PARTITION BY factor, state ORDER BY {u01(chr(39) + '1' + chr(39), 'factor', 'state', 'clip_id')}, clip_id) AS i FROM fs), "
    "sh AS (SELECT a.clip_id, a.factor, b.value FROM a JOIN b USING (factor, state, i)), rows AS (SELECT l.clip_id, dim, mu, factor, value FROM lat l JOIN fs USING (clip_id)), "
    f"{mi_sql()}, {MIG}, one AS (SELECT avg(gap) AS score FROM mg), rows2 AS (SELECT l.clip_id, dim, mu, factor, value FROM lat l JOIN sh USING (clip_id)), "
    + mi_sql("rows2").replace("lim AS", "lim2 AS").replace("FROM lim ", "FROM lim2 ").replace("bn AS", "bn2 AS").replace("FROM bn)", "FROM bn2)").replace("pp AS", "pp2 AS").replace("FROM pp ", "FROM pp2 ").replace("mi AS (", "mi2 AS (")
    + ", " + MIG.replace("mg AS", "mg2 AS").replace("FROM mi)", "FROM mi2)")
    + ", two AS (SELECT avg(gap) AS s2 FROM mg2) SELECT score, s2 AS shuffled_score, score - s2 AS selectivity FROM one, two",
)
def _(spark, d):
    lat = latents(spark, d)
    st = lat.select("clip_id", (F.col("video") % 3).alias("state"))
    return L.selectivity(lat, factors(spark, d).where("factor <> 'label'"), st, lambda r: L.mean_gap(L.mig(L.mutual_information(r))))


@register("rate_distortion", ints="knee model", doubles="rate bits distortion",
          sql=f"WITH {LV}, p AS (SELECT clip_id % 20 AS model, avg({KL}) * 64 AS rate, avg(mu * mu) AS distortion FROM lv GROUP BY 1), "
          "s AS (SELECT *, abs(lead(distortion) OVER w - 2 * distortion + lag(distortion) OVER w) AS c, row_number() OVER w AS i FROM p WINDOW w AS (ORDER BY rate, model)) "
          "SELECT model, rate, rate / ln(2.0) AS bits, distortion, coalesce(i = (SELECT i FROM s WHERE c IS NOT NULL ORDER BY c DESC, i LIMIT 1), false) AS knee FROM s")
def _(spark, d):
    z = L.long_latents(latents(spark, d)).groupBy((F.col("clip_id") % 20).alias("model")).agg(
        (F.avg(L.kl_term(F.col("mu"), F.col("logvar"))) * 64).alias("rate"), F.avg(F.col("mu") * F.col("mu")).alias("distortion")
    )
    return L.rate_distortion(z)


COMP = (
    "cm AS (SELECT video AS component, dim, avg(mu) AS m, greatest(var_pop(mu), 1e-3) AS v FROM lv GROUP BY 1, 2), cw AS (SELECT label AS component, count(*) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE) AS w FROM embeddings GROUP BY 1), "
    "lp AS (SELECT clip_id, cm.component, any_value(ln(w)) - 0.5 * sum(pow(mu - m, 2) / v + ln(v) + ln(2 * pi())) AS lp, 0.5 * sum(ln(v) - logvar + (exp(logvar) + pow(mu - m, 2)) / v - 1.0) AS klz, any_value(w) AS w FROM lv JOIN cm USING (dim) JOIN cw ON cw.component = cm.component GROUP BY 1, 2), "
    "gm AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY clip_id)) / sum(exp(lp - mx)) OVER (PARTITION BY clip_id) AS g FROM (SELECT *, max(lp) OVER (PARTITION BY clip_id) AS mx FROM lp))"
)


def components(spark, d):
    lat = latents(spark, d)
    z = L.long_latents(lat, ("video",)).groupBy("video", "dim").agg(F.avg("mu").alias("m"), F.greatest(F.var_pop("mu"), F.lit(1e-3)).alias("v"))
    z = z.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("dim", "m", "v"))).alias("a"))
    w = lat.groupBy("video").agg(F.count("*").alias("c")).join(F.broadcast(lat.agg(F.count("*").alias("t")).withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k"))
    return z.join(w, "video").select(
        F.col("video").alias("component"), (F.col("c") / F.col("t")).alias("weight"), F.transform("a", lambda e: e["m"]).alias("mean"), F.transform("a", lambda e: e["v"]).alias("var")
    )


@register("gmm_responsibilities", ints="clip_id component", doubles="gamma", sql=f"WITH {LV}, {COMP} SELECT clip_id, component, g AS gamma FROM gm")
def _(spark, d):
    r = L.responsibilities(latents(spark, d), components(spark, d))
    return r.select("clip_id", F.posexplode("gamma").alias("component", "gamma"))


@register("gmm_occupancy", ints="component", doubles="occupancy", sql=f"WITH {LV}, {COMP} SELECT component, avg(g) AS occupancy FROM gm GROUP BY 1")
def _(spark, d):
    return L.mean_responsibility(L.responsibilities(latents(spark, d), components(spark, d)))


@register("gmm_assignment_divergence", ints="clip_id", doubles="assignment_entropy kl_y kl_z",
          sql=f"WITH {LV}, {COMP} SELECT clip_id, sum(CASE WHEN g > 0 THEN -g * ln(g) ELSE 0 END) AS assignment_entropy, sum(CASE WHEN g > 0 THEN g * (ln(g) - ln(w)) ELSE 0 END) AS kl_y, sum(g * klz) AS kl_z FROM gm GROUP BY 1")
def _(spark, d):
    lat, c = latents(spark, d), components(spark, d)
    return L.responsibilities(lat, c).join(L.kl_to_components(lat, c), "clip_id")


@register(
    "quantize_residual", ints="clip_id code0 code1", doubles="residual_norm",
    sql=f"WITH {LAT}, bk AS (SELECT 0 AS layer, video AS code, dim, avg(mu) AS v FROM lat GROUP BY 2, 3 UNION ALL SELECT 1, clip_id % 7, dim, 0.5 * avg(mu) FROM lat GROUP BY 2, 3), "
    "d0 AS (SELECT clip_id, code, sum(pow(mu - v, 2)) AS d FROM lat JOIN bk USING (dim) WHERE layer = 0 GROUP BY 1, 2), c0 AS (SELECT clip_id, arg_min(code, (d, code)) AS code0 FROM d0 GROUP BY 1), "
    "r1 AS (SELECT lat.clip_id, lat.dim, mu - v AS r FROM lat JOIN c0 USING (clip_id) JOIN bk ON bk.layer = 0 AND bk.code = code0 AND bk.dim = lat.dim), "
    "d1 AS (SELECT clip_id, code, sum(pow(r - v, 2)) AS d FROM r1 JOIN bk USING (dim) WHERE layer = 1 GROUP BY 1, 2), c1 AS (SELECT clip_id, arg_min(code, (d, code)) AS code1, sqrt(min(d)) AS residual_norm FROM d1 GROUP BY 1) "
    "SELECT clip_id, code0, code1, residual_norm FROM c0 JOIN c1 USING (clip_id)",
)
def _(spark, d):
    lat = latents(spark, d)
    q = L.quantize_residual(lat, codebooks(lat), 2)
    return q.select("clip_id", F.col("codes")[0].alias("code0"), F.col("codes")[1].alias("code1"), "residual_norm")


def codebooks(lat):
    def book(key, layer, scale):
        z = lat.select(key.alias("code"), F.posexplode("mu").alias("dim", "mu")).groupBy("code", "dim").agg((scale * F.avg("mu")).alias("v"))
        return z.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda e: e["v"]).alias("vec")).withColumn("layer", F.lit(layer))

    return book(F.col("video"), 0, 1.0).unionByName(book(F.col("clip_id") % 7, 1, 0.5))


AGR = (
    "c AS (SELECT a, b, count(*) AS n FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c), "
    "s AS (SELECT max(t) AS n, sum(n * (n - 1) / 2.0) AS sij, sum(n / t * ln(n * t / (na * nb))) AS mi, sum(-n / t * ln(na / t)) AS ha, sum(-n / t * ln(nb / t)) AS hb FROM m), "
    "sa AS (SELECT sum(k * (k - 1) / 2.0) AS sa FROM (SELECT sum(n) AS k FROM c GROUP BY a)), sb AS (SELECT sum(k * (k - 1) / 2.0) AS sb FROM (SELECT sum(n) AS k FROM c GROUP BY b)) "
    "SELECT n, (sij - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)) AS ari, mi / ((ha + hb) / 2) AS nmi FROM s, sa, sb"
)


@register("ari_nmi", ints="n", doubles="ari nmi", digits=8, sql=f"WITH x AS (SELECT c_nationkey AS a, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END AS b FROM customer), {AGR}")
def _(spark, d):
    return _customer_agreement(spark, d)


@register("ami", doubles="ami")
def _(spark, d):
    return _customer_agreement(spark, d)


def _customer_agreement(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("a"), F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2).alias("b"))
    return L.agreement(c, "a", "b")


@register(
    "composition_matrix", ints="subject cluster", doubles="share",
    sql="WITH x AS (SELECT user_id AS subject, CASE event_type WHEN 'error' THEN -1 WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS cluster FROM events), n AS (SELECT subject, sum(CASE WHEN cluster >= 0 THEN 1 ELSE 0 END) AS n FROM x GROUP BY 1) "
    "SELECT n.subject, k.cluster, CASE WHEN n.n > 0 THEN count(x.cluster) / CAST(n.n AS DOUBLE) ELSE 0 END AS share FROM n CROSS JOIN (VALUES (0),(1),(2),(3)) k(cluster) LEFT JOIN x ON x.subject = n.subject AND x.cluster = k.cluster GROUP BY n.subject, k.cluster, n.n",
)
def _(spark, d):
    return L.composition_matrix(_clusters(spark, d), "subject", "cluster", 4)


def _clusters(spark, d):
    p = state_paths(spark, d)
    return p.select(F.col("video").alias("subject"), F.when(F.col("state") == 1, -1).when(F.col("state") == 0, 0).otherwise(F.col("state") - 1).alias("cluster"))


@register("concentrated_share", doubles="concentrated",
          sql="WITH x AS (SELECT user_id AS subject, CASE event_type WHEN 'error' THEN -1 WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS cluster FROM events), c AS (SELECT subject, cluster, count(*) AS n FROM x WHERE cluster >= 0 GROUP BY 1, 2), "
          "s AS (SELECT subject, max(n) / sum(n) AS m FROM c GROUP BY 1) SELECT avg(CASE WHEN m > 0.3 THEN 1.0 ELSE 0 END) AS concentrated FROM s")
def _(spark, d):
    return L.concentrated_share(L.dominant_clusters(L.composition_matrix(_clusters(spark, d), "subject", "cluster", 4), "subject"), 0.3)


def tokens(spark, d):
    return state_paths(spark, d).select(F.col("video").alias("clip_id"), (F.col("m") % 2).alias("layer"), F.floor(F.col("m") / 2).alias("t"), F.col("state").alias("code"))


TOK = "tk AS (SELECT user_id AS clip_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 2 AS layer, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS code FROM events)"


@register("codebook_usage", ints="layer", doubles="usage", sql=f"WITH {TOK} SELECT layer, count(DISTINCT code) / 8.0 AS usage FROM tk GROUP BY 1")
def _(spark, d):
    return QL.codebook_usage(tokens(spark, d), 8)


CCC = f"{TOK}, n AS (SELECT layer, code, clip_id % 3 AS cls, count(*) AS n FROM tk GROUP BY 1, 2, 3), t AS (SELECT layer, code, sum(n) AS total, arg_max(cls, (n, -cls)) AS top_class, max(n) / sum(n) AS purity FROM n GROUP BY 1, 2), cc AS (SELECT *, total / sum(total) OVER (PARTITION BY layer) AS weight FROM t)"


@register("code_class_cooccurrence", ints="layer code total top_class", doubles="purity weight", sql=f"WITH {CCC} SELECT * FROM cc")
def _(spark, d):
    return QL.code_class_cooccurrence(tokens(spark, d).withColumn("cls", F.col("clip_id") % 3), "cls")


@register("code_mean_purity", ints="layer", doubles="mean_purity", sql=f"WITH {CCC} SELECT layer, sum(purity * weight) / sum(weight) AS mean_purity FROM cc GROUP BY 1")
def _(spark, d):
    return QL.mean_purity(QL.code_class_cooccurrence(tokens(spark, d).withColumn("cls", F.col("clip_id") % 3), "cls"))


ATT = f"{LAT}, ex AS (SELECT clip_id, dim // 16 AS head, dim % 16 AS t, exp(5 * mu) AS e FROM lat), att AS (SELECT clip_id, head, t, e / sum(e) OVER (PARTITION BY clip_id, head) AS a FROM ex)"


def attention(spark, d):
    z = latents(spark, d).select("clip_id", F.posexplode("mu").alias("dim", "mu")).select("clip_id", F.floor(F.col("dim") / 16).alias("head"), (F.col("dim") % 16).alias("t"), F.exp(5 * F.col("mu")).alias("e"))
    from pyspark.sql.window import Window as W

    return z.withColumn("a", F.col("e") / F.sum("e").over(W.partitionBy("clip_id", "head"))).drop("e")


@register("attention_entropy", ints="head focused", doubles="entropy",
          sql=f"WITH {ATT}, c AS (SELECT clip_id, head, sum(-a * ln(greatest(a, 1e-12))) AS e FROM att GROUP BY 1, 2), h AS (SELECT head, avg(e) AS entropy FROM c GROUP BY 1) SELECT head, entropy, entropy <= (SELECT quantile_cont(entropy, 0.5) FROM h) AS focused FROM h")
def _(spark, d):
    return QL.attention_entropy(attention(spark, d))


@register("head_correlation", ints="head_a head_b", doubles="mean_corr",
          sql=f"WITH {ATT}, c AS (SELECT x.clip_id, x.head AS head_a, y.head AS head_b, corr(x.a, y.a) AS c FROM att x JOIN att y ON x.clip_id = y.clip_id AND x.t = y.t AND x.head < y.head GROUP BY 1, 2, 3) SELECT head_a, head_b, avg(c) AS mean_corr FROM c GROUP BY 1, 2")
def _(spark, d):
    return QL.head_correlation(attention(spark, d), 4)


@register("attention_motion_cosine", ints="clip_id", doubles="cosine",
          sql=f"WITH {ATT}, h AS (SELECT clip_id, t, avg(a) AS a FROM att GROUP BY 1, 2), m AS (SELECT clip_id, dim AS t, abs(mu) AS motion FROM lat WHERE dim < 16) SELECT clip_id, corr(a, motion) AS cosine FROM h JOIN m USING (clip_id, t) GROUP BY 1")
def _(spark, d):
    m = latents(spark, d).select("clip_id", F.posexplode("mu").alias("t", "mu")).where("t < 16").select("clip_id", "t", F.abs("mu").alias("motion"))
    return QL.attention_motion_cosine(attention(spark, d), m)


PTS = "pt AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
NN = (
    f"{PTS}, dd AS (SELECT a.vec_id AS clip_id, b.vec_id AS o, list_distance(a.e, b.e) AS d FROM pt a JOIN pt b ON a.vec_id <> b.vec_id), "
    "nn AS (SELECT clip_id, max(CASE WHEN r = 1 THEN d END) AS r1, max(CASE WHEN r = 2 THEN d END) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY d) AS r FROM dd) WHERE r <= 2 GROUP BY 1), "
    "ra AS (SELECT clip_id, r2 / r1 AS mu FROM nn WHERE r1 > 0)"
)


@register("nearest_two", ints="clip_id", doubles="r1 r2", sql=f"WITH {NN} SELECT * FROM nn")
def _(spark, d):
    return NB.nearest_two(latents(spark, d))


@register("neighbour_ratios", ints="clip_id", doubles="mu", sql=f"WITH {NN} SELECT * FROM ra")
def _(spark, d):
    return NB.neighbour_ratios(NB.nearest_two(latents(spark, d)))


@register("twonn_mle", ints="n_used", doubles="d_hat standard_error",
          sql=f"WITH {NN}, k AS (SELECT mu, row_number() OVER (ORDER BY mu) AS i, count(*) OVER () AS n FROM ra), s AS (SELECT count(*) AS n_used, sum(ln(mu)) AS s FROM k WHERE i <= floor(n * 0.9)) SELECT n_used, n_used / s AS d_hat, sqrt(n_used) / s AS standard_error FROM s", digits=5)
def _(spark, d):
    return NB.twonn_mle(NB.neighbour_ratios(NB.nearest_two(latents(spark, d))))


@register(
    "twonn_least_squares", ints="n_used", doubles="d_hat standard_error r2 d_mle", digits=5,
    sql=f"WITH {NN}, k AS (SELECT ln(mu) AS x, row_number() OVER (ORDER BY mu) AS i, count(*) OVER () AS n FROM ra), f AS (SELECT x, -ln(1 - i / CAST(n AS DOUBLE)) AS y FROM k WHERE i <= greatest(2, floor(n * 0.9)) AND i < n), "
    "s AS (SELECT sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, count(*) AS n_used FROM f) SELECT n_used, sxy / sxx AS d_hat, sqrt((syy - sxy * sxy / sxx) / (n_used - 1) / sxx) AS standard_error, 1 - (syy - sxy * sxy / sxx) / syy AS r2, "
    "(SELECT count(*) / sum(x) FROM k) AS d_mle FROM s",
)
def _(spark, d):
    return NB.twonn_least_squares(NB.neighbour_ratios(NB.nearest_two(latents(spark, d))))


@register("twonn_bootstrap", ints="reps", doubles="bootstrap_se")
def _(spark, d):
    return NB.twonn_bootstrap(NB.neighbour_ratios(NB.nearest_two(latents(spark, d))), reps=20)


@register("pairwise_kernel", ints="clip_id", doubles="row_sum bandwidth",
          sql=f"WITH {PTS}, dd AS (SELECT a.vec_id AS clip_id, b.vec_id AS o, list_distance(a.e, b.e) AS d FROM pt a, pt b), h AS (SELECT quantile_cont(d, 0.5) AS h FROM dd WHERE clip_id < o) SELECT clip_id, sum(exp(-d * d / (2 * h * h))) AS row_sum, any_value(h) AS bandwidth FROM dd, h GROUP BY 1")
def _(spark, d):
    return KE.pairwise_kernel(latents(spark, d))


@register(
    "mmd_statistic", ints="m n", doubles="mmd2 bandwidth", digits=8,
    sql="WITH pt AS (SELECT vec_id, label % 2 AS g, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), dd AS (SELECT a.g AS ga, b.g AS gb, list_distance(a.e, b.e) AS d FROM pt a JOIN pt b ON a.vec_id < b.vec_id), h AS (SELECT quantile_cont(d * d, 0.5) AS h2 FROM dd), "
    "n AS (SELECT sum(1 - g) AS m, sum(g) AS n FROM pt), k AS (SELECT ga + gb AS t, sum(exp(-d * d / (2 * h2))) AS k FROM dd, h GROUP BY 1) "
    "SELECT any_value(m) AS m, any_value(n) AS n, any_value(sqrt(h2)) AS bandwidth, sum(CASE t WHEN 0 THEN 2 * k / (m * (m - 1)) WHEN 2 THEN 2 * k / (n * (n - 1)) ELSE -2 * k / (m * n) END) AS mmd2 FROM k, n, h",
)
def _(spark, d):
    return _mmd(spark, d)


@register("mmd_test_p", doubles="p_share p_plus_one")
def _(spark, d):
    return _mmd(spark, d)


def _mmd(spark, d):
    lat = latents(spark, d)
    return KE.mmd_test(lat.where("video % 2 = 0"), lat.where("video % 2 = 1"))


@register("prior_test", ints="m n", doubles="mmd2 bandwidth p_plus_one")
def _(spark, d):
    return KE.prior_test(latents(spark, d))


@register(
    "hsic_statistic", ints="n", doubles="hsic", digits=8,
    sql="WITH pt AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), dd AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.e, b.e) AS d, CASE WHEN a.label = b.label THEN 0.0 ELSE sqrt(2.0) END AS f FROM pt a, pt b), "
    "h AS (SELECT quantile_cont(d, 0.5) AS hd, quantile_cont(f, 0.5) AS hf FROM dd WHERE i < j), k AS (SELECT i, j, exp(-d * d / (2 * hd * hd)) AS k, exp(-f * f / (2 * hf * hf)) AS l FROM dd, h), n AS (SELECT count(*) AS n FROM pt), "
    "r AS (SELECT i, sum(k) AS rk, sum(l) AS rl FROM k GROUP BY 1), a AS (SELECT sum(k * l) AS kl FROM k), b AS (SELECT sum(rk * rl) AS rr, sum(rk) AS sk, sum(rl) AS sl FROM r) "
    "SELECT n, (kl - 2.0 / n * rr + sk * sl / (n * n)) / pow(n - 1, 2) AS hsic FROM a, b, n",
)
def _(spark, d):
    return KE.hsic_test(latents(spark, d), "clip_id", "mu", "video", draws=0)


@register("hsic_test_p", ints="n", doubles="hsic p_value")
def _(spark, d):
    return KE.hsic_test(latents(spark, d), "clip_id", "mu", "video")


Z = (
    f"zz AS (SELECT *, mu + exp(0.5 * logvar) * sqrt(-2 * ln(greatest({u01(chr(39) + '3' + chr(39), 'clip_id', 'dim')}, 1e-300))) * cos(2 * pi() * {u01(chr(39) + '4' + chr(39), 'clip_id', 'dim')}) AS z FROM lv), "
    "dn AS (SELECT a.clip_id AS i, b.clip_id AS j, a.dim, -0.5 * ln(2 * pi()) - 0.5 * b.logvar - 0.5 * pow(a.z - b.mu, 2) / exp(b.logvar) AS l FROM zz a JOIN zz b ON a.dim = b.dim), "
    "jt AS (SELECT i, j, sum(l) AS s FROM dn GROUP BY 1, 2), jm AS (SELECT i, max(s) + ln(avg(exp(s - m))) AS joint, max(CASE WHEN i = j THEN s END) AS own FROM (SELECT *, max(s) OVER (PARTITION BY i) AS m FROM jt) GROUP BY 1), "
    "pd AS (SELECT i, dim, max(l) + ln(avg(exp(l - m))) AS q FROM (SELECT *, max(l) OVER (PARTITION BY i, dim) AS m FROM dn) GROUP BY 1, 2), ps AS (SELECT i, sum(q) AS prod FROM pd GROUP BY 1), "
    "pz AS (SELECT clip_id AS i, sum(-0.5 * ln(2 * pi()) - 0.5 * z * z) AS pz FROM zz GROUP BY 1)"
)


@register("tc_decomposition", ints="n", doubles="mutual_information total_correlation dimension_wise",
          sql=f"WITH {LV}, {Z} SELECT avg(own - joint) AS mutual_information, avg(joint - prod) AS total_correlation, avg(prod - pz) AS dimension_wise, count(*) AS n FROM jm JOIN ps USING (i) JOIN pz USING (i)")
def _(spark, d):
    return KE.tc_decomposition(latents(spark, d))


@register("silhouette", ints="n", doubles="silhouette",
          sql="WITH pt AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), sz AS (SELECT label, count(*) AS c FROM pt GROUP BY 1), dd AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_distance(a.e, b.e)) AS s FROM pt a, pt b GROUP BY 1, 2, 3), "
          "m AS (SELECT vec_id, max(CASE WHEN la = lb THEN s / greatest(c - 1, 1) END) AS a, min(CASE WHEN la <> lb THEN s / c END) AS b FROM dd JOIN sz ON sz.label = lb GROUP BY 1) SELECT avg((b - a) / greatest(a, b)) AS silhouette, count(*) AS n FROM m")
def _(spark, d):
    return KE.silhouette(latents(spark, d), "clip_id", "mu", "video")


@register(
    "kde_typicality", ints="clip_id", doubles="log_density",
    sql="WITH pt AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), rf AS (SELECT * FROM pt WHERE label < 5), "
    "h AS (SELECT stddev_pop(v) * pow(count(DISTINCT vec_id), -1.0 / (max(d) + 4)) AS h, max(d) AS d FROM (SELECT vec_id, unnest(e) AS v, len(e) AS d FROM rf)), "
    "dd AS (SELECT a.vec_id AS clip_id, -pow(list_distance(a.e, b.e), 2) / (2 * h * h) AS l FROM pt a, rf b, h), m AS (SELECT clip_id, max(l) AS m FROM dd GROUP BY 1) "
    "SELECT clip_id, any_value(m) + ln(sum(exp(l - m))) - ln(count(*)) - any_value(d) * ln(any_value(h)) - 0.5 * any_value(d) * ln(2 * pi()) AS log_density FROM dd JOIN m USING (clip_id), h GROUP BY 1",
)
def _(spark, d):
    lat = latents(spark, d)
    return KE.kde_typicality(lat, lat.where("video < 5"))
