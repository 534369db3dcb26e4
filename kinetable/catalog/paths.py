"""Queries over state paths."""

from pyspark.sql import functions as F

from kinetable.catalog.registry import register
from kinetable.catalog.sqltext import PATHS, SP
from kinetable.operators import states as S
from kinetable.operators import windows as WN
from kinetable.sources.tables import state_paths, table

K = 5
F_WIN = 2.0
STATES = "st AS (SELECT unnest(range(0, 5)) AS state)"
VIDEOS = "vid AS (SELECT DISTINCT video FROM sp)"
TRANS = (
    "tr AS (SELECT * FROM (SELECT video, state, lead(state) OVER (PARTITION BY video ORDER BY m) AS next_state FROM sp) "
    "WHERE next_state IS NOT NULL), "
    "cells AS (SELECT v.video, a.state, b.state AS next_state FROM vid v, st a, st b), "
    "cnt AS (SELECT c.video, c.state, c.next_state, count(tr.state) AS n FROM cells c LEFT JOIN tr ON tr.video = c.video "
    "AND tr.state = c.state AND tr.next_state = c.next_state GROUP BY 1, 2, 3), "
    "pm AS (SELECT *, CASE WHEN sum(n) OVER w > 0 THEN n / CAST(sum(n) OVER w AS DOUBLE) ELSE 0.2 END AS p, "
    "CASE WHEN sum(n) OVER w > 0 THEN n / CAST(sum(n) OVER w AS DOUBLE) ELSE 0.0 END AS pz FROM cnt WINDOW w AS (PARTITION BY video, state))"
)
BASE = f"{PATHS}, {STATES}, {VIDEOS}, {TRANS}"
OCC = (
    "occ AS (SELECT v.video, st.state, count(sp.m) AS n, count(sp.m) / CAST((SELECT count(*) FROM sp s2 WHERE s2.video = v.video) AS DOUBLE) "
    "AS occupancy FROM vid v CROSS JOIN st LEFT JOIN sp ON sp.video = v.video AND sp.state = st.state GROUP BY 1, 2)"
)
DW = (
    "dw AS (SELECT v.video, st.state, count(x.visit) AS n_runs, avg(x.dwell / 2.0) AS mean_dwell, "
    "coalesce(quantile_cont(x.dwell / 2.0, 0.5), 0) AS median_dwell, coalesce(max(x.dwell / 2.0), 0) AS max_dwell, "
    "coalesce(stddev_pop(x.dwell / 2.0), 0) AS sd_dwell FROM vid v CROSS JOIN st LEFT JOIN visits x "
    "ON x.video = v.video AND x.state = st.state GROUP BY 1, 2)"
)


@register("read_state_paths", ints="video n_windows k", sql=f"WITH {SP} SELECT video, count(*) AS n_windows, max(state) + 1 AS k FROM sp GROUP BY 1")
def _(spark, d):
    return state_paths(spark, d).groupBy("video").agg(F.count("*").alias("n_windows"), (F.max("state") + 1).alias("k"))


@register("visit_sequence", ints="video visit state dwell m0", sql=f"WITH {PATHS} SELECT * FROM visits")
def _(spark, d):
    return S.visit_sequence(state_paths(spark, d))


@register("occupancy", ints="video state n", doubles="occupancy", sql=f"WITH {BASE}, {OCC} SELECT * FROM occ")
def _(spark, d):
    return S.occupancy(state_paths(spark, d), K)


@register(
    "occupancy_overall", ints="state n", doubles="occupancy",
    sql=f"WITH {SP} SELECT state, count(*) AS n, count(*) / CAST((SELECT count(*) FROM sp) AS DOUBLE) AS occupancy FROM sp GROUP BY 1",
)
def _(spark, d):
    return S.occupancy(state_paths(spark, d), K, [])


@register(
    "dwell_stats", ints="video state n_runs", doubles="mean_dwell median_dwell max_dwell sd_dwell",
    sql=f"WITH {BASE}, {DW} SELECT * FROM dw",
)
def _(spark, d):
    return S.dwell_stats(state_paths(spark, d), K, F_WIN)


@register(
    "dwell_stats_overall", ints="state n_runs", doubles="mean_dwell median_dwell max_dwell sd_dwell",
    sql=f"WITH {PATHS} SELECT state, count(*) AS n_runs, avg(dwell / 2.0) AS mean_dwell, quantile_cont(dwell / 2.0, 0.5) AS median_dwell, "
    "max(dwell / 2.0) AS max_dwell, stddev_pop(dwell / 2.0) AS sd_dwell FROM visits GROUP BY 1",
)
def _(spark, d):
    return S.dwell_stats(
        state_paths(spark, d).withColumn("one", F.lit(1)), K, F_WIN, keys=["one", "video"], by=["one"]
    )


@register("transition_matrix", ints="video state next_state n", doubles="p", sql=f"WITH {BASE} SELECT video, state, next_state, n, p FROM pm")
def _(spark, d):
    return S.transition_matrix(S.transition_counts(state_paths(spark, d), K), K)


@register(
    "jump_chain", ints="video state next_state", doubles="jump",
    sql=f"WITH {BASE}, o AS (SELECT *, CASE WHEN state = next_state THEN 0.0 ELSE p END AS q FROM pm) SELECT video, state, next_state, "
    "CASE WHEN sum(q) OVER w > 0 THEN q / sum(q) OVER w ELSE 0.0 END AS jump FROM o WINDOW w AS (PARTITION BY video, state)",
)
def _(spark, d):
    return S.jump_chain(S.transition_matrix(S.transition_counts(state_paths(spark, d), K), K))


@register(
    "dwell_implied", ints="video state", doubles="implied_dwell",
    sql=f"WITH {BASE} SELECT video, state, least(CASE WHEN p >= 1 THEN 1000.0 ELSE 1.0 / (1.0 - p) / 2.0 END, 1000.0) AS implied_dwell "
    "FROM pm WHERE state = next_state",
)
def _(spark, d):
    t = S.transition_matrix(S.transition_counts(state_paths(spark, d), K), K)
    return S.dwell_implied(t, F_WIN, F.lit(1000.0))


@register("transition_entropy", ints="video", doubles="trans_entropy",
          sql=f"WITH {BASE} SELECT video, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / 5.0 AS trans_entropy FROM pm GROUP BY 1")
def _(spark, d):
    return S.transition_entropy(S.transition_matrix(S.transition_counts(state_paths(spark, d), K), K), K)


@register(
    "transition_rate", ints="video", doubles="trans_rate",
    sql=f"WITH {BASE} SELECT video, sum(CASE WHEN visit > 0 THEN 1 ELSE 0 END) / (sum(dwell) / 2.0) AS trans_rate FROM visits GROUP BY 1",
)
def _(spark, d):
    return S.transition_rate(state_paths(spark, d), F_WIN)


WALK_METRICS = (
    f"WITH {BASE}, {OCC}, {DW}, metrics AS (SELECT video, 'occ_' || state AS metric, occupancy AS value FROM occ UNION ALL "
    "SELECT video, 'dwell_' || state, median_dwell FROM dw UNION ALL SELECT video, 'maxdwell_' || state, max_dwell FROM dw UNION ALL "
    "SELECT video, 'trans_rate', sum(CASE WHEN visit > 0 THEN 1 ELSE 0 END) / (sum(dwell) / 2.0) FROM visits GROUP BY 1 UNION ALL "
    "SELECT video, 'trans_entropy', sum(CASE WHEN pz > 0 THEN -pz * ln(pz) ELSE 0 END) / 5.0 FROM pm GROUP BY 1)"
)


@register("walk_metric_table", ints="video", texts="metric", doubles="value", sql=f"{WALK_METRICS} SELECT * FROM metrics")
def _(spark, d):
    return S.walk_metric_table(state_paths(spark, d), K, F_WIN)


@register(
    "subject_rollup", ints="subject", texts="metric c_mktsegment", doubles="value",
    sql=f"{WALK_METRICS}, wk AS (SELECT DISTINCT video, video % 20 AS subject FROM sp), lab AS (SELECT subject, "
    "arg_min(c_mktsegment, video) AS c_mktsegment FROM wk JOIN customer ON c_custkey = video GROUP BY 1) "
    "SELECT wk.subject, metric, any_value(c_mktsegment) AS c_mktsegment, avg(value) AS value FROM metrics JOIN wk USING (video) "
    "JOIN lab ON lab.subject = wk.subject GROUP BY 1, 2",
)
def _(spark, d):
    path = state_paths(spark, d)
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("video"), "c_mktsegment")
    walks = path.select("video", (F.col("video") % 20).alias("subject")).distinct().join(names, "video")
    return S.subject_rollup(S.walk_metric_table(path, K, F_WIN), walks, ["c_mktsegment"])


@register(
    "occupancy_entropy", ints="video", doubles="occ_entropy mean_run",
    sql=f"WITH {BASE}, {OCC} SELECT o.video, o.e AS occ_entropy, r.mean_run FROM (SELECT video, sum(CASE WHEN occupancy > 0 THEN "
    "-occupancy * ln(occupancy) ELSE 0 END) AS e FROM occ GROUP BY 1) o JOIN (SELECT video, avg(dwell) AS mean_run FROM visits GROUP BY 1) r "
    "ON r.video = o.video",
)
def _(spark, d):
    return S.occupancy_entropy(state_paths(spark, d), K)


@register(
    "phenotype_vector", ints="video", doubles=" ".join([f"occ_{s}" for s in range(K)] + [f"dwell_{s}" for s in range(K)]),
    sql=f"WITH {BASE}, {OCC}, {DW} SELECT o.video, "
    + ", ".join(f"max(CASE WHEN o.state = {s} THEN occupancy END) AS occ_{s}, coalesce(max(CASE WHEN d.state = {s} THEN mean_dwell END), 0) AS dwell_{s}" for s in range(K))
    + " FROM occ o JOIN dw d ON d.video = o.video AND d.state = o.state GROUP BY 1",
)
def _(spark, d):
    return S.phenotype_vector(state_paths(spark, d), K, F_WIN)


@register(
    "group_state_usage", texts="c_mktsegment", ints="state n", doubles="occupancy",
    sql=f"WITH {SP}, g AS (SELECT state, c_mktsegment FROM sp JOIN customer ON c_custkey = video), gs AS (SELECT DISTINCT c_mktsegment FROM g), "
    f"{STATES}, tot AS (SELECT c_mktsegment, count(*) AS t FROM g GROUP BY 1) SELECT gs.c_mktsegment, st.state, count(g.state) AS n, "
    "count(g.state) / CAST(any_value(tot.t) AS DOUBLE) AS occupancy FROM gs CROSS JOIN st JOIN tot ON tot.c_mktsegment = gs.c_mktsegment "
    "LEFT JOIN g ON g.c_mktsegment = gs.c_mktsegment AND g.state = st.state GROUP BY 1, 2",
)
def _(spark, d):
    labels = table(spark, d, "customer").select(F.col("c_custkey").alias("video"), "c_mktsegment")
    return S.group_state_usage(state_paths(spark, d), labels, K, "c_mktsegment")


@register("transition_times", ints="video visit state", doubles="t",
          sql=f"WITH {PATHS} SELECT video, visit, state, (16.0 + 4.0 * m0) / 25.0 AS t FROM visits WHERE visit > 0")
def _(spark, d):
    return S.transition_times(state_paths(spark, d), 16, 4, 25.0)


SIM_SQL = (
    "simt AS (SELECT a.state, b.state AS next_state, 1.0 / (1 + abs(a.n - b.n)) AS s FROM (SELECT state, count(*) AS n FROM sp GROUP BY 1) a, "
    "(SELECT state, count(*) AS n FROM sp GROUP BY 1) b)"
)


def similarity_from_counts(path):
    """A K x K similarity that the data itself gives: closeness of the states' window counts."""
    n = S.occupancy(path, K, [])
    b = n.select(F.col("state").alias("next_state"), F.col("n").alias("n2"))
    grid = n.withColumn("next_state", F.explode(F.sequence(F.lit(0), F.lit(K - 1)))).join(F.broadcast(b), "next_state")
    return grid.select("state", "next_state", (1.0 / (1 + F.abs(F.col("n") - F.col("n2")))).alias("s"))


@register("transition_lookup", ints="video m state next_state", doubles="s",
          sql=f"WITH {SP}, {SIM_SQL}, p AS (SELECT video, m, state, lead(state, 2) OVER (PARTITION BY video ORDER BY m) AS next_state FROM sp) "
          "SELECT p.video, p.m, p.state, p.next_state, s FROM p JOIN simt USING (state, next_state)")
def _(spark, d):
    path = state_paths(spark, d)
    return S.transition_lookup(path, similarity_from_counts(path), lag=2)


@register(
    "similarity_curve", ints="video t", doubles="curve",
    sql=f"WITH {PATHS}, {SIM_SQL}, q AS (SELECT video, visit AS t, state, lead(state) OVER (PARTITION BY video ORDER BY visit) AS next_state "
    "FROM visits), q2 AS (SELECT q.video, q.t, s FROM q JOIN simt USING (state, next_state)), off AS (SELECT video, avg(s) AS c FROM q2 GROUP BY 1) "
    "SELECT a.video, a.t, sum(exp(-0.5 * pow((a.t - b.t) / 3.0, 2)) * b.s) / sum(exp(-0.5 * pow((a.t - b.t) / 3.0, 2))) - any_value(c) AS curve "
    "FROM q2 a JOIN q2 b ON a.video = b.video JOIN off ON off.video = a.video GROUP BY 1, 2",
)
def _(spark, d):
    path = state_paths(spark, d)
    sim = similarity_from_counts(path)
    v = S.visit_sequence(path).select("video", F.col("visit").alias("m"), "state")
    mean = S.transition_lookup(v, sim).groupBy("video").agg(F.avg("s").alias("null_mean"))
    return S.similarity_curve(path, sim, mean, 3.0)


@register(
    "tercile_decomposition", ints="tercile n n_pairs", doubles="observed expected rate_ratio top_over_bottom",
    sql=f"WITH {PATHS}, {SIM_SQL}, cut AS (SELECT quantile_cont(s, 1.0/3.0) AS q1, quantile_cont(s, 2.0/3.0) AS q2 FROM simt WHERE state <> next_state), "
    "tier AS (SELECT state, next_state, CASE WHEN s <= q1 THEN 0 WHEN s <= q2 THEN 1 ELSE 2 END AS tercile FROM simt, cut WHERE state <> next_state), "
    "q AS (SELECT state, lead(state) OVER (PARTITION BY video ORDER BY visit) AS next_state FROM visits), "
    "n AS (SELECT state, next_state, count(*) AS n FROM q WHERE next_state IS NOT NULL GROUP BY 1, 2), "
    "t AS (SELECT tercile, coalesce(sum(n), 0) AS n, count(*) AS n_pairs FROM tier LEFT JOIN n USING (state, next_state) GROUP BY 1), "
    "r AS (SELECT *, n / sum(n) OVER () AS observed, n_pairs / sum(n_pairs) OVER () AS expected FROM t) "
    "SELECT *, observed / expected AS rate_ratio, first_value(observed / expected) OVER (ORDER BY tercile DESC) / first_value(observed / expected) "
    "OVER (ORDER BY tercile) AS top_over_bottom FROM r",
)
def _(spark, d):
    from kinetable.operators.similarity import tercile_decomposition

    path = state_paths(spark, d)
    v = S.visit_sequence(path).select("video", F.col("visit").alias("m"), "state")
    pooled = S.transition_counts(v.withColumn("one", F.lit(1)), K, keys=["one", "video"], by=["one"]).drop("one")
    return tercile_decomposition(similarity_from_counts(path), pooled.where("n > 0"))


@register("top_bottom_pairs", texts="tail", ints="state next_state", doubles="s",
          sql=f"WITH {SP}, {SIM_SQL} SELECT 'top' AS \"end\", * FROM (SELECT * FROM simt WHERE state < next_state ORDER BY s DESC, state, next_state LIMIT 5) "
          "UNION ALL SELECT 'bottom', * FROM (SELECT * FROM simt WHERE state < next_state ORDER BY s, state, next_state LIMIT 5)".replace('AS "end"', "AS tail"))
def _(spark, d):
    from kinetable.operators.similarity import top_bottom_pairs

    return top_bottom_pairs(similarity_from_counts(state_paths(spark, d)))


GEOM = WN.Geometry(fps=8.0, T=8, W=4, stride=4)


@register(
    "label_frames_union", ints="video state frame",
    sql=f"WITH {SP}, n AS (SELECT video, count(*) * 2 AS nf FROM sp GROUP BY 1), s AS (SELECT sp.video, state, least(2 + 2 * m, nf - 1) AS lo, "
    "least(2 + 2 * m + 4, nf - 1) AS hi FROM sp JOIN n USING (video)) SELECT DISTINCT video, state, unnest(range(lo, hi)) AS frame FROM s",
)
def _(spark, d):
    path = state_paths(spark, d)
    n = path.groupBy("video").agg((F.count("*") * 2).alias("n_frames"))
    spans = WN.delta_spans(path, n, GEOM)
    return S.label_frames_union(spans, F.col("lo"), F.col("hi"))


@register(
    "label_frames_exact", ints="video state frame",
    sql=f"WITH {SP}, n AS (SELECT video, count(*) * 2 AS nf FROM sp GROUP BY 1), s AS (SELECT sp.video, state, nf, "
    "unnest(range(2 + 2 * m, 2 + 2 * m + 2)) AS frame FROM sp JOIN n USING (video)) SELECT video, state, frame FROM s WHERE frame >= 0 AND frame < nf",
)
def _(spark, d):
    path = state_paths(spark, d)
    n = path.groupBy("video").agg((F.count("*") * 2).alias("n_frames"))
    return S.label_frames_exact(path, GEOM.f0, GEOM.l, n)


@register(
    "verify_lengths", ints="video n_windows pose_count delta_count pose_ok delta_ok",
    sql=f"WITH {SP}, n AS (SELECT video, count(*) AS nw, count(*) * 2 AS nf FROM sp GROUP BY 1), c AS (SELECT video, nw AS n_windows, "
    "CASE WHEN nf >= 8 THEN 2 * ((nf - 8) // 4 + 1) ELSE 0 END AS pose_count FROM n), e AS (SELECT *, greatest(pose_count - 1, 0) AS delta_count FROM c) "
    "SELECT *, n_windows = pose_count AS pose_ok, n_windows = delta_count AS delta_ok FROM e",
)
def _(spark, d):
    path = state_paths(spark, d)
    n = path.groupBy("video").agg(F.count("*").alias("n_windows"))
    return WN.verify_lengths(n.select("video", (F.col("n_windows") * 2).alias("n_frames")), n, GEOM)


@register(
    "token_change_points", ints="clip_id t",
    sql=f"WITH {SP}, w AS (SELECT video, m AS t, count(*) OVER (PARTITION BY video) AS n, "
    + ", ".join(f"sum(CASE WHEN state = {c} THEN 1 ELSE 0 END) OVER b AS b{c}, sum(CASE WHEN state = {c} THEN 1 ELSE 0 END) OVER a AS a{c}" for c in range(5))
    + " FROM sp WINDOW b AS (PARTITION BY video ORDER BY m ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), "
    "a AS (PARTITION BY video ORDER BY m ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT video AS clip_id, t FROM w WHERE t >= 4 AND t < n - 4 AND "
    "list_position([b0, b1, b2, b3, b4], greatest(b0, b1, b2, b3, b4)) <> list_position([a0, a1, a2, a3, a4], greatest(a0, a1, a2, a3, a4))",
)
def _(spark, d):
    t = state_paths(spark, d).select(F.col("video").alias("clip_id"), F.lit(0).alias("layer"), F.col("m").alias("t"), F.col("state").alias("code"))
    return WN.token_change_points(t, 4)
