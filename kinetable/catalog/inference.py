"""Queries on group contrasts and splits over customers, orders and embeddings."""

from pyspark.sql import functions as F

from kinetable.catalog.registry import register
from kinetable.operators import inference as I
from kinetable.operators import splits as SPL
from kinetable.sources.tables import latents, subject_metrics, table

SM = (
    "oa AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t, avg(o_totalprice) AS a, max(o_totalprice) AS m FROM orders GROUP BY 1), "
    "cw AS (SELECT c_custkey AS entity, c_nationkey AS cohort, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS label, c_acctbal, n, t, a, m FROM customer LEFT JOIN oa ON o_custkey = c_custkey), "
    "sm AS (SELECT entity, cohort, label, 'acctbal' AS metric, c_acctbal AS value FROM cw UNION ALL SELECT entity, cohort, label, 'n_orders', CAST(n AS DOUBLE) FROM cw UNION ALL "
    "SELECT entity, cohort, label, 'total_price', t FROM cw UNION ALL SELECT entity, cohort, label, 'mean_price', a FROM cw UNION ALL SELECT entity, cohort, label, 'max_price', m FROM cw)"
)


def u01(*parts):
    """The seeded uniform of kinetable.functions.scalar in SQL."""
    return "(CAST('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 13) AS BIGINT) / 4503599627370496.0)"


def auc_sql(src, keys, out, value="value", label="label"):
    k = ", ".join(keys)
    return (
        f"{out}_r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY {k}, {value}) - 1) / 2.0 AS rk FROM {src} WHERE {value} IS NOT NULL WINDOW w AS (PARTITION BY {k} ORDER BY {value})), "
        f"{out}_a AS (SELECT {k}, sum({label}) AS n_pos, count(*) - sum({label}) AS n_neg, sum(rk * {label}) AS rs FROM {out}_r GROUP BY {k}), "
        f"{out} AS (SELECT {k}, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN rs - n_pos * (n_pos + 1) / 2.0 END AS u, "
        f"CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END AS auc FROM {out}_a)"
    )


@register("rank_sum_auc", ints="n_pos n_neg", texts="metric", doubles="u auc rank_biserial",
          sql=f"WITH {SM}, {auc_sql('sm', ['metric'], 'au')} SELECT *, 2 * auc - 1 AS rank_biserial FROM au")
def _(spark, d):
    return I.auc_table(subject_metrics(spark, d), ["metric"])


@register("rank_sum_auc_by_cohort", ints="cohort n_pos n_neg", texts="metric", doubles="u auc",
          sql=f"WITH {SM}, {auc_sql('sm', ['cohort', 'metric'], 'au')} SELECT * FROM au")
def _(spark, d):
    return I.auc_table(subject_metrics(spark, d), ["cohort", "metric"])


PERM = 200_000


@register(
    "rank_sum_permutation_p", ints="n_pos n_neg", texts="metric", doubles="auc p",
    sql=f"WITH {SM}, {auc_sql('sm', ['metric'], 'au')}, dr AS (SELECT s.*, draw, {u01(chr(39) + '0' + chr(39), 'draw', 'entity')} AS un FROM sm s, (SELECT unnest(range(1, {PERM + 1})) AS draw) WHERE value IS NOT NULL), "
    "pk AS (SELECT d.metric, draw, value, CASE WHEN row_number() OVER (PARTITION BY d.metric, draw ORDER BY un, entity) <= n_pos THEN 1 ELSE 0 END AS lab FROM dr d JOIN au USING (metric)), "
    f"{auc_sql('pk', ['metric', 'draw'], 'nu', label='lab')} SELECT au.metric, any_value(au.n_pos) AS n_pos, any_value(au.n_neg) AS n_neg, any_value(au.auc) AS auc, "
    f"(1 + sum(CASE WHEN abs(nu.auc - 0.5) >= abs(au.auc - 0.5) - 1e-12 THEN 1 ELSE 0 END)) / {PERM + 1}.0 AS p FROM au JOIN nu USING (metric) GROUP BY 1",
)
def _(spark, d):
    return I.rank_sum_test(subject_metrics(spark, d), ["metric"], ["entity"], draws=PERM, method="permutation")


@register("rank_sum_exact_p", ints="grp n_pos n_neg", texts="metric method", doubles="auc p")
def _(spark, d):
    m = subject_metrics(spark, d).withColumn("grp", F.col("entity") % 150)
    return I.rank_sum_test(m, ["grp", "metric"], ["entity"], method="exact")


COR = "cp AS (SELECT * FROM (VALUES ('acctbal', 'n_orders'), ('mean_price', 'max_price'), ('n_orders', 'total_price')) AS p(endpoint_a, endpoint_b)), ab AS (SELECT endpoint_a, endpoint_b, x.value AS a, y.value AS b FROM cp JOIN sm x ON x.metric = endpoint_a JOIN sm y ON y.metric = endpoint_b AND y.entity = x.entity WHERE x.value IS NOT NULL AND y.value IS NOT NULL), rk AS (SELECT *, rank() OVER (PARTITION BY endpoint_a, endpoint_b ORDER BY a) + (count(*) OVER (PARTITION BY endpoint_a, endpoint_b, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY endpoint_a, endpoint_b ORDER BY b) + (count(*) OVER (PARTITION BY endpoint_a, endpoint_b, b) - 1) / 2.0 AS rb FROM ab)"
PAIRS = [("acctbal", "n_orders"), ("mean_price", "max_price"), ("n_orders", "total_price")]


def _endpoints(spark, d):
    return subject_metrics(spark, d).select(F.col("entity").alias("video"), F.col("metric").alias("endpoint"), "value", "label")


@register("correlation_table", ints="n", texts="endpoint_a endpoint_b", doubles="pearson spearman",
          sql=f"WITH {SM}, {COR} SELECT endpoint_a, endpoint_b, count(*) AS n, corr(a, b) AS pearson, corr(ra, rb) AS spearman FROM rk GROUP BY 1, 2")
def _(spark, d):
    return I.correlation_table(_endpoints(spark, d).drop("label"), PAIRS)


@register("correlation_p_values", texts="endpoint_a endpoint_b", doubles="pearson_p spearman_p")
def _(spark, d):
    return I.correlation_table(_endpoints(spark, d).drop("label"), PAIRS)


@register("replication_join", ints="n", texts="endpoint", doubles="spearman",
          sql=f"WITH {SM}, j AS (SELECT metric AS endpoint, value AS a, value * (1 + sin(entity)) AS b FROM sm WHERE value IS NOT NULL), rk AS (SELECT *, rank() OVER (PARTITION BY endpoint ORDER BY a) + "
          "(count(*) OVER (PARTITION BY endpoint, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY endpoint ORDER BY b) + (count(*) OVER (PARTITION BY endpoint, b) - 1) / 2.0 AS rb FROM j) "
          "SELECT endpoint, count(*) AS n, corr(ra, rb) AS spearman FROM rk GROUP BY 1")
def _(spark, d):
    e = _endpoints(spark, d).drop("label")
    return I.replication(e, e.withColumn("value", F.col("value") * (1 + F.sin("video"))))


@register(
    "clinical_test", ints="n_pos n_neg", texts="metric direction", doubles="u auc median_pos median_neg loo_auc_min loo_auc_max",
    sql=f"WITH {SM}, {auc_sql('sm', ['metric'], 'au')}, md AS (SELECT metric, quantile_cont(CASE WHEN label = 1 THEN value END, 0.5) AS median_pos, quantile_cont(CASE WHEN label = 0 THEN value END, 0.5) AS median_neg FROM sm GROUP BY 1), "
    "ct AS (SELECT a.metric, a.label, a.entity, sum(CASE WHEN b.value < a.value THEN 1.0 WHEN b.value = a.value THEN 0.5 ELSE 0 END) AS lo, sum(CASE WHEN b.value > a.value THEN 1.0 WHEN b.value = a.value THEN 0.5 ELSE 0 END) AS hi "
    "FROM sm a JOIN sm b ON a.metric = b.metric AND a.label <> b.label WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2, 3), "
    "lo AS (SELECT metric, CASE WHEN label = 1 THEN (u - lo) / ((n_pos - 1) * n_neg) ELSE (u - hi) / (n_pos * (n_neg - 1)) END AS a FROM ct JOIN au USING (metric)) "
    "SELECT au.metric, any_value(n_pos) AS n_pos, any_value(n_neg) AS n_neg, any_value(u) AS u, any_value(auc) AS auc, any_value(median_pos) AS median_pos, any_value(median_neg) AS median_neg, "
    "min(a) AS loo_auc_min, max(a) AS loo_auc_max, CASE WHEN any_value(auc) > 0.5 THEN 'abnormal>normal' ELSE 'normal>abnormal' END AS direction FROM au JOIN md USING (metric) JOIN lo USING (metric) GROUP BY 1",
)
def _(spark, d):
    return I.clinical_test(subject_metrics(spark, d), ["metric"])


@register("clinical_test_p", texts="metric", doubles="p")
def _(spark, d):
    return I.clinical_test(subject_metrics(spark, d), ["metric"])


_LEFT = (
    "ct AS (SELECT a.metric, a.label, a.entity, any_value(a.value) AS value, sum(CASE WHEN b.value < a.value THEN 1.0 WHEN b.value = a.value THEN 0.5 ELSE 0 END) AS lo, sum(CASE WHEN b.value > a.value THEN 1.0 WHEN b.value = a.value THEN 0.5 ELSE 0 END) AS hi "
    "FROM sm a JOIN sm b ON a.metric = b.metric AND a.label <> b.label WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2, 3), "
    "tc AS (SELECT metric, value, count(*)::DOUBLE AS c FROM sm WHERE value IS NOT NULL GROUP BY 1, 2), ts AS (SELECT metric, sum(c * c * c - c) AS tie FROM tc GROUP BY 1), "
    "lf AS (SELECT ct.metric, CASE WHEN label = 1 THEN u - lo ELSE u - hi END AS u, n_pos - label AS i, n_neg - 1 + label AS j, tie - (c * c * c - c) + (pow(c - 1, 3) - (c - 1)) AS tie FROM ct JOIN au USING (metric) JOIN tc ON tc.metric = ct.metric AND tc.value = ct.value JOIN ts ON ts.metric = ct.metric), "
    "zz AS (SELECT metric, (abs(u - i * j / 2.0) - 0.5) / sqrt(i * j / 12.0 * (i + j + 1 - tie / ((i + j) * (i + j - 1)))) AS z FROM lf)"
)


@register("leave_one_out_z", ints="n_left_out", texts="metric", doubles="z_min z_max",
          sql=f"WITH {SM}, {auc_sql('sm', ['metric'], 'au')}, {_LEFT} SELECT metric, count(*) AS n_left_out, min(z) AS z_min, max(z) AS z_max FROM zz GROUP BY 1")
def _(spark, d):
    return I.leave_one_out_p(subject_metrics(spark, d), ["metric"], "asymptotic")


@register("leave_one_out_p", texts="metric", doubles="loo_p_min loo_p_max")
def _(spark, d):
    return I.leave_one_out_p(subject_metrics(spark, d), ["metric"], "asymptotic")


@register("screening_auc", ints="n_pos n_neg", texts="metric", doubles="auc",
          sql=f"WITH {SM}, ng AS (SELECT metric, -value AS value, label FROM sm), {auc_sql('ng', ['metric'], 'au')} SELECT metric, n_pos, n_neg, auc FROM au")
def _(spark, d):
    return I.screening_auc(subject_metrics(spark, d), ["metric"], "value")


PV = "pv AS (SELECT cohort, CASE WHEN avg(label) < 0.15 THEN NULL ELSE avg(label) * 0.1 END AS p FROM cw GROUP BY 1)"


def _pvalues(spark, d):
    c = table(spark, d, "customer")
    share = F.avg(F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0))
    return c.groupBy(F.col("c_nationkey").alias("cohort")).agg(F.when(share < 0.15, None).otherwise(share * 0.1).alias("p"))


@register("holm", ints="cohort", doubles="p p_holm",
          sql=f"WITH {SM}, {PV}, h AS (SELECT cohort, p, least(1.0, (count(p) OVER () - row_number() OVER (ORDER BY p) + 1) * p) AS st, row_number() OVER (ORDER BY p) AS r FROM pv WHERE p IS NOT NULL) "
          "SELECT cohort, p, max(st) OVER (ORDER BY r) AS p_holm FROM h UNION ALL SELECT cohort, NULL, NULL FROM pv WHERE p IS NULL")
def _(spark, d):
    return I.holm(_pvalues(spark, d))


@register("bonferroni", ints="cohort significant", doubles="p p_bonferroni",
          sql=f"WITH {SM}, {PV} SELECT cohort, p, CASE WHEN p IS NOT NULL THEN least(p * 25, 1.0) END AS p_bonferroni, coalesce(p * 25 < 0.05, false) AS significant FROM pv")
def _(spark, d):
    return I.bonferroni(_pvalues(spark, d), 25)


@register("verdict", ints="n_metrics", texts="verdict",
          sql=f"WITH {SM}, {PV} SELECT CASE WHEN count(*) > 0 THEN 'GO' ELSE 'NO-GO' END AS verdict, count(*) AS n_metrics FROM pv WHERE p * 2 < 0.05")
def _(spark, d):
    t = I.bonferroni(_pvalues(spark, d).withColumn("metric", F.col("cohort").cast("string")), 2)
    return I.verdict(t).select("verdict", F.size("metrics").alias("n_metrics"))


BOOT = 10_000


@register(
    "bootstrap_auc_ci", ints="n_pos n_neg", texts="metric", doubles="auc low high se",
    sql=f"WITH {SM}, v AS (SELECT * FROM sm WHERE value IS NOT NULL), hu AS (SELECT *, {u01(chr(39) + '0' + chr(39), 'metric', 'label', 'entity')} AS un FROM v), "
    "ps AS (SELECT *, row_number() OVER (PARTITION BY metric, label ORDER BY un, entity) - 1 AS pos, count(*) OVER (PARTITION BY metric, label) AS n FROM hu), "
    f"sl AS (SELECT metric, label, rep, CAST(floor({u01(chr(39) + '1' + chr(39), 'metric', 'label', 'rep', 'pos')} * n) AS BIGINT) AS pos FROM ps, (SELECT unnest(range(1, {BOOT + 1})) AS rep)), "
    "bs AS (SELECT sl.metric, sl.label, rep, value FROM sl JOIN ps USING (metric, label, pos)), "
    f"{auc_sql('bs', ['metric', 'rep'], 'ba')}, {auc_sql('sm', ['metric'], 'au')} "
    "SELECT au.metric, any_value(au.n_pos) AS n_pos, any_value(au.n_neg) AS n_neg, any_value(au.auc) AS auc, quantile_cont(ba.auc, 0.025) AS low, quantile_cont(ba.auc, 0.975) AS high, stddev_samp(ba.auc) AS se "
    "FROM au JOIN ba USING (metric) GROUP BY 1",
)
def _(spark, d):
    return I.bootstrap_auc_ci(subject_metrics(spark, d), ["metric"], ["entity"], reps=BOOT)


def _resampled(keys, ids, reps, src, seed=0):
    """SQL of plans.draws.resample_weights: table rw with the row's columns and weight."""
    k = ", ".join(keys)
    q = chr(39)
    return (
        f"rh AS (SELECT *, {u01(q + str(seed) + q, *keys, *ids)} AS un FROM {src}), rp AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY un, {', '.join(ids)}) - 1 AS pos, count(*) OVER (PARTITION BY {k}) AS n FROM rh), "
        f"rs AS (SELECT {k}, rep, CAST(floor({u01(q + str(seed + 1) + q, *keys, 'rep', 'pos')} * n) AS BIGINT) AS pos FROM rp, (SELECT unnest(range(1, {reps + 1})) AS rep)), "
        f"rw AS (SELECT rp.*, rep FROM rs JOIN rp USING ({k}, pos))"
    )


@register(
    "bootstrap_mean", ints="rep", doubles="mean_value",
    sql=f"WITH src AS (SELECT c_custkey AS id, c_acctbal AS value, 0 AS g FROM customer), {_resampled(['g'], ['id'], 30, 'src')} SELECT rep, avg(value) AS mean_value FROM rw GROUP BY 1",
)
def _(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return I.bootstrap(rows, ["id"], lambda x, by: x.groupBy(*by).agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean_value")), 30)


@register(
    "block_bootstrap", doubles="point low high",
    sql=f"WITH src AS (SELECT CAST(date_diff('day', TIMESTAMP '1970-01-01', ts) AS BIGINT) AS block, sum(value) AS s, count(value) AS n0, 0 AS g FROM events GROUP BY 1), {_resampled(['g'], ['block'], 100, 'src')}, "
    "m AS (SELECT rep, sum(s) / sum(n0) AS m FROM rw GROUP BY 1) SELECT (SELECT sum(s) / sum(n0) FROM src) AS point, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m",
)
def _(spark, d):
    e = table(spark, d, "events").select(F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("block"), "value")
    return I.block_bootstrap(e, "block", "value", reps=100)


@register(
    "moving_block_bootstrap", ints="video m source_m state",
    sql="WITH " + __import__("kinetable.catalog.sqltext", fromlist=["SP"]).SP + f", n AS (SELECT video, max(m) + 1 AS n FROM sp GROUP BY 1), b AS (SELECT video, n, unnest(range(0, CAST(ceil(n / 8.0) AS BIGINT))) AS b FROM n), "
    f"s AS (SELECT *, CASE WHEN n <= 8 THEN 0 ELSE CAST(floor({u01(chr(39) + '0' + chr(39), 'video', chr(39) + '1' + chr(39), 'b')} * (n - 7)) AS BIGINT) END AS s FROM b), "
    "t AS (SELECT video, b * 8 + o AS m, s + o AS source_m, n FROM s, (SELECT unnest(range(0, 8)) AS o)) SELECT t.video, t.m, t.source_m, sp.state FROM t JOIN sp ON sp.video = t.video AND sp.m = t.source_m WHERE t.m < t.n",
)
def _(spark, d):
    from kinetable.sources.tables import state_paths

    return I.moving_block_bootstrap(state_paths(spark, d), 8)


@register(
    "permutation_two_groups", doubles="observed p_value",
    sql="WITH e AS (SELECT event_id, CAST(date_diff('day', TIMESTAMP '1970-01-01', ts) AS BIGINT) AS block, value, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS f FROM events WHERE event_type IN ('click', 'view')), "
    f"k AS (SELECT *, sum(f) OVER (PARTITION BY block) AS k FROM e), d AS (SELECT *, {u01(chr(39) + '0' + chr(39), 'draw', 'event_id')} AS un FROM k, (SELECT unnest(range(1, 40)) AS draw)), "
    "p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY block, draw ORDER BY un, event_id) <= k THEN 1 ELSE 0 END AS lab FROM d), "
    "nl AS (SELECT draw, avg(CASE WHEN lab = 1 THEN value END) - avg(CASE WHEN lab = 0 THEN value END) AS t FROM p GROUP BY 1), ob AS (SELECT avg(CASE WHEN f = 1 THEN value END) - avg(CASE WHEN f = 0 THEN value END) AS observed FROM e) "
    "SELECT any_value(observed) AS observed, (1 + sum(CASE WHEN abs(t) >= abs(observed) THEN 1 ELSE 0 END)) / 40.0 AS p_value FROM nl, ob",
)
def _(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    e = e.select("event_id", "event_type", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("block"), "value")
    return I.permutation_two_groups(e, ["event_id"], "event_type", "block", "value", draws=39)


def _maxstat_sql(stat):
    if stat == "auc":
        obs, nul = auc_sql("v", ["metric"], "o"), auc_sql("pj", ["metric", "draw"], "nn", label="lab")
        ot, nt = "o2 AS (SELECT metric, auc - 0.5 AS t FROM o)", "n2 AS (SELECT metric, draw, auc - 0.5 AS t FROM nn)"
    else:
        obs, nul = "o AS (SELECT 1 AS one)", "nn AS (SELECT 1 AS one)"
        md = "quantile_cont(CASE WHEN {l} = 1 THEN value END, 0.5) - quantile_cont(CASE WHEN {l} = 0 THEN value END, 0.5) AS t"
        ot = f"o2 AS (SELECT metric, {md.format(l='label')} FROM v GROUP BY 1)"
        nt = f"n2 AS (SELECT metric, draw, {md.format(l='lab')} FROM pj GROUP BY 1, 2)"
    return (
        f"WITH {SM}, v AS (SELECT entity, label, metric, value FROM sm WHERE metric IN ('acctbal', 'mean_price', 'max_price')), pe AS (SELECT DISTINCT entity, label FROM v), "
        f"dr AS (SELECT entity, draw, {u01(chr(39) + '0' + chr(39), 'draw', 'entity')} AS un FROM pe, (SELECT unnest(range(1, 20)) AS draw)), "
        "pl AS (SELECT entity, draw, CASE WHEN row_number() OVER (PARTITION BY draw ORDER BY un, entity) <= (SELECT sum(label) FROM pe) THEN 1 ELSE 0 END AS lab FROM dr), "
        f"pj AS (SELECT v.metric, v.value, draw, lab FROM v JOIN pl USING (entity)), {obs}, {nul}, {ot}, {nt}, tp AS (SELECT draw, max(abs(t)) AS top FROM n2 GROUP BY 1) "
        "SELECT o2.metric, any_value(o2.t) AS observed, (1 + sum(CASE WHEN top >= abs(o2.t) THEN 1 ELSE 0 END)) / 20.0 AS p_corrected, (1 + sum(CASE WHEN abs(n2.t) >= abs(o2.t) THEN 1 ELSE 0 END)) / 20.0 AS p_uncorrected "
        "FROM o2 JOIN n2 USING (metric) JOIN tp USING (draw) GROUP BY 1"
    )


def _maxstat(spark, d, stat):
    m = subject_metrics(spark, d).where(F.col("metric").isin("acctbal", "mean_price", "max_price"))
    m = m.select(F.col("entity").alias("video"), "metric", "value", "label")
    return I.maxstat_permutation(m, "metric", stat, draws=19)


@register("maxstat_permutation_median", texts="metric", doubles="observed p_corrected p_uncorrected", sql=_maxstat_sql("median_diff"))
def _(spark, d):
    return _maxstat(spark, d, "median_diff")


@register("maxstat_permutation_auc", texts="metric", doubles="observed p_corrected p_uncorrected", sql=_maxstat_sql("auc"))
def _(spark, d):
    return _maxstat(spark, d, "auc")


@register("mixed_model", ints="n n_subjects significant", texts="metric", doubles="coef p p_bonferroni")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("subject_id"), "c_mktsegment", "c_acctbal")
    o = table(spark, d, "orders").join(c, "o_custkey").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("subject_id"), F.col("n_regionkey").alias("cohort")), "subject_id")
    long = o.select("subject_id", "cohort", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("clinical"), F.col("o_totalprice").alias("price"), "c_acctbal")
    long = long.unpivot(["subject_id", "cohort", "clinical"], ["price", "c_acctbal"], "metric", "value")
    return I.mixed_model(long, ["price", "c_acctbal"], "clinical", ["cohort"])


@register("endpoint_summary", ints="n_scored n_abnormal n_positive", texts="endpoint", doubles="min_value max_value median_all median_normal median_abnormal median_difference",
          sql=f"WITH {SM} SELECT metric AS endpoint, count(value) AS n_scored, count(CASE WHEN label = 1 THEN value END) AS n_abnormal, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS n_positive, min(value) AS min_value, max(value) AS max_value, "
          "quantile_cont(value, 0.5) AS median_all, quantile_cont(CASE WHEN label = 0 THEN value END, 0.5) AS median_normal, quantile_cont(CASE WHEN label = 1 THEN value END, 0.5) AS median_abnormal, "
          "quantile_cont(CASE WHEN label = 1 THEN value END, 0.5) - quantile_cont(CASE WHEN label = 0 THEN value END, 0.5) AS median_difference FROM sm GROUP BY 1")
def _(spark, d):
    from kinetable.operators.quality import endpoint_summary

    e = _endpoints(spark, d)
    return endpoint_summary(e.drop("label"), e.select("video", "label").distinct())


Q0 = chr(39) + "0" + chr(39)


@register("subject_holdout", ints="c_nationkey n_rows", texts="role",
          sql=f"WITH g AS (SELECT c_nationkey, {u01(Q0, 'c_nationkey')} AS un, count(*) AS n_rows FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY un, c_nationkey) AS rn, count(*) OVER () AS n FROM g) "
          "SELECT c_nationkey, n_rows, CASE WHEN rn <= greatest(1, least(round_even(n * 0.2, 0), n - 1)) THEN 'val' ELSE 'train' END AS role FROM r")
def _(spark, d):
    return SPL.subject_holdout(table(spark, d, "customer"), "c_nationkey", 0.2).groupBy("c_nationkey", "role").agg(F.count("*").alias("n_rows"))


@register("leave_one_group_out", ints="fold cohort entity", sql="SELECT c_custkey AS entity, c_nationkey AS cohort, dense_rank() OVER (ORDER BY c_nationkey) - 1 AS fold FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("cohort"))
    return SPL.leave_one_group_out(c, "cohort")


@register("leave_one_group_out_within", ints="fold cohort", texts="c_mktsegment",
          sql="SELECT DISTINCT c_nationkey AS cohort, c_mktsegment, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS fold FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("cohort"), "c_mktsegment")
    return SPL.leave_one_group_out(c, "c_mktsegment", "cohort").distinct()


@register("kfold_groups", ints="cohort fold", sql=f"WITH g AS (SELECT DISTINCT c_nationkey AS cohort FROM customer), h AS (SELECT cohort, {u01(Q0, chr(39) + '0' + chr(39), 'cohort')} AS un FROM g) SELECT cohort, ntile(4) OVER (ORDER BY un, cohort) - 1 AS fold FROM h")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("cohort"))
    return SPL.kfold_groups(c, "cohort", 4).distinct()


@register(
    "balanced_subset", ints="cohort subject walk",
    sql=f"WITH w AS (SELECT n_regionkey AS cohort, o_custkey AS subject, o_orderkey AS walk, {u01(Q0, 'o_orderkey')} AS un FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), "
    "o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cohort, subject ORDER BY un, walk) AS r FROM w) WHERE r = 1), "
    "c AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY un, walk) AS r2 FROM o) SELECT cohort, subject, walk FROM c WHERE r2 <= (SELECT min(n) FROM (SELECT count(*) AS n FROM o GROUP BY cohort))",
)
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("cohort"))
    c = table(spark, d, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "cohort")
    w = table(spark, d, "orders").join(c, "o_custkey").select("cohort", F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("walk"))
    return SPL.balanced_subset(w, "subject", "cohort", "walk")


@register("random_row_split", ints="n_rows", texts="role", sql="SELECT 'val' AS role, CAST(round_even(count(*) * 0.15, 0) AS BIGINT) AS n_rows FROM orders UNION ALL SELECT 'train', count(*) - CAST(round_even(count(*) * 0.15, 0) AS BIGINT) FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return SPL.random_row_split(o, ["o_orderkey"], 0.15).groupBy("role").agg(F.count("*").alias("n_rows"))


PP = (
    f"WITH h AS (SELECT vec_id, label, embedding, {u01(Q0, chr(39) + '0' + chr(39), 'vec_id')} AS un FROM embeddings), p AS (SELECT *, row_number() OVER (ORDER BY un, vec_id) - 1 AS i, count(*) OVER () AS n FROM h), "
    f"c AS (SELECT id, CAST(floor({u01(chr(39) + '1' + chr(39), 'id')} * n) AS BIGINT) AS ia, CAST(floor({u01(chr(39) + '2' + chr(39), 'id')} * n) AS BIGINT) AS ib FROM (SELECT unnest(range(0, 300)) AS id), (SELECT count(*) AS n FROM embeddings)), "
    "q AS (SELECT DISTINCT least(a.vec_id, b.vec_id) AS clip_a, greatest(a.vec_id, b.vec_id) AS clip_b, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS distance "
    "FROM c JOIN p a ON a.i = ia JOIN p b ON b.i = ib WHERE a.label <> b.label)"
)


@register("pick_pairs", ints="clip_a clip_b", doubles="distance", sql=f"{PP} SELECT * FROM q")
def _(spark, d):
    return SPL.pick_pairs(latents(spark, d), 300)


@register("pick_pairs_spread", ints="clip_a clip_b", doubles="distance",
          sql=f"{PP}, o AS (SELECT *, row_number() OVER (ORDER BY distance, clip_a, clip_b) - 1 AS i, count(*) OVER () AS n FROM q), w AS (SELECT DISTINCT round_even(k * (n - 1) / 9.0, 0) AS i FROM (SELECT unnest(range(0, 10)) AS k), (SELECT count(*) AS n FROM q)) "
          "SELECT clip_a, clip_b, distance FROM o WHERE i IN (SELECT i FROM w)")
def _(spark, d):
    return SPL.spread_pairs(SPL.pick_pairs(latents(spark, d), 300), 10)


@register("pick_pairs_extreme", ints="clip_a clip_b", texts="choice", doubles="distance",
          sql=f"{PP}, o AS (SELECT *, row_number() OVER (ORDER BY distance, clip_a, clip_b) - 1 AS i, count(*) OVER () AS n FROM q) SELECT 'median' AS choice, clip_a, clip_b, distance FROM o WHERE i = n // 2 "
          "UNION ALL SELECT * FROM (SELECT 'farthest', clip_a, clip_b, distance FROM q ORDER BY distance DESC, clip_a, clip_b LIMIT 1)")
def _(spark, d):
    p = SPL.pick_pairs(latents(spark, d), 300)
    return SPL.extreme_pair(p, "median").withColumn("choice", F.lit("median")).unionByName(SPL.extreme_pair(p, "farthest").withColumn("choice", F.lit("farthest")))
