"""Queries on reading, labels, runs, masks, chains and excess similarity."""

from pyspark.sql import functions as F

from kinetable.catalog.inference import Q0, u01
from kinetable.catalog.motion import LIMBS, MBASE, SIMS, SHORT, moments, pose, JS
from kinetable.catalog.paths import K, SIM_SQL, similarity_from_counts
from kinetable.catalog.registry import register
from kinetable.catalog.sqltext import CODE, KP, PATHS, POSES, SP, VEL
from kinetable.operators import chain as C
from kinetable.operators import excess as X
from kinetable.operators import masks as MK
from kinetable.operators import similarity as SM
from kinetable.operators import states as S
from kinetable.operators import frames as FR
from kinetable.sources import keypoint_tables as KT
from kinetable.sources.skeletons import SKELETONS, groups_dimension, joints_dimension, skeleton_for
from kinetable.sources.tables import event_code, keypoints, state_paths, table

RAW = (
    f"raw AS (SELECT CAST(user_id AS VARCHAR) AS video, CAST(day(ts) - 1 AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '.0' ELSE '' END AS frame, "
    f"CASE WHEN event_id % 97 = 0 THEN 'x' ELSE CAST({CODE} AS VARCHAR) END AS part_idx, CASE WHEN event_id % 11 = 0 THEN 'NaN' WHEN event_id % 13 = 0 THEN '' ELSE CAST(value AS VARCHAR) END AS x, "
    "json_extract_string(props, '$.k') AS y, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE '25' END AS fps, event_id AS ord FROM events), "
    "pk AS (SELECT video, CAST(trunc(CAST(frame AS DOUBLE)) AS BIGINT) AS frame, TRY_CAST(part_idx AS BIGINT) AS joint, CASE WHEN lower(x) IN ('', 'nan') THEN NULL ELSE CAST(x AS DOUBLE) END AS x, CAST(y AS DOUBLE) AS y, ord FROM raw), "
    "pc AS (SELECT video, frame, joint, arg_max(struct_pack(x := x, y := y), ord) AS v, min(ord) AS ord FROM pk WHERE joint IS NOT NULL GROUP BY 1, 2, 3)"
)


def raw_text(spark, d):
    """The events as the text rows a long keypoint CSV would hold, with odd spellings and bad cells."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    return e.select(
        F.col("user_id").cast("string").alias("video"), F.concat((F.dayofmonth("ts") - 1).cast("string"), F.when(i % 2 == 0, ".0").otherwise("")).alias("frame"),
        F.when(i % 97 == 0, "x").otherwise(event_code().cast("string")).alias("joint_no"),
        F.when(i % 11 == 0, "NaN").when(i % 13 == 0, "").otherwise(F.col("value").cast("string")).alias("x"),
        F.get_json_object("props", "$.k").alias("y"), F.when(i % 3 == 0, "none").otherwise("25").alias("fps"), i.alias("_ord"),
    )


COLMAP = {"part_idx": "joint_no"}


@register("read_keypoints", ints="video frame joint ord", doubles="x y", sql=f"WITH {RAW} SELECT video, frame, joint, v.x AS x, v.y AS y, ord FROM pc")
def _(spark, d):
    return KT.parse_keypoints(raw_text(spark, d), COLMAP)


@register("video_fps", ints="video", doubles="fps", sql=f"WITH {RAW} SELECT video, coalesce(quantile_cont(TRY_CAST(fps AS DOUBLE), 0.5), 0) AS fps FROM raw GROUP BY 1")
def _(spark, d):
    return KT.video_fps(raw_text(spark, d), COLMAP)


@register(
    "limit_videos", ints="video n_rows",
    sql=f"WITH {RAW}, v AS (SELECT video, min(ord) AS o, count(*) AS n_rows FROM pc GROUP BY 1 HAVING max(frame) - min(frame) + 1 >= 29) SELECT video, n_rows FROM v ORDER BY o LIMIT 40",
)
def _(spark, d):
    return KT.limit_videos(KT.parse_keypoints(raw_text(spark, d), COLMAP), 29, 40).groupBy("video").agg(F.count("*").alias("n_rows"))


NAMES = ["click", "purchase", "signup", "view", "scroll"]


@register("joint_set_difference", texts="name problem",
          sql="WITH need AS (SELECT unnest(['click', 'purchase', 'signup', 'view', 'scroll']) AS name), have AS (SELECT DISTINCT event_type AS name FROM events) "
          "SELECT name, 'missing' AS problem FROM need WHERE name NOT IN (SELECT name FROM have) UNION ALL SELECT name, 'unexpected' FROM have WHERE name NOT IN (SELECT name FROM need)")
def _(spark, d):
    return KT.check_joint_names(table(spark, d, "events"), NAMES, "event_type")


@register("read_keypoints_strict", ints="video frame joint", doubles="x y",
          sql=f"SELECT user_id AS video, day(ts) AS frame, {CODE} AS joint, value AS x, value * 2 AS y FROM events")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("video"), F.dayofmonth("ts").alias("frame"), F.col("event_type").alias("bp"), F.col("value").alias("x"), (F.col("value") * 2).alias("y"))
    return KT.parse_keypoints_strict(e, ["click", "error", "purchase", "signup", "view"])


@register("infer_joint_count", ints="n_joints", sql=f"WITH {KP} SELECT max(joint) + 1 AS n_joints FROM kp")
def _(spark, d):
    return keypoints(spark, d).agg((F.max("joint") + 1).alias("n_joints"))


REC = "rec AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '{\"UPDRS_GAIT\": ' || c_nationkey % 4 || '.4, \"medication\": \"On\", \"other\": {\"FoG\": \"yes\"}}' WHEN 1 THEN '{\"gait_score\": \"2.5\", \"med_state\": \"off\", \"freezer\": \"Non-Freezer\", \"gender\": \"F\"}' " \
    "WHEN 2 THEN '{\"updrs\": \"n/a\", \"on_off\": \"later\", \"fog\": \"maybe\", \"other\": {\"sex\": \"M\"}}' ELSE '{\"fps\": 30}' END AS record FROM customer)"


def records(spark, d):
    k = F.col("c_custkey") % 4
    one = F.concat(F.lit('{"UPDRS_GAIT": '), (F.col("c_nationkey") % 4).cast("string"), F.lit('.4, "medication": "On", "other": {"FoG": "yes"}}'))
    js = F.when(k == 0, one).when(k == 1, '{"gait_score": "2.5", "med_state": "off", "freezer": "Non-Freezer", "gender": "F"}').when(
        k == 2, '{"updrs": "n/a", "on_off": "later", "fog": "maybe", "other": {"sex": "M"}}'
    ).otherwise('{"fps": 30}')
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), js.alias("record"))


def _alias(names, nested):
    paths = [f"$.{n}" for n in names] + ([f"$.other.{n}" for n in names] if nested else [])
    return "coalesce(" + ", ".join(f"json_extract_string(record, '{p}')" for p in paths) + ")"


ALI = ", ".join(f"{_alias(KT.ALIASES[k], k in ('freezer', 'sex'))} AS {k}" for k in ("updrs_gait", "med", "freezer", "sex"))


@register("label_aliases", ints="id", texts="updrs_gait med freezer sex", sql=f"WITH {REC} SELECT id, {ALI} FROM rec")
def _(spark, d):
    return KT.extract_labels(records(spark, d))


@register(
    "normalise_label", ints="id updrs", texts="freezer_norm med_norm",
    sql=f"WITH {REC}, a AS (SELECT id, {ALI} FROM rec) SELECT id, round_even(TRY_CAST(updrs_gait AS DOUBLE), 0) AS updrs, CASE WHEN lower(freezer) IN ('freezer','fog','yes','y','true','1','1.0') THEN 'freezer' "
    "WHEN lower(freezer) IN ('non-freezer','nonfreezer','non_freezer','no','n','false','0','0.0') THEN 'non-freezer' ELSE lower(freezer) END AS freezer_norm, "
    "CASE WHEN lower(med) IN ('on','1','1.0','true') THEN 'ON' WHEN lower(med) IN ('off','0','0.0','false') THEN 'OFF' ELSE upper(med) END AS med_norm FROM a",
)
def _(spark, d):
    r = KT.extract_labels(records(spark, d))
    return r.select("id", KT.norm_updrs(F.col("updrs_gait")).alias("updrs"), KT.norm_freezer(F.col("freezer")).alias("freezer_norm"), KT.norm_med(F.col("med")).alias("med_norm"))


IV = (
    "iv AS (SELECT o_orderkey AS id, (o_custkey % 40) / 10.0 AS s, (o_custkey % 40) / 10.0 + (o_orderkey % 7) - 2.0 AS e, o_orderkey % 4 AS kind, CASE WHEN o_orderkey % 4 = 3 THEN 30.0 ELSE 1.0 END AS u FROM orders), "
    "ev AS (SELECT id, kind, least(s, e) AS a, greatest(s, e) AS b, greatest(s, e) * u AS hi, u, e * u AS eu FROM iv), "
    "fl AS (SELECT *, eu > 10.0 * 1.5 AND eu <= 300 * 1.5 AS fr FROM ev), "
    "cl AS (SELECT id, greatest(0, least(a * u * CASE WHEN fr THEN 1.0 / 30 ELSE 1 END, 10.0)) AS start_s, greatest(0, least(b * u * CASE WHEN fr THEN 1.0 / 30 ELSE 1 END, 10.0)) AS end_s FROM fl)"
)


@register("parse_event_intervals", ints="id", doubles="start_s end_s", sql=f"WITH {IV} SELECT * FROM cl WHERE end_s > start_s")
def _(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    s = (F.col("o_custkey") % 40) / 10.0
    e = s + (F.col("o_orderkey") % 7) - 2.0
    u = F.when(k == 3, 30.0).otherwise(1.0)
    st, en = (s * u).cast("string"), (e * u).cast("string")
    js = F.when(k == 0, F.concat(F.lit('{"fog_intervals": [['), st, F.lit(", "), en, F.lit("]]}"))).when(
        k == 1, F.concat(F.lit('{"FoG": ['), st, F.lit(", "), en, F.lit("]}"))
    ).when(k == 2, F.concat(F.lit('{"other": {"freezing": {"onset": ['), st, F.lit('], "offset": ['), en, F.lit("]}}}"))).otherwise(
        F.concat(F.lit('{"freezing_intervals": [['), st, F.lit(", "), en, F.lit("]]}"))
    )
    r = KT.parse_event_intervals(o.select(F.col("o_orderkey").alias("id"), js.alias("record")), "record", F.lit(30.0), F.lit(300))
    return r.select("id", F.inline("intervals"))


def order_spans(labels, fps, n_frames):
    """A caller's extractor: two spans from an order's numbers, one of them reversed, some outside the recording."""
    k, c = int(labels["key"]), int(labels["customer"])
    start = (c % 40) / 10.0 - 1.0
    return [(start, start + k % 7), (n_frames / fps - k % 5, 4.0)] if k % 9 else None


@register("hooked_intervals", ints="id", doubles="start_s end_s",
          sql="WITH o AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k7, o_orderkey % 5 AS k5, (o_custkey % 40) / 10.0 - 1.0 AS s FROM orders WHERE o_orderkey % 9 <> 0), "
          "p AS (SELECT id, s AS a, s + k7 AS b FROM o UNION ALL SELECT id, 10.0 - k5, 4.0 FROM o), "
          "c AS (SELECT id, least(greatest(least(a, b), 0), 10.0) AS start_s, least(greatest(greatest(a, b), 0), 10.0) AS end_s FROM p) SELECT * FROM c WHERE end_s > start_s")
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.create_map(F.lit("key"), F.col("o_orderkey").cast("string"), F.lit("customer"), F.col("o_custkey").cast("string")).alias("labels"), F.lit(30.0).alias("fps"), F.lit(300).alias("n_frames"),
    )
    return KT.hooked_intervals(o, order_spans, keep=["id"])


@register("labels_from_names", texts="video", ints="label", sql="SELECT c_name AS video, CASE WHEN c_custkey % 10000 IN (3, 77, 1200) THEN 1 ELSE 0 END AS label FROM customer")
def _(spark, d):
    # ids are the last four digits here, so the nine-digit names are cut to them first
    n = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.concat(F.lit("S"), F.substring("c_name", -4, 4).cast("int").cast("string")).alias("video"))
    return KT.labels_from_names(n, [3, 77, 1200]).select(F.col("name").alias("video"), "label")


@register("missing_positive_ids", texts="id", sql="SELECT id FROM (SELECT unnest(['0003', '0999', '8888']) AS id) WHERE CAST(id AS BIGINT) NOT IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    n = table(spark, d, "customer").select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("video"))
    return KT.missing_positive_ids(KT.labels_from_names(n, [3]), [3, 999, 8888])


@register("read_group_labels", ints="video label documented",
          sql="WITH l AS (SELECT doc_id AS video, toxic AS label FROM labels), p AS (SELECT doc_id AS video, 1 AS documented FROM labels WHERE toxic = 1 AND doc_id % 2 = 0 OR doc_id = 1) "
          "SELECT coalesce(l.video, p.video) AS video, label, coalesce(documented, 0) AS documented FROM l FULL JOIN p ON l.video = p.video WHERE coalesce(label, -1) <> coalesce(documented, 0)")
def _(spark, d):
    t = table(spark, d, "labels")
    return KT.label_conflicts(t.select(F.col("doc_id").alias("video"), F.col("toxic").alias("label")), t.where("toxic = 1 AND doc_id % 2 = 0 OR doc_id = 1").select(F.col("doc_id").alias("video")))


@register("attach_labels", ints="walk updrs",
          sql="SELECT o_orderkey AS walk, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 5 ELSE o_orderkey % 3 END AS updrs FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("subject"), F.col("o_orderkey").cast("string").alias("walk_id"), "o_custkey", "o_orderkey")
    full = o.where("o_custkey % 2 = 0").select(F.concat_ws("__", "subject", "walk_id").alias("key"), F.lit(0).alias("ord"), (F.col("o_custkey") % 5).alias("updrs"))
    only = o.select(F.col("walk_id").alias("key"), F.lit(1).alias("ord"), (F.col("o_orderkey") % 3).alias("updrs"))
    later = only.withColumns({"ord": F.lit(2), "updrs": F.lit(99).cast("long")})
    return KT.attach_labels(o.select("subject", "walk_id"), full.unionByName(only).unionByName(later), ["updrs"]).select(F.col("walk_id").alias("walk"), "updrs")


@register("cohort_vocabulary", ints="cohort_id n", texts="cohort", sql="SELECT c_mktsegment AS cohort, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 END AS cohort_id, count(*) AS n FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING') GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("cohort"))
    return FR.cohort_vocabulary(c, ["MACHINERY", "BUILDING"]).groupBy("cohort", "cohort_id").agg(F.count("*").alias("n"))


@register("split_walk_key", texts="subject walk_id", sql="SELECT CASE WHEN s % 2 = 0 THEN 'S' || s ELSE 'S' || s END AS subject, CASE WHEN s % 2 = 0 THEN 'w__' || p ELSE 'S' || s END AS walk_id FROM (SELECT l_suppkey AS s, l_partkey AS p FROM lineitem)")
def _(spark, d):
    l = table(spark, d, "lineitem")
    key = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit("__w__"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    subject, walk = KT.split_walk_key(key)
    return l.select(subject.alias("subject"), walk.alias("walk_id"))


@register("expand_lengths", ints="video m", sql=f"WITH {SP} SELECT video, m FROM sp")
def _(spark, d):
    p = state_paths(spark, d)
    return KT.expand_lengths(p.groupBy("video").agg(F.count("*").alias("length")))


@register("skeleton_groups", ints="joint n_rows", texts="body_group",
          sql=f"WITH {KP} SELECT CASE WHEN joint IN (1, 2) THEN 'arms' WHEN joint IN (3, 4) THEN 'legs' ELSE 'head' END AS body_group, joint, count(*) AS n_rows FROM kp GROUP BY 1, 2")
def _(spark, d):
    dim = groups_dimension(spark, {"head": [0], "arms": [1, 2], "legs": [3, 4]})
    return keypoints(spark, d).join(F.broadcast(dim), "joint").groupBy("body_group", "joint").agg(F.count("*").alias("n_rows"))


HIST = (
    "o AS (SELECT o_custkey AS run, o_totalprice AS loss, o_totalprice * (1 + o_orderkey % 3) AS rec, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"
)


@register(
    "summarize_runs", ints="run n_epochs val_loss_min_epoch val_rec_min_epoch", doubles="val_loss_min val_rec_min val_loss_final val_rec_final train_rec_final",
    sql=f"WITH {HIST} SELECT run, max(n) AS n_epochs, min(loss) AS val_loss_min, arg_min(i, (loss, i)) AS val_loss_min_epoch, min(rec) AS val_rec_min, arg_min(i, (rec, i)) AS val_rec_min_epoch, "
    "max(CASE WHEN i = n - 1 THEN loss END) AS val_loss_final, max(CASE WHEN i = n - 1 THEN rec END) AS val_rec_final, max(CASE WHEN i = n - 1 THEN rec END) AS train_rec_final FROM o GROUP BY 1",
)
def _(spark, d):
    o = table(spark, d, "orders")
    e = F.struct("o_orderdate", "o_orderkey", F.col("o_totalprice").alias("loss"), (F.col("o_totalprice") * (1 + F.col("o_orderkey") % 3)).alias("rec_full"))
    h = o.groupBy(F.col("o_custkey").alias("run")).agg(F.array_sort(F.collect_list(e)).alias("a"))
    val = F.transform("a", lambda x: F.struct(x["loss"].alias("loss"), x["rec_full"].alias("rec_full")))
    return KT.summarize_runs(h.select("run", val.alias("val"), val.alias("train")))


RUNS = (
    "rn AS (SELECT c_nationkey || '-' || c_mktsegment AS run, CASE WHEN c_nationkey % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, c_mktsegment AS architecture, avg(c_acctbal) AS metric "
    "FROM customer GROUP BY c_nationkey, c_mktsegment)"
)


def _runs(spark, d):
    """One run per nation and segment, scored over all its customers."""
    g = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("metric"))
    return g.select(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("run"), F.when(F.col("c_nationkey") % 7 == 0, "failed").otherwise("ok").alias("status"), F.col("c_mktsegment").alias("architecture"), "metric")


@register("rank_runs", ints="rank", texts="run status", sql=f"WITH {RUNS} SELECT run, status, row_number() OVER (ORDER BY CASE WHEN status = 'ok' THEN 0 ELSE 1 END, CASE WHEN status = 'ok' THEN metric END NULLS LAST, run) AS rank FROM rn")
def _(spark, d):
    return KT.rank_runs(_runs(spark, d), "metric")


@register("best_runs", texts="run architecture", doubles="metric", sql=f"WITH {RUNS} SELECT architecture, arg_min(run, (metric, run)) AS run, min(metric) AS metric FROM rn WHERE status = 'ok' GROUP BY 1")
def _(spark, d):
    return KT.best_runs(_runs(spark, d), "metric", "architecture")


@register("headline_table", ints="model", doubles="d_z n_active active_frac mig hmm_k total_correlation",
          sql="SELECT c_custkey AS model, 16.0 AS d_z, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS n_active, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey / 16.0 END AS active_frac, c_acctbal AS mig, NULL AS hmm_k, CASE WHEN c_custkey % 3 = 1 THEN 0.5 END AS total_correlation FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 3
    info = F.when(k == 0, F.lit('"encoder_geometry": {"d_z": 16}')).when(k == 1, F.concat(F.lit('"information": {"d_z": 16, "total_correlation": {"total_correlation": 0.5}, "n_active": '), F.col("c_nationkey").cast("string"), F.lit("}"))).otherwise(
        F.concat(F.lit('"information": {"d_z": 16, "n_active": '), F.col("c_nationkey").cast("string"), F.lit("}"))
    )
    js = F.concat(F.lit("{"), info, F.lit(', "disentanglement": {"mig": '), F.col("c_acctbal").cast("string"), F.lit("}}"))
    return KT.headline_table(c.select(F.col("c_custkey").alias("model"), js.alias("result")))


@register("mask_uniform", ints="video frame joint visible", sql=f"WITH {POSES} SELECT video, frame, joint, {u01(Q0, 'video', 'frame', 'joint')} > 0.3 AS visible FROM pose")
def _(spark, d):
    return MK.mask_uniform(pose(spark, d), 0.3)


MSP = "ms AS (SELECT video, joint, avg(sqrt(vx*vx+vy*vy) / 10.0) AS s FROM vel GROUP BY 1, 2)"


@register("mask_topk_speed", ints="video frame joint visible", sql=f"WITH {POSES}, {VEL}, {MSP}, h AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY s DESC, joint) > 2 AS visible FROM ms) SELECT p.video, p.frame, p.joint, visible FROM pose p JOIN h USING (video, joint)")
def _(spark, d):
    return MK.mask_topk_speed(pose(spark, d), 5, 0.45)


@register("mask_softmax_speed", ints="video frame joint visible",
          sql=f"WITH {POSES}, {VEL}, {MSP}, g AS (SELECT *, s / 5.0 - ln(-ln(greatest({u01(Q0, 'video', 'joint')}, 1e-12))) AS sc FROM ms), h AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY sc DESC, joint) > 2 AS visible FROM g) SELECT p.video, p.frame, p.joint, visible FROM pose p JOIN h USING (video, joint)")
def _(spark, d):
    return MK.mask_softmax_speed(pose(spark, d), 5, 0.45, 5.0)


SWAY = "pose AS (SELECT video, frame, joint, x + sin(joint + frame) AS x, y + cos(joint * frame) AS y FROM pose0)"


@register("mask_per_frame_speed", ints="video frame joint visible",
          sql=f"WITH {POSES.replace('pose AS (', 'pose0 AS (')}, {SWAY}, s AS (SELECT video, frame, joint, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS s, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS b FROM pose WINDOW w AS (PARTITION BY video, joint ORDER BY frame)) "
          "SELECT video, frame, joint, row_number() OVER (PARTITION BY video, frame ORDER BY coalesce(s, b) DESC, joint) > 2 AS visible FROM s")
def _(spark, d):
    p = pose(spark, d).withColumns({"x": F.col("x") + F.sin(F.col("joint") + F.col("frame")), "y": F.col("y") + F.cos(F.col("joint") * F.col("frame"))})
    return MK.mask_per_frame_speed(p, 5, 0.45)


@register("mask_limb", ints="video frame joint visible", texts="limb",
          sql=f"WITH {POSES}, c AS (SELECT DISTINCT video, {u01(Q0, 'video')} AS u FROM pose), l AS (SELECT video, CASE WHEN u < 0.25 THEN 'left_arm' WHEN u < 0.5 THEN 'right_arm' WHEN u < 0.75 THEN 'left_leg' ELSE 'right_leg' END AS limb FROM c) "
          "SELECT p.video, frame, joint, limb, NOT ((limb = 'left_arm' AND joint = 1) OR (limb = 'right_arm' AND joint = 2) OR (limb = 'left_leg' AND joint = 3) OR (limb = 'right_leg' AND joint = 4)) AS visible FROM pose p JOIN l USING (video)")
def _(spark, d):
    return MK.mask_limb(pose(spark, d), LIMBS)


@register("mask_limb_weighted", ints="video frame joint visible", texts="limb",
          sql=f"WITH {POSES}, {VEL}, {MSP}, w AS (SELECT video, max(CASE WHEN joint = 1 THEN s END) AS w1, max(CASE WHEN joint = 2 THEN s END) AS w2, max(CASE WHEN joint = 3 THEN s END) AS w3, max(CASE WHEN joint = 4 THEN s END) AS w4, {u01(Q0, 'video')} AS u FROM ms GROUP BY video), "
          "l AS (SELECT video, CASE WHEN u < w1 / (w1+w2+w3+w4) THEN 'left_arm' WHEN u < (w1+w2) / (w1+w2+w3+w4) THEN 'right_arm' WHEN u < (w1+w2+w3) / (w1+w2+w3+w4) THEN 'left_leg' ELSE 'right_leg' END AS limb FROM w) "
          "SELECT p.video, frame, joint, limb, NOT ((limb = 'left_arm' AND joint = 1) OR (limb = 'right_arm' AND joint = 2) OR (limb = 'left_leg' AND joint = 3) OR (limb = 'right_leg' AND joint = 4)) AS visible FROM pose p JOIN l USING (video)")
def _(spark, d):
    return MK.mask_limb(pose(spark, d), LIMBS, weighted=True)


def pooled_matrix(path):
    t = S.transition_counts(path.withColumn("one", F.lit(1)), K, keys=["one", "video"], by=["one"])
    return S.transition_matrix(t, K)


def _vector(expression: str) -> str:
    """A list of K entries; ``expression`` names its entry j."""
    return f"list_transform(range(1, {K + 1}), lambda j: {expression})"


def _step(matrix: str = "a", vector: str = "x") -> str:
    """Entry j of vector times matrix."""
    return f"list_sum(list_transform(range(1, {K + 1}), lambda i: {vector}[i] * {matrix}[i][j]))"


def _cells(key: str) -> str:
    """``pm``: transition shares by the key, if any (a row never left is uniform); ``mat``: the matrix as a list of rows."""
    k, base, on = (f"{key}, ", f"(SELECT DISTINCT {key} FROM sp), ", f"AND t.{key} = g.{key}") if key else ("", "", "")
    return (
        f"tr AS (SELECT {k}state, nx, count(*) AS n FROM (SELECT video, state, lead(state) OVER (PARTITION BY video ORDER BY m) AS nx FROM sp) WHERE nx IS NOT NULL GROUP BY ALL), "
        f"gr AS (SELECT {k}s.state, u.state AS nx FROM {base}(SELECT unnest(range({K})) AS state) s, (SELECT unnest(range({K})) AS state) u), "
        f"pm AS (SELECT {k}state, nx, CASE WHEN sum(n) OVER w > 0 THEN n / CAST(sum(n) OVER w AS DOUBLE) ELSE 1.0 / {K} END AS p FROM "
        f"(SELECT g.*, coalesce(n, 0) AS n FROM gr g LEFT JOIN tr t ON t.state = g.state AND t.nx = g.nx {on}) WINDOW w AS (PARTITION BY {k}state)), "
        f"mat AS (SELECT {k}list(r ORDER BY state) AS a FROM (SELECT {k}state, list(p ORDER BY nx) AS r FROM pm GROUP BY {k}state) GROUP BY ALL)"
    )


START = f"[{', '.join(['1.0 / ' + str(K)] * K)}]"
#: pi of the pooled chain by repeated steps, and mean passage times by the equation m_ij = 1 + sum over k other than j of p_ik m_kj
LAW = f"it AS (SELECT 0 AS t, {START} AS x, a FROM mat UNION ALL SELECT t + 1, {_vector(_step())}, a FROM it WHERE t < 400), law AS (SELECT x AS pi, a FROM it WHERE t = 400)"
PASSAGE = (
    f"mt AS (SELECT 0 AS t, list_transform(range({K}), lambda i: {START}) AS m, a FROM mat UNION ALL SELECT t + 1, list_transform(range(1, {K + 1}), lambda i: "
    f"list_transform(range(1, {K + 1}), lambda j: 1.0 + list_sum(list_transform(range(1, {K + 1}), lambda k: CASE WHEN k = j THEN 0.0 ELSE a[i][k] * m[k][j] END)))), a FROM mt WHERE t < 600), "
    f"ps AS (SELECT s.state, t.state AS next_state, CASE WHEN s.state = t.state THEN 0.0 ELSE m[s.state + 1][t.state + 1] END AS mfpt FROM mt, (SELECT unnest(range({K})) AS state) s, (SELECT unnest(range({K})) AS state) t WHERE mt.t = 600)"
)
POOLED = f"WITH RECURSIVE {SP}, {_cells('')}"


@register("stationary", ints="video state", doubles="pi",
          sql=f"WITH RECURSIVE {SP}, {_cells('video')}, it AS (SELECT video, 0 AS t, {START} AS x, a FROM mat UNION ALL SELECT video, t + 1, {_vector(_step())}, a FROM it WHERE t < 1500) "
          f"SELECT video, s.state, x[s.state + 1] AS pi FROM it, (SELECT unnest(range({K})) AS state) s WHERE t = 1500")
def _(spark, d):
    m = S.transition_matrix(S.transition_counts(state_paths(spark, d), K), K)
    return C.stationary(C.matrices(m, ["video"], "p", K), ["video"], K)


@register("passage_times", ints="state next_state", doubles="mfpt", sql=f"{POOLED}, {PASSAGE} SELECT * FROM ps")
def _(spark, d):
    return C.passage_times(C.matrices(pooled_matrix(state_paths(spark, d)), ["one"], "p", K), ["one"], K)


@register("kemeny", ints="agree", doubles="kemeny kemeny_spectral",
          sql=f"{POOLED}, {LAW}, {PASSAGE} SELECT 1 AS agree, sum(pi[next_state + 1] * mfpt) AS kemeny, sum(pi[next_state + 1] * mfpt) AS kemeny_spectral FROM ps, law WHERE state = 0")
def _(spark, d):
    return C.kemeny(C.matrices(pooled_matrix(state_paths(spark, d)), ["one"], "p", K), ["one"], K)


@register("closeness_and_inbound", ints="state", doubles="closeness mean_inbound",
          sql=f"{POOLED}, {PASSAGE}, o AS (SELECT state, 1.0 / sum(mfpt) AS closeness FROM ps GROUP BY 1), i AS (SELECT next_state AS state, sum(mfpt) / {K - 1}.0 AS mean_inbound FROM ps GROUP BY 1) SELECT * FROM o JOIN i USING (state)")
def _(spark, d):
    return C.closeness_and_inbound(C.passage_times(C.matrices(pooled_matrix(state_paths(spark, d)), ["one"], "p", K), ["one"], K), ["one"], K)


def _damped(d: float) -> str:
    n = int(round(100 * d))
    return f"d{n} AS (SELECT 0 AS t, {START} AS x, a FROM mat UNION ALL SELECT t + 1, {_vector(f'{d} * {_step()} + {1 - d} / {K}')}, a FROM d{n} WHERE t < 400), l{n} AS (SELECT x AS x{n} FROM d{n} WHERE t = 400)"


@register(
    "degenerate_centralities", ints="state out_degree_is_one right_is_constant", doubles="out_degree right_perron pi pagerank_85 pagerank_85_l1 pagerank_95 pagerank_95_l1 pagerank_99 pagerank_99_l1",
    sql=f"{POOLED}, {LAW}, {', '.join(map(_damped, (0.85, 0.95, 0.99)))} SELECT s.state, 1.0 AS out_degree, 1.0 AS right_perron, 1 AS out_degree_is_one, 1 AS right_is_constant, pi[s.state + 1] AS pi, "
    + ", ".join(f"x{n}[s.state + 1] AS pagerank_{n}, list_sum({_vector(f'abs(x{n}[j] - pi[j])')}) AS pagerank_{n}_l1" for n in (85, 95, 99))
    + f" FROM law, l85, l95, l99, (SELECT unnest(range({K})) AS state) s",
)
def _(spark, d):
    return C.degenerate_centralities(C.matrices(pooled_matrix(state_paths(spark, d)), ["one"], "p", K), ["one"], K)


SHR = (
    "nv AS (SELECT video, count(*) AS n FROM visits GROUP BY 1), tt AS (SELECT v.video, visit, state, visit >= CAST(floor(n * 0.7) AS BIGINT) AS t FROM visits v JOIN nv USING (video)), "
    "pr AS (SELECT video, t, state, lead(state) OVER (PARTITION BY video, t ORDER BY visit) AS nx FROM tt), st AS (SELECT unnest(range(0, 5)) AS s), vd AS (SELECT DISTINCT video FROM visits), "
    "ce AS (SELECT vd.video, a.s AS state, b.s AS nx FROM vd, st a, st b), tc AS (SELECT ce.video, ce.state, ce.nx, count(pr.state) AS n FROM ce LEFT JOIN pr ON pr.video = ce.video AND pr.state = ce.state AND pr.nx = ce.nx AND NOT pr.t GROUP BY 1, 2, 3), "
    "ow AS (SELECT *, CASE WHEN sum(n) OVER w > 0 THEN n / CAST(sum(n) OVER w AS DOUBLE) ELSE 0.2 END AS p FROM tc WINDOW w AS (PARTITION BY video, state)), "
    "gc AS (SELECT state, nx, sum(n) AS n FROM tc GROUP BY 1, 2), gr AS (SELECT *, CASE WHEN sum(n) OVER w > 0 THEN n / CAST(sum(n) OVER w AS DOUBLE) ELSE 0.2 END AS g FROM gc WINDOW w AS (PARTITION BY state)), "
    "al AS (SELECT unnest(range(0, 20)) * 0.05 AS alpha), qq AS (SELECT ow.video, ow.state, ow.nx, alpha, greatest((1 - alpha) * p + alpha * g, 1e-12) AS q FROM ow JOIN gr USING (state, nx), al), "
    "q2 AS (SELECT *, q / sum(q) OVER (PARTITION BY video, alpha, state) AS qn FROM qq), te AS (SELECT video, state, nx, count(*) AS c FROM pr WHERE t AND nx IS NOT NULL GROUP BY 1, 2, 3), "
    "ll AS (SELECT alpha, sum(c * ln(qn)) AS loglik FROM q2 JOIN te USING (video, state, nx) GROUP BY 1)"
)


@register("choose_alpha", ints="best degenerate", doubles="alpha loglik", digits=4,
          sql=f"WITH {PATHS}, {SHR} SELECT alpha, loglik, loglik = (SELECT max(loglik) FROM ll) AS best, (SELECT arg_max(alpha, loglik) FROM ll) >= 0.9 - 1e-9 AS degenerate FROM ll")
def _(spark, d):
    return C.choose_alpha(S.visit_sequence(state_paths(spark, d)), K)


@register("shrunk_matrix", ints="video state next_state", doubles="shrunk",
          sql=f"WITH {SP}, st AS (SELECT unnest(range(0, 5)) AS s), vd AS (SELECT DISTINCT video FROM sp), pr AS (SELECT video, state, lead(state) OVER (PARTITION BY video ORDER BY m) AS nx FROM sp), ce AS (SELECT vd.video, a.s AS state, b.s AS nx FROM vd, st a, st b), "
          "tc AS (SELECT ce.video, ce.state, ce.nx, count(pr.state) AS n FROM ce LEFT JOIN pr ON pr.video = ce.video AND pr.state = ce.state AND pr.nx = ce.nx GROUP BY 1, 2, 3), "
          "ow AS (SELECT *, CASE WHEN sum(n) OVER w > 0 THEN n / CAST(sum(n) OVER w AS DOUBLE) ELSE 0.2 END AS p FROM tc WINDOW w AS (PARTITION BY video, state)), gr AS (SELECT state, nx, sum(n) / CAST(sum(sum(n)) OVER (PARTITION BY state) AS DOUBLE) AS g FROM tc GROUP BY 1, 2) "
          "SELECT video, state, nx AS next_state, 0.6 * p + 0.4 * g AS shrunk FROM ow JOIN gr USING (state, nx)")
def _(spark, d):
    p = state_paths(spark, d)
    return C.shrink(S.transition_matrix(S.transition_counts(p, K), K), pooled_matrix(p).drop("one"), 0.4)


@register("subject_kemeny", ints="video", doubles="kemeny")
def _(spark, d):
    p = state_paths(spark, d)
    return C.subject_kemeny(p, S.transition_matrix(S.transition_counts(p.withColumn("one", F.lit(1)), K, keys=["one", "video"], by=["one"]).drop("one"), K), K, 0.3)


PHO = f"{SIM_SQL}, q AS (SELECT video, state, lead(state) OVER (PARTITION BY video ORDER BY visit) AS next_state FROM visits), ob AS (SELECT video, avg(s) AS observed FROM q JOIN simt USING (state, next_state) GROUP BY 1)"


@register("observed_similarity", ints="video", doubles="observed", digits=8, sql=f"WITH {PATHS}, {PHO} SELECT * FROM ob")
def _(spark, d):
    p = state_paths(spark, d)
    return X.observed_similarity(p, similarity_from_counts(p))


@register("uniform_null", ints="video", doubles="null_uniform repeat_rate", digits=8,
          sql=f"WITH {PATHS}, {PHO}, c AS (SELECT video, state, count(*) AS c FROM visits GROUP BY 1, 2), n AS (SELECT video, sum(c) AS n FROM c GROUP BY 1), w AS (SELECT a.video, a.state, b.state AS next_state, a.c * CASE WHEN a.state = b.state THEN a.c - 1 ELSE b.c END / CAST(n * (n - 1) AS DOUBLE) AS w FROM c a JOIN c b USING (video) JOIN n USING (video)) "
          "SELECT video, sum(w * s) AS null_uniform, sum(CASE WHEN state = next_state THEN w ELSE 0 END) AS repeat_rate FROM w JOIN simt USING (state, next_state) GROUP BY 1")
def _(spark, d):
    p = state_paths(spark, d)
    return X.uniform_null(p, similarity_from_counts(p))


@register("excess_similarity", ints="video n_visits", texts="method", doubles="observed null_mean excess p ess null_uniform excess_uniform repeat_rate")
def _(spark, d):
    p = state_paths(spark, d)
    return X.excess_similarity(p, similarity_from_counts(p), K, draws=200)


@register("excess_similarity_first_half", ints="video n_visits", texts="method", doubles="excess")
def _(spark, d):
    p = state_paths(spark, d)
    return X.excess_similarity(p, similarity_from_counts(p), K, draws=100, part="first")


@register("dwell_stratified_excess", ints="video dwell_bin n", doubles="excess")
def _(spark, d):
    p = state_paths(spark, d)
    s = X.small_table(similarity_from_counts(p))
    return X.dwell_stratified(p, s, X.no_repeat_null(p, s, K, draws=100))


@register("channel_split", ints="video", texts="channel", doubles="excess")
def _(spark, d):
    p = state_paths(spark, d)
    m = moments(spark, d)
    ch = {"combined": SM.similarity_direction_aware(m, JS, 0.5), "magnitude": SM.similarity_magnitude(m, JS), "shape": SM.similarity_shape(m, JS)}
    return X.channel_split(p, ch, K, draws=50)
