"""Queries over keypoint tables: preprocessing, kinematics, similarity, coupling, entropy."""

from functools import reduce

from pyspark.sql import functions as F

from kinetable.catalog.registry import register
from kinetable.catalog.sqltext import DENSE, KP, POSES, SP, VEL
from kinetable.operators import entropy as E
from kinetable.operators import frames as FR
from kinetable.operators import kinematics as KN
from kinetable.operators import limbs as LB
from kinetable.operators import quality as QL
from kinetable.operators import similarity as SM
from kinetable.operators import windows as WN
from kinetable.sources.tables import keypoints, state_paths

J, K, FPS = 5, 5, 10.0
LIMBS = {"left_arm": [1], "right_arm": [2], "left_leg": [3], "right_leg": [4]}
SHORT = {"LA": [1], "RA": [2], "LL": [3], "RL": [4]}
BONES = [(0, 1), (0, 2), (0, 3), (0, 4)]
CHAINS = [E.Chain("L hand", 1, 3, "L", "hand"), E.Chain("R hand", 2, 4, "R", "hand"), E.Chain("L hip", 0, 1, "L", "hip"), E.Chain("R hip", 0, 2, "R", "hip")]
LEN = "ln AS (SELECT video, max(frame) + 1 AS n FROM pose GROUP BY 1)"


def pose(spark, d):
    return FR.interpolate_missing(FR.densify_frames(keypoints(spark, d), J))


def lengths(p):
    return WN.recording_lengths(p)


def velocities(spark, d):
    return FR.velocity(pose(spark, d), FPS)


@register("densify_frames", ints="video frame joint", doubles="x y", sql=f"WITH {KP}, {DENSE} SELECT * FROM dense")
def _(spark, d):
    return FR.densify_frames(keypoints(spark, d), J)


@register("interpolate_missing", ints="video frame joint", doubles="x y", sql=f"WITH {POSES} SELECT * FROM pose")
def _(spark, d):
    return pose(spark, d)


CENTER = (
    "cen AS (SELECT video, frame, joint, x - max(CASE WHEN joint = 0 THEN x END) OVER w AS x, "
    "y - max(CASE WHEN joint = 0 THEN y END) OVER w AS y FROM pose WINDOW w AS (PARTITION BY video, frame))"
)
SCALE = (
    "sc AS (SELECT video, greatest(quantile_cont(d, 0.5), 1e-6) AS scale FROM (SELECT video, frame, sqrt(pow(max(CASE WHEN joint = 1 THEN x END) - "
    "max(CASE WHEN joint = 2 THEN x END), 2) + pow(max(CASE WHEN joint = 1 THEN y END) - max(CASE WHEN joint = 2 THEN y END), 2)) AS d "
    "FROM cen GROUP BY 1, 2) GROUP BY 1)"
)


@register("root_center", ints="video frame joint", doubles="x y", sql=f"WITH {POSES}, {CENTER} SELECT * FROM cen")
def _(spark, d):
    return FR.root_center(pose(spark, d), 0)


@register("root_center_mean", ints="video frame joint", doubles="x y",
          sql=f"WITH {POSES} SELECT video, frame, joint, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM pose WINDOW w AS (PARTITION BY video, frame)")
def _(spark, d):
    return FR.root_center(pose(spark, d), -1)


@register("torso_scale", ints="video", doubles="scale", sql=f"WITH {POSES}, {CENTER}, {SCALE} SELECT * FROM sc")
def _(spark, d):
    return FR.torso_scale(FR.root_center(pose(spark, d), 0), 1, 2, J)


@register(
    "torso_scale_fallback", ints="video", doubles="scale",
    sql=f"WITH {POSES}, c AS (SELECT video, sqrt(pow(x - avg(x) OVER w, 2) + pow(y - avg(y) OVER w, 2)) AS d FROM pose WINDOW w AS (PARTITION BY video, frame)) "
    "SELECT video, greatest(quantile_cont(d, 0.5), 1e-6) AS scale FROM c GROUP BY 1",
)
def _(spark, d):
    return FR.torso_scale(pose(spark, d), -1, 99, J)


@register("normalize_pose", ints="video frame joint", doubles="x y",
          sql=f"WITH {POSES}, {CENTER}, {SCALE} SELECT video, frame, joint, x / scale AS x, y / scale AS y FROM cen JOIN sc USING (video)")
def _(spark, d):
    return FR.normalize_pose(pose(spark, d), "center_scale", 0, 1, 2, J)


ALIGN = (
    "dsp AS (SELECT video, arg_max(x, frame) - arg_min(x, frame) AS da, arg_max(y, frame) - arg_min(y, frame) AS db FROM {src} WHERE joint = 0 GROUP BY 1), "
    "ali AS (SELECT video, frame, joint, CASE WHEN sqrt(da*da+db*db) < 1e-6 THEN x ELSE cos(atan2(db, da)) * x + sin(atan2(db, da)) * y END AS x, "
    "CASE WHEN sqrt(da*da+db*db) < 1e-6 THEN y ELSE cos(atan2(db, da)) * y - sin(atan2(db, da)) * x END AS y FROM {src} JOIN dsp USING (video))"
)


@register("align_direction", ints="video frame joint", doubles="x y", sql=f"WITH {POSES}, {ALIGN.format(src='pose')} SELECT * FROM ali")
def _(spark, d):
    return FR.align_direction(pose(spark, d), ("x", "y"), 0)


RES = (
    f"{LEN}, tgt AS (SELECT video, n, greatest(CAST(round_even((n - 1) / 10.0 * 25.0, 0) AS BIGINT) + 1, 2) AS n2 FROM ln), "
    "pts AS (SELECT video, n, n2, unnest(range(0, n2)) AS i FROM tgt), "
    "ps AS (SELECT *, i * (n - 1) / CAST(n2 - 1 AS DOUBLE) AS p, (i * (n - 1)) // (n2 - 1) AS lo FROM pts), "
    "res AS (SELECT ps.video, ps.i AS frame, a.joint, a.x + (b.x - a.x) * (p - lo) AS x, a.y + (b.y - a.y) * (p - lo) AS y FROM ps "
    "JOIN pose a ON a.video = ps.video AND a.frame = ps.lo JOIN pose b ON b.video = ps.video AND b.joint = a.joint AND b.frame = least(ps.lo + 1, ps.n - 1))"
)


def _with_fps(p):
    return lengths(p).withColumn("fps", F.lit(10.0))


@register("resample_fps", ints="video frame joint", doubles="x y", digits=9, sql=f"WITH {POSES}, {RES} SELECT * FROM res")
def _(spark, d):
    p = pose(spark, d)
    return FR.resample_fps(p, _with_fps(p), 25.0)


@register("preprocess_walk", ints="video frame joint", doubles="x y", digits=9,
          sql=f"WITH {POSES}, {RES} SELECT video, frame, joint, x - max(CASE WHEN joint = 0 THEN x END) OVER w AS x, "
          "y - max(CASE WHEN joint = 0 THEN y END) OVER w AS y FROM res WINDOW w AS (PARTITION BY video, frame)")
def _(spark, d):
    p = pose(spark, d)
    return FR.preprocess_walk(p, _with_fps(p), 25.0, ("x", "y"), 0)


@register(
    "preprocess_walk_aligned", ints="video frame joint", doubles="x y", digits=5,
    sql=f"WITH {POSES}, {RES}, {ALIGN.format(src='res')} SELECT video, frame, joint, x - max(CASE WHEN joint = 0 THEN x END) OVER w AS x, "
    "y - max(CASE WHEN joint = 0 THEN y END) OVER w AS y FROM ali WINDOW w AS (PARTITION BY video, frame)",
)
def _(spark, d):
    p = pose(spark, d)
    return FR.preprocess_walk(p, _with_fps(p), 25.0, ("x", "y"), 0, align_before_center=True)


EGO = (
    "hd AS (SELECT video, frame, atan2(max(CASE WHEN joint = 2 THEN x END) - max(CASE WHEN joint = 1 THEN x END), "
    "-(max(CASE WHEN joint = 2 THEN y END) - max(CASE WHEN joint = 1 THEN y END))) AS h FROM pose GROUP BY 1, 2), "
    "ego AS (SELECT c.video, c.frame, c.joint, cos(-h) * x - sin(-h) * y AS x, sin(-h) * x + cos(-h) * y AS y, h AS heading FROM cen c JOIN hd USING (video, frame))"
)


@register("egocentric", ints="video frame joint", doubles="x y heading", sql=f"WITH {POSES}, {CENTER}, {EGO} SELECT * FROM ego")
def _(spark, d):
    return FR.egocentric(pose(spark, d), ("x", "y"), 0, 1, 2)


ROOT = (
    "r0 AS (SELECT p.video, p.frame, p.x, p.y, h, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, h - lag(h) OVER w AS d FROM pose p JOIN hd USING (video, frame) "
    "WHERE joint = 0 WINDOW w AS (PARTITION BY p.video ORDER BY p.frame)), "
    "r1 AS (SELECT *, d - lag(d) OVER (PARTITION BY video ORDER BY frame) AS s FROM r0), "
    "r2 AS (SELECT *, CASE WHEN s IS NULL OR abs(s) < pi() THEN 0 ELSE (s + pi()) - 2 * pi() * floor((s + pi()) / (2 * pi())) - pi() - s END AS c FROM r1), "
    "rc AS (SELECT video, frame, (cos(-h) * coalesce(dx, 0) - sin(-h) * coalesce(dy, 0)) * 10 AS v_forward, (sin(-h) * coalesce(dx, 0) + cos(-h) * coalesce(dy, 0)) * 10 AS v_side, "
    "coalesce(d + sum(c) OVER (PARTITION BY video ORDER BY frame), 0) * 10 AS omega, y AS height FROM r2)"
)


@register("root_channels", ints="video frame", doubles="v_forward v_side omega height", sql=f"WITH {POSES}, {CENTER}, {EGO}, {ROOT} SELECT * FROM rc")
def _(spark, d):
    return FR.root_channels(pose(spark, d), ("x", "y"), "y", 0, 1, 2, FPS)


@register(
    "walk_features", ints="video frame part", doubles="feature",
    sql=f"WITH {POSES}, {CENTER}, {EGO}, {ROOT} SELECT video, frame, joint * 2 AS part, x AS feature FROM ego UNION ALL SELECT video, frame, joint * 2 + 1, y FROM ego "
    "UNION ALL SELECT video, frame, 10, v_forward FROM rc UNION ALL SELECT video, frame, 11, v_side FROM rc UNION ALL SELECT video, frame, 12, omega FROM rc "
    "UNION ALL SELECT video, frame, 13, height FROM rc",
)
def _(spark, d):
    return FR.walk_features(pose(spark, d), ("x", "y"), "y", 0, 1, 2, FPS).select("video", "frame", F.posexplode("features").alias("part", "feature"))


@register("build_walk_table", ints="video frame n_frames", texts="walk_key subject_key", doubles="total",
          sql=f"WITH {POSES}, {LEN} SELECT p.video, p.frame, n AS n_frames, 'n' || c_nationkey || ':s' || c_mktsegment || ':' || p.video AS walk_key, "
          "'n' || c_nationkey || ':s' || c_mktsegment AS subject_key, sum(x) + sum(y) AS total FROM pose p JOIN ln USING (video) JOIN customer ON c_custkey = p.video "
          "WHERE n >= 29 GROUP BY ALL")
def _(spark, d):
    from kinetable.sources.tables import table

    f = FR.flatten_clip(pose(spark, d), ("video", "frame"))
    walks = table(spark, d, "customer").select(
        F.col("c_custkey").alias("video"), F.concat(F.lit("n"), "c_nationkey").alias("cohort"),
        F.concat(F.lit("s"), "c_mktsegment").alias("subject"), F.col("c_custkey").cast("string").alias("walk_id"),
    )
    return FR.build_walk_table(f, walks, 29).withColumn("total", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x))


@register("flatten_clip", ints="video frame n_dims", doubles="first last",
          sql=f"WITH {POSES} SELECT video, frame, 10 AS n_dims, max(CASE WHEN joint = 0 THEN x END) AS first, max(CASE WHEN joint = 4 THEN y END) AS last FROM pose GROUP BY 1, 2")
def _(spark, d):
    f = FR.flatten_clip(pose(spark, d), ("video", "frame"))
    return f.select("video", "frame", F.size("vector").alias("n_dims"), F.col("vector")[0].alias("first"), F.element_at("vector", -1).alias("last"))


@register("mirror_pose", ints="video frame joint", doubles="x y",
          sql=f"WITH {POSES} SELECT video, frame, CASE joint WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE joint END AS joint, -x AS x, y FROM pose")
def _(spark, d):
    return FR.mirror_pose(pose(spark, d), [(1, 2), (3, 4)])


@register("velocity", ints="video frame joint", doubles="vx vy speed", sql=f"WITH {POSES}, {VEL} SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM vel")
def _(spark, d):
    return velocities(spark, d)


INST = (
    "sp1 AS (SELECT video, frame, joint, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS s, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS b "
    "FROM pose WINDOW w AS (PARTITION BY video, joint ORDER BY frame)), inst AS (SELECT video, frame, joint, coalesce(s, b) AS speed FROM sp1)"
)


@register("instantaneous_speed", ints="video frame joint", doubles="speed", sql=f"WITH {POSES}, {INST} SELECT * FROM inst")
def _(spark, d):
    return FR.instantaneous_speed(pose(spark, d))


@register("mean_speed", ints="video joint", doubles="mean_speed", sql=f"WITH {POSES}, {VEL} SELECT video, joint, avg(sqrt(vx*vx+vy*vy) / 10.0) AS mean_speed FROM vel GROUP BY 1, 2")
def _(spark, d):
    return FR.mean_speed(pose(spark, d))


LV = (
    "lv AS (SELECT video, frame, CASE joint WHEN 1 THEN 'LA' WHEN 2 THEN 'RA' WHEN 3 THEN 'LL' WHEN 4 THEN 'RL' END AS limb, "
    "CASE WHEN joint IN (1, 3) THEN -vx ELSE vx END AS vx, vy FROM vel WHERE joint > 0)"
)


@register("limb_velocity", ints="video frame", texts="limb", doubles="vx vy", sql=f"WITH {POSES}, {VEL}, {LV} SELECT * FROM lv")
def _(spark, d):
    return FR.limb_velocity(velocities(spark, d), SHORT, ["LA", "LL"])


CLIPS = f"{LEN}, cs AS (SELECT video, unnest(range(0, n - 10 + 1, 5)) AS start_frame FROM ln WHERE n >= 10)"


@register("clip_table", ints="video start_frame", sql=f"WITH {POSES}, {CLIPS} SELECT * FROM cs")
def _(spark, d):
    return WN.clip_table(lengths(pose(spark, d)), 10, 5)


@register("clip_windows", ints="video start_frame t joint", doubles="x y",
          sql=f"WITH {POSES}, {CLIPS} SELECT c.video, c.start_frame, p.frame - c.start_frame AS t, p.joint, p.x, p.y FROM cs c JOIN pose p ON p.video = c.video "
          "AND p.frame >= c.start_frame AND p.frame < c.start_frame + 10")
def _(spark, d):
    p = pose(spark, d)
    return WN.clip_windows(p, lengths(p), 10, 5)


STITCH = (
    "wz AS (SELECT video, joint, frame // 8 * 4 AS start_frame, frame % 8 AS w, x, y FROM pose WHERE frame < 24), "
    "kz AS (SELECT video, start_frame, w, max(CASE WHEN joint = 0 THEN x END) AS z0, max(CASE WHEN joint = 1 THEN y END) AS z1 FROM wz WHERE w BETWEEN 2 AND 5 GROUP BY 1, 2, 3), "
    "mz AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY start_frame, w) - 1 AS m, z0, z1 FROM kz)"
)


@register(
    "stitch_windows", ints="video m", doubles="z0 z1",
    sql=f"WITH {POSES}, wz AS (SELECT video, frame // 4 * 8 AS start_frame, frame % 4 AS w, max(CASE WHEN joint = 0 THEN x END) AS z0, max(CASE WHEN joint = 1 THEN y END) AS z1 "
    "FROM pose GROUP BY 1, 2, 3), kz AS (SELECT * FROM wz WHERE w BETWEEN 0 AND 1 OR w BETWEEN 1 AND 2), q AS (SELECT *, row_number() OVER (PARTITION BY video "
    "ORDER BY start_frame, w) - 1 AS m FROM wz WHERE w IN (1, 2)) SELECT a.video, a.m, b.z0 - a.z0 AS z0, b.z1 - a.z1 AS z1 FROM q a JOIN q b ON a.video = b.video AND b.m = a.m + 1",
)
def _(spark, d):
    g = WN.Geometry(fps=FPS, T=16, W=4, stride=8)
    p = pose(spark, d)
    z = p.groupBy("video", (F.floor(F.col("frame") / 4) * 8).alias("start_frame"), (F.col("frame") % 4).alias("w")).agg(
        F.array(F.max(F.when(F.col("joint") == 0, F.col("x"))), F.max(F.when(F.col("joint") == 1, F.col("y")))).alias("z")
    )
    out = WN.stitch_windows(z, g, "delta")
    return out.select("video", "m", F.col("z")[0].alias("z0"), F.col("z")[1].alias("z1"))


@register("kept_window_spans", ints="video m lo hi",
          sql=f"WITH {SP} SELECT video, m, 16 + 2 + m * 4 AS lo, 16 + 2 + m * 4 + 4 AS hi FROM sp")
def _(spark, d):
    g = WN.Geometry(fps=25.0)
    spans = WN.window_spans(state_paths(spark, d), g, "delta")
    return spans.join(WN.misaligned_spans(spans, g).select("video", "m"), ["video", "m"], "left_anti")


@register("delta_spans", ints="video m lo hi",
          sql=f"WITH {SP}, n AS (SELECT video, count(*) * 4 AS f FROM sp GROUP BY 1) SELECT video, m, least(16 + 4 * m, f - 1) AS lo, least(16 + 4 * m + 8, f - 1) AS hi FROM sp JOIN n USING (video)")
def _(spark, d):
    path = state_paths(spark, d)
    n = path.groupBy("video").agg((F.count("*") * 4).alias("n_frames"))
    return WN.delta_spans(path, n, WN.Geometry(fps=25.0))


@register("epochs", ints="video frame joint epoch",
          sql=f"WITH {POSES}, {VEL}, {LEN} SELECT v.video, v.frame, v.joint, v.frame // 5 AS epoch FROM vel v JOIN ln USING (video) WHERE v.frame // 5 < (n - 1) // 5")
def _(spark, d):
    p = pose(spark, d)
    return WN.epochs(FR.velocity(p, FPS), lengths(p), FPS, 0.5)


@register("time_blocks", ints="video start_frame block", sql=f"WITH {POSES}, {CLIPS} SELECT *, CAST(floor(start_frame / 8.0) AS BIGINT) AS block FROM cs")
def _(spark, d):
    c = WN.clip_table(lengths(pose(spark, d)), 10, 5)
    return c.withColumn("block", WN.time_block(F.col("start_frame"), 10.0, 0.8))


KIN = ", ".join(f"avg(CASE WHEN joint = {j[0]} THEN s END) AS speed_{n}" for n, j in LIMBS.items())


@register(
    "kinematic_features", ints="video start_frame",
    doubles="mean_speed kinetic_energy speed_left_arm speed_right_arm speed_left_leg speed_right_leg laterality_arm laterality_leg upper_lower_balance",
    sql=f"WITH {POSES}, {CLIPS}, st AS (SELECT video, frame, joint, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS s FROM pose WINDOW w AS "
    f"(PARTITION BY video, joint ORDER BY frame)), k AS (SELECT c.video, c.start_frame, avg(s) AS mean_speed, sum(s * s) AS kinetic_energy, {KIN} FROM cs c JOIN st ON "
    "st.video = c.video AND st.frame >= c.start_frame AND st.frame < c.start_frame + 9 GROUP BY 1, 2) SELECT *, speed_left_arm - speed_right_arm AS laterality_arm, "
    "speed_left_leg - speed_right_leg AS laterality_leg, speed_left_arm + speed_right_arm - speed_left_leg - speed_right_leg AS upper_lower_balance FROM k",
    digits=3,
)
def _(spark, d):
    p = pose(spark, d)
    disp = lengths(p).select("video", (F.col("n_frames") - 1).alias("n_frames"))
    v = WN.clip_windows(FR.velocity(p, 1.0), disp, 9, 5)
    f = KN.kinematic_features(v.withColumn("clip_id", F.struct("video", "start_frame")), LIMBS)
    return f.select("clip_id.*", *[c for c in f.columns if c != "clip_id"])


FSTATE = "fs AS (SELECT video, state, m AS frame FROM sp)"


@register("state_joint_velocity", ints="state joint", doubles="mean_speed",
          sql=f"WITH {POSES}, {VEL}, {SP} SELECT state, joint, avg(sqrt(vx*vx+vy*vy)) AS mean_speed FROM vel JOIN sp ON sp.video = vel.video AND sp.m = vel.frame GROUP BY 1, 2")
def _(spark, d):
    return KN.state_joint_velocity(state_paths(spark, d), velocities(spark, d))


@register("state_region_breakdown", ints="state", texts="body_group", doubles="mean_speed",
          sql=f"WITH {POSES}, {VEL}, {SP}, q AS (SELECT state, joint, avg(sqrt(vx*vx+vy*vy)) AS s FROM vel JOIN sp ON sp.video = vel.video AND sp.m = vel.frame GROUP BY 1, 2) "
          "SELECT state, CASE WHEN joint = 0 THEN 'head' WHEN joint IN (1, 2) THEN 'arms' ELSE 'legs' END AS body_group, avg(s) AS mean_speed FROM q GROUP BY 1, 2")
def _(spark, d):
    by = KN.state_joint_velocity(state_paths(spark, d), velocities(spark, d))
    return KN.state_region_breakdown(by, {"head": [0], "arms": [1, 2], "legs": [3, 4]})


@register(
    "high_velocity_profile", ints="video state", texts="body_group", doubles="pct",
    sql=f"WITH {POSES.replace('pose AS (', 'pose0 AS (')}, pose AS (SELECT video, frame, joint, x + sin(joint + frame) AS x, y + cos(joint * frame) AS y FROM pose0), {INST}, {SP}, cut AS (SELECT video, joint, quantile_cont(speed, 0.9) AS c FROM inst GROUP BY 1, 2), "
    "hv AS (SELECT i.video, i.frame, CASE WHEN i.joint = 0 THEN 'head' WHEN i.joint IN (1, 2) THEN 'arms' ELSE 'legs' END AS body_group, CASE WHEN speed >= c THEN 1 ELSE 0 END AS h "
    "FROM inst i JOIN cut USING (video, joint)), got AS (SELECT hv.video, state, body_group, 100.0 * avg(h) AS pct FROM hv JOIN sp ON sp.video = hv.video AND sp.m = hv.frame GROUP BY 1, 2, 3), "
    "v AS (SELECT DISTINCT video FROM sp) SELECT v.video, s.state, g.body_group, pct FROM v CROSS JOIN (VALUES (0),(1),(2),(3),(4)) s(state) CROSS JOIN (VALUES ('head'),('arms'),('legs')) g(body_group) "
    "LEFT JOIN got ON got.video = v.video AND got.state = s.state AND got.body_group = g.body_group",
)
def _(spark, d):
    fr = state_paths(spark, d).select("video", "state", F.col("m").alias("frame"))
    # a fixed sway keeps equal interpolated speeds from tying exactly at the threshold
    sway = pose(spark, d).withColumns({"x": F.col("x") + F.sin(F.col("joint") + F.col("frame")), "y": F.col("y") + F.cos(F.col("joint") * F.col("frame"))})
    return KN.high_velocity_profile(fr, sway, {"head": [0], "arms": [1, 2], "legs": [3, 4]}, K)


@register("state_velocity_cloud", ints="state joint n", doubles="x y vx vy",
          sql=f"WITH {POSES}, {VEL}, {SP} SELECT state, v.joint, count(*) AS n, avg(p.x) AS x, avg(p.y) AS y, avg(vx) AS vx, avg(vy) AS vy FROM vel v JOIN pose p ON p.video = v.video "
          "AND p.frame = v.frame AND p.joint = v.joint JOIN sp ON sp.video = v.video AND sp.m = v.frame GROUP BY 1, 2")
def _(spark, d):
    p = pose(spark, d)
    fr = state_paths(spark, d).select("video", "state", F.col("m").alias("frame"))
    return KN.state_velocity_cloud(fr, p, FR.velocity(p, FPS))


@register("speed_cap", doubles="cap", sql=f"WITH {POSES}, {VEL}, {SP} SELECT quantile_cont(sqrt(vx*vx+vy*vy), 0.99) AS cap FROM vel JOIN sp ON sp.video = vel.video AND sp.m = vel.frame")
def _(spark, d):
    fr = state_paths(spark, d).select("video", "state", F.col("m").alias("frame"))
    return KN.speed_cap(fr, velocities(spark, d))


MOM = (
    "nk AS (SELECT state, count(*) AS n_frames FROM sp GROUP BY 1), mo AS (SELECT sp.state, joint, any_value(n_frames) AS n_frames, sum(vx*vx) / any_value(n_frames) AS mxx, "
    "sum(vx*vy) / any_value(n_frames) AS mxy, sum(vy*vy) / any_value(n_frames) AS myy FROM sp JOIN vel ON vel.video = sp.video AND vel.frame = sp.m JOIN nk ON nk.state = sp.state GROUP BY 1, 2), "
    "mo2 AS (SELECT *, sqrt(mxx + myy) AS a, (mxx - myy) / (mxx + myy) AS u1, 2 * mxy / (mxx + myy) AS u2 FROM mo)"
)
MBASE = f"{POSES}, {VEL}, {SP}, {MOM}"


def moments(spark, d):
    fr = state_paths(spark, d).select("video", "state", F.col("m").alias("frame"))
    return SM.state_moments(fr, velocities(spark, d))


@register("state_speed_profile", ints="state joint n_frames", doubles="a", sql=f"WITH {MBASE} SELECT state, joint, n_frames, a FROM mo2")
def _(spark, d):
    return moments(spark, d)


@register("state_second_moments", ints="state joint", doubles="mxx mxy myy", sql=f"WITH {MBASE} SELECT state, joint, mxx, mxy, myy FROM mo2")
def _(spark, d):
    return moments(spark, d)


@register("shape_coordinates", ints="state joint", doubles="u1 u2 anisotropy axis",
          sql=f"WITH {MBASE} SELECT state, joint, u1, u2, sqrt(u1*u1+u2*u2) AS anisotropy, 0.5 * atan2(u2, u1) AS axis FROM mo2")
def _(spark, d):
    return SM.shape_coordinates(moments(spark, d))


def _dc(c):
    return f"{c} - avg({c}) OVER (PARTITION BY joint) - avg({c}) OVER (PARTITION BY state) + avg({c}) OVER ()"


SIMS = (
    f"g AS (SELECT state, joint, ln(greatest(a, 1e-12)) AS g, u1, u2 FROM mo2), dc AS (SELECT state, joint, {_dc('g')} AS g, {_dc('u1')} AS u1, {_dc('u2')} AS u2 FROM g), "
    "mag AS (SELECT a.state, b.state AS next_state, greatest(-1, least(1, sum(a.g * b.g) / sqrt(sum(a.g * a.g)) / sqrt(sum(b.g * b.g)))) AS s FROM dc a JOIN dc b ON a.joint = b.joint GROUP BY 1, 2), "
    "shp AS (SELECT a.state, b.state AS next_state, greatest(-1, least(1, sum(a.u1 * b.u1 + a.u2 * b.u2) / sqrt(sum(a.u1 * a.u1 + a.u2 * a.u2)) / sqrt(sum(b.u1 * b.u1 + b.u2 * b.u2)))) AS s "
    "FROM dc a JOIN dc b ON a.joint = b.joint GROUP BY 1, 2)"
)
JS = [0, 1, 2, 3, 4]


@register("double_center", ints="state joint", doubles="g", sql=f"WITH {MBASE}, {SIMS} SELECT state, joint, g FROM dc")
def _(spark, d):
    return SM.double_center(SM.log_magnitude(moments(spark, d), JS), "state", "joint", "g")


@register("similarity_magnitude", ints="state next_state", doubles="s", sql=f"WITH {MBASE}, {SIMS} SELECT * FROM mag")
def _(spark, d):
    return SM.similarity_magnitude(moments(spark, d), JS)


@register("similarity_shape", ints="state next_state", doubles="s", sql=f"WITH {MBASE}, {SIMS} SELECT * FROM shp")
def _(spark, d):
    return SM.similarity_shape(moments(spark, d), JS)


@register("orientation_similarity", ints="state next_state", doubles="s",
          sql=f"WITH {MBASE}, {SIMS} SELECT a.state, b.state AS next_state, sum(a.u1*b.u1+a.u2*b.u2) / sum(sqrt(a.u1*a.u1+a.u2*a.u2) * sqrt(b.u1*b.u1+b.u2*b.u2)) AS s "
          "FROM dc a JOIN dc b ON a.joint = b.joint GROUP BY 1, 2")
def _(spark, d):
    return SM.orientation_similarity(moments(spark, d), JS)


@register("similarity_direction_aware", ints="state next_state", doubles="s",
          sql=f"WITH {MBASE}, {SIMS} SELECT state, next_state, 0.3 * mag.s + 0.7 * shp.s AS s FROM mag JOIN shp USING (state, next_state)")
def _(spark, d):
    return SM.similarity_direction_aware(moments(spark, d), JS, 0.3)


@register(
    "similarity_concatenated", ints="state next_state", doubles="s",
    sql=f"WITH {MBASE}, {SIMS}, z AS (SELECT state, joint, g / stddev_pop(g) OVER () AS g, u1 / stddev_pop(u1) OVER () AS u1, u2 / stddev_pop(u2) OVER () AS u2 FROM dc), "
    "l AS (SELECT state, joint, 0 AS ch, g AS v FROM z UNION ALL SELECT state, joint, 1, u1 FROM z UNION ALL SELECT state, joint, 2, u2 FROM z), "
    "c AS (SELECT state, joint, ch, v - avg(v) OVER (PARTITION BY state) AS v FROM l) SELECT a.state, b.state AS next_state, "
    "greatest(-1, least(1, sum(a.v * b.v) / sqrt(sum(a.v * a.v)) / sqrt(sum(b.v * b.v)))) AS s FROM c a JOIN c b ON a.joint = b.joint AND a.ch = b.ch GROUP BY 1, 2",
)
def _(spark, d):
    return SM.similarity_direction_aware(moments(spark, d), JS, 0.5, "concatenated")


BONE = (
    "bn AS (SELECT video, frame, b.joint - 1 AS bone, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS length FROM pose a JOIN pose b USING (video, frame) "
    "WHERE a.joint = 0 AND b.joint > 0), cv AS (SELECT video, bone, avg(length) AS mean_length, stddev_pop(length) / avg(length) AS cv FROM bn GROUP BY 1, 2)"
)


@register("bone_length_cv", ints="video bone", doubles="mean_length cv", sql=f"WITH {POSES}, {BONE} SELECT * FROM cv")
def _(spark, d):
    return KN.bone_length_cv(pose(spark, d), BONES)


@register("bone_plausibility", doubles="cv_generated cv_real ratio",
          sql=f"WITH {POSES}, {BONE}, h AS (SELECT avg(CASE WHEN video % 2 = 0 THEN cv END) AS cv_generated, avg(CASE WHEN video % 2 = 1 THEN cv END) AS cv_real FROM cv) "
          "SELECT *, cv_generated / cv_real AS ratio FROM h")
def _(spark, d):
    p = pose(spark, d)
    return KN.bone_plausibility(p.where("video % 2 = 0"), p.where("video % 2 = 1"), BONES)


@register(
    "bone_length_drift", ints="video worst_step", doubles="mean_drift max_drift",
    sql=f"WITH {POSES}, {BONE}, e AS (SELECT video, bone, (arg_min(length, frame) + arg_max(length, frame)) / 2 AS ref FROM bn GROUP BY 1, 2), "
    "s AS (SELECT video, frame, avg(abs(length - ref) / greatest(ref, 1e-12)) AS d FROM bn JOIN e USING (video, bone) GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY d DESC, frame) AS rn FROM s) "
    "SELECT video, avg(d) AS mean_drift, max(d) AS max_drift, max(CASE WHEN rn = 1 THEN frame END) AS worst_step FROM r GROUP BY 1",
)
def _(spark, d):
    return KN.bone_length_drift(pose(spark, d), BONES)


PAIRQ = (
    "pk AS (SELECT * FROM (VALUES ('RA','LA','homologous'),('RL','LL','homologous'),('RA','RL','ipsilateral'),('LA','LL','ipsilateral'),('RA','LL','contralateral'),('LA','RL','contralateral')) "
    "AS p(a, b, kind)), pr AS (SELECT x.video, x.frame, a || '-' || b AS pair, kind, x.vx AS ax, x.vy AS ay, y.vx AS bx, y.vy AS \"by\" FROM pk JOIN lv x ON x.limb = pk.a JOIN lv y ON y.limb = pk.b "
    "AND y.video = x.video AND y.frame = x.frame)"
)
CO = (
    f"{LEN}, co AS (SELECT pr.video, frame // 5 AS epoch, pair, kind, sum(ax*bx+ay*\"by\") / sqrt(sum(ax*ax+ay*ay)) / sqrt(sum(bx*bx+\"by\"*\"by\")) AS cosine, sum(ax*ax+ay*ay) AS aa, sum(bx*bx+\"by\"*\"by\") AS bb "
    "FROM pr JOIN ln ON ln.video = pr.video WHERE frame // 5 < (n - 1) // 5 GROUP BY 1, 2, 3, 4)"
)


def limb_rows(spark, d):
    return FR.limb_velocity(velocities(spark, d), SHORT, ["LA", "LL"])


@register("limb_pairs", ints="video frame", texts="pair kind", doubles="ax ay bx by", sql=f"WITH {POSES}, {VEL}, {LV}, {PAIRQ} SELECT * FROM pr")
def _(spark, d):
    return LB.limb_pairs(limb_rows(spark, d))


@register("comovement", ints="video epoch", texts="pair kind", doubles="cosine",
          sql=f"WITH {POSES}, {VEL}, {LV}, {PAIRQ}, {CO} SELECT video, epoch, pair, kind, CASE WHEN sqrt(aa) > 1e-12 AND sqrt(bb) > 1e-12 THEN cosine END AS cosine FROM co")
def _(spark, d):
    p = pose(spark, d)
    return LB.comovement(limb_rows(spark, d), lengths(p), FPS, 0.5)


@register("comovement_medians", ints="video n_epochs", texts="pair", doubles="median_cosine",
          sql=f"WITH {POSES}, {VEL}, {LV}, {PAIRQ}, {CO} SELECT video, pair, count(*) AS n_epochs, quantile_cont(CASE WHEN sqrt(aa) > 1e-12 AND sqrt(bb) > 1e-12 THEN cosine END, 0.5) AS median_cosine FROM co GROUP BY 1, 2")
def _(spark, d):
    p = pose(spark, d)
    return LB.comovement_medians(LB.comovement(limb_rows(spark, d), lengths(p), FPS, 0.5))


CP = LB.CouplingParams(w=8, tau_max=3, dtau=1, ell_min=2, c=0.25)


@register("lagged_coupling", ints="video direction row lag", texts="pair", doubles="gain")
def _(spark, d):
    p = pose(spark, d)
    g = LB.lagged_coupling(LB.directed_pairs(LB.limb_pairs(limb_rows(spark, d))), lengths(p), CP)
    return g.select("video", "direction", "row", "pair", F.posexplode("gain").alias("pos", "gain")).withColumn("lag", F.col("pos") - CP.tau_max)


@register(
    "peak_pick", ints="video n_rows n_runs", doubles="coupled strength",
    sql=f"WITH {POSES}, mx AS (SELECT max(x) AS mx FROM pose), r AS (SELECT video, frame AS row, max(x / mx) AS peak, arg_min(joint, (-x, joint)) - 2 AS lag FROM pose, mx GROUP BY 1, 2), "
    "k AS (SELECT *, lag(peak) OVER w AS pp, lag(lag) OVER w AS pl FROM r WINDOW w AS (PARTITION BY video ORDER BY row)), "
    "s AS (SELECT *, CASE WHEN peak > 0.25 AND NOT coalesce(pp > 0.25 AND abs(lag - pl) <= 1, false) THEN 1 ELSE 0 END AS st FROM k), "
    "i AS (SELECT *, sum(st) OVER (PARTITION BY video ORDER BY row) AS run FROM s), "
    "u AS (SELECT video, run, count(*) AS len, avg(peak) AS mean FROM i WHERE peak > 0.25 GROUP BY 1, 2 HAVING count(*) >= 2), "
    "n AS (SELECT video, count(*) AS n_rows FROM r GROUP BY 1) SELECT n.video, n_rows, count(u.run) AS n_runs, coalesce(sum(len), 0) / n_rows AS coupled, avg(mean) AS strength "
    "FROM n LEFT JOIN u USING (video) GROUP BY 1, 2",
)
def _(spark, d):
    p = pose(spark, d)
    top = p.agg(F.max("x").alias("mx"))
    g = p.join(F.broadcast(top.withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k")).groupBy("video", F.col("frame").alias("row")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("joint", (F.col("x") / F.col("mx")).alias("v")))), lambda e: e["v"]).alias("gain")
    )
    return LB.peak_pick(LB.peak_rows(g, 2), ["video"], 0.25, 1, 2)


@register("pair_coupling", ints="video", texts="pair", doubles="coupled strength")
def _(spark, d):
    p = pose(spark, d)
    return LB.pair_coupling(LB.limb_pairs(limb_rows(spark, d)), lengths(p), CP)


@register("coupling_summary", ints="video", doubles="mean_coupled spread_coupled mean_strength")
def _(spark, d):
    p = pose(spark, d)
    return LB.coupling_summary(LB.pair_coupling(LB.limb_pairs(limb_rows(spark, d)), lengths(p), CP))


@register("coupling_surrogate_p", ints="video", texts="pair", doubles="coupled p")
def _(spark, d):
    p = pose(spark, d)
    return LB.coupling_surrogate_p(LB.limb_pairs(limb_rows(spark, d)), lengths(p), CP, draws=9)


CH = "ch AS (SELECT * FROM (VALUES ('L hand', 1, 3, 'L', 'hand'), ('R hand', 2, 4, 'R', 'hand'), ('L hip', 0, 1, 'L', 'hip'), ('R hip', 0, 2, 'R', 'hip')) AS c(chain, b, c, side, kind))"
TRIP = (
    f"{CH}, nx AS (SELECT video, frame, joint, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pose WINDOW w AS (PARTITION BY video, joint ORDER BY frame)), "
    "jj AS (SELECT mv.video, mv.frame, chain, side, kind, mv.nx - mv.x AS vx, mv.ny - mv.y AS vy, mv.nx - pa.nx AS ux, mv.ny - pa.ny AS uy, "
    "sqrt(pow(pa.nx - pa.x, 2) + pow(pa.ny - pa.y, 2)) AS sb, sqrt(pow(nk.nx - mh.nx, 2) + pow(nk.ny - mh.ny, 2)) AS trunk FROM ch JOIN nx mv ON mv.joint = ch.c JOIN nx pa ON pa.joint = ch.b "
    "AND pa.video = mv.video AND pa.frame = mv.frame JOIN nx nk ON nk.joint = 1 AND nk.video = mv.video AND nk.frame = mv.frame JOIN nx mh ON mh.joint = 0 AND mh.video = mv.video AND mh.frame = mv.frame "
    "WHERE mv.nx IS NOT NULL), tri AS (SELECT video, frame, chain, side, kind, CASE WHEN sqrt(ux*ux+uy*uy) > 0 THEN 100 * sqrt(vx*vx+vy*vy) / sqrt(ux*ux+uy*uy) END AS r, "
    "atan2(ux*vy - uy*vx + 0.0, ux*vx + uy*vy + 0.0) AS alpha, CASE WHEN trunk > 0 THEN 100 * sb / trunk END AS q FROM jj)"
)


def triplets(spark, d):
    return E.motion_triplet(pose(spark, d), CHAINS, 1, 0)


@register("motion_triplet", ints="video frame", texts="chain side kind", doubles="r alpha q", sql=f"WITH {POSES}, {TRIP} SELECT * FROM tri")
def _(spark, d):
    return triplets(spark, d)


BINX = "((CAST(ceil((alpha + pi()) / 2 / pi() * 8) AS BIGINT) - 1 + 8) % 8)"


@register(
    "direction_entropy", ints="video", texts="chain", doubles="entropy",
    sql=f"WITH {POSES}, {TRIP}, h AS (SELECT video, chain, {BINX} AS b, count(*) AS n FROM tri GROUP BY 1, 2, 3), p AS (SELECT *, n / sum(n) OVER (PARTITION BY video, chain) AS p FROM h) "
    "SELECT video, chain, -sum(p * ln(p)) / ln(8) AS entropy FROM p GROUP BY 1, 2",
)
def _(spark, d):
    return E.direction_entropy(triplets(spark, d), ["video", "chain"], "alpha")


EP = E.EntropyParams(r_min=20.0, r_max=200.0, tau_hip=120.0, tau_hand=150.0, window=10, stride=4, nu=0.2)
WSC = (
    f"{LEN}, ws AS (SELECT video, unnest(range(0, (n - 1) - 9 + 1, 4)) AS start FROM ln WHERE n - 1 >= 9), "
    f"wr AS (SELECT t.*, start, {BINX} AS b, CASE WHEN r BETWEEN 20 AND 200 THEN 1 ELSE 0 END AS band, CASE WHEN (kind = 'hip' AND r <= 120) OR (kind = 'hand' AND q <= 150) THEN 1 ELSE 0 END AS small "
    "FROM ws JOIN tri t ON t.video = ws.video AND t.frame >= start AND t.frame < start + 9), "
    "cnt AS (SELECT video, chain, side, kind, start, sum(small) AS n_small, sum(band) AS n_band FROM wr GROUP BY 1, 2, 3, 4, 5), "
    "hh AS (SELECT video, chain, start, b, count(*) AS n FROM wr WHERE band = 1 GROUP BY 1, 2, 3, 4), hp AS (SELECT video, chain, start, n / sum(n) OVER (PARTITION BY video, chain, start) AS p FROM hh), "
    "he AS (SELECT video, chain, start, -sum(p * ln(p)) / ln(8) AS e FROM hp GROUP BY 1, 2, 3), "
    "wsc AS (SELECT cnt.*, CASE WHEN n_small / 9.0 < (CASE kind WHEN 'hip' THEN 0.2 ELSE 0.3 END) THEN NULL WHEN n_band / 9.0 < 0.2 THEN 0.0 ELSE e END AS score "
    "FROM cnt LEFT JOIN he USING (video, chain, start))"
)


def scores(spark, d):
    p = pose(spark, d)
    return E.window_entropy_score(E.motion_triplet(p, CHAINS, 1, 0), lengths(p), EP)


@register("window_entropy_score", ints="video start n_small n_band", texts="chain side kind", doubles="score", sql=f"WITH {POSES}, {TRIP}, {WSC} SELECT * FROM wsc")
def _(spark, d):
    return scores(spark, d)


@register(
    "side_reduce", ints="video", texts="endpoint", doubles="s_l s_r scorable_l scorable_r value",
    sql=f"WITH {POSES}, {TRIP}, {WSC}, g AS (SELECT *, 'FF' AS endpoint FROM wsc UNION ALL SELECT *, 'FF_hip' FROM wsc WHERE kind = 'hip' UNION ALL SELECT *, 'FF_dist' FROM wsc WHERE kind = 'hand'), "
    "sd AS (SELECT video, endpoint, side, start, max(score) AS s FROM g GROUP BY 1, 2, 3, 4), rr AS (SELECT video, endpoint, side, count(s) / CAST(count(*) AS DOUBLE) AS cov, quantile_cont(s, 0.9) AS s9 FROM sd GROUP BY 1, 2, 3), "
    "w AS (SELECT video, endpoint, max(CASE WHEN side = 'L' THEN s9 END) AS s_l, max(CASE WHEN side = 'R' THEN s9 END) AS s_r, max(CASE WHEN side = 'L' THEN cov END) AS scorable_l, "
    "max(CASE WHEN side = 'R' THEN cov END) AS scorable_r FROM rr GROUP BY 1, 2) SELECT *, CASE WHEN scorable_l >= 0.25 AND scorable_r >= 0.25 AND s_l IS NOT NULL AND s_r IS NOT NULL THEN least(s_l, s_r) END AS value FROM w",
)
def _(spark, d):
    return E.side_reduce(scores(spark, d))


@register("chain_coverage", ints="video", texts="chain", doubles="coverage",
          sql=f"WITH {POSES}, {TRIP}, {WSC} SELECT video, chain, count(score) / CAST(count(*) AS DOUBLE) AS coverage FROM wsc GROUP BY 1, 2")
def _(spark, d):
    return E.chain_coverage(scores(spark, d))


@register("rolling_counts", ints="video frame n_band", texts="chain",
          sql=f"WITH {POSES}, {TRIP}, rl AS (SELECT video, chain, frame, sum(CASE WHEN r BETWEEN 20 AND 200 THEN 1 ELSE 0 END) OVER (PARTITION BY video, chain ORDER BY frame ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS n_band "
          "FROM tri) SELECT * FROM rl WHERE frame >= 8")
def _(spark, d):
    p = pose(spark, d)
    c = WN.rolling_counts(E.motion_triplet(p, CHAINS, 1, 0), ["video", "chain"], F.col("r").between(20, 200), 10, lengths(p))
    return c.withColumnRenamed("count", "n_band")


@register(
    "calibrate_band", ints="chosen_window chosen_stride", doubles="q75 scale r_min r_max nu",
    sql=f"WITH {POSES}, {TRIP}, c AS (SELECT quantile_cont(r, 0.75) AS q75 FROM tri), s AS (SELECT q75, q75 / sqrt(4.5 * 8.0) AS scale FROM c), "
    "f AS (SELECT video, chain, frame, CASE WHEN r BETWEEN 4.5 * scale AND 8.0 * scale THEN 1 ELSE 0 END AS b FROM tri, s), "
    + ", ".join(
        f"m{L} AS (SELECT quantile_cont(n, 0.5) AS med FROM (SELECT frame, sum(b) OVER (PARTITION BY video, chain ORDER BY frame ROWS BETWEEN {L - 2} PRECEDING AND CURRENT ROW) AS n FROM f) WHERE frame >= {L - 2})"
        for L in (6, 12, 18))
    + ", l AS (SELECT CASE WHEN (SELECT med FROM m6) >= 3 THEN 6 WHEN (SELECT med FROM m12) >= 3 THEN 12 ELSE 18 END AS L) "
    "SELECT q75, scale, 4.5 * scale AS r_min, 8.0 * scale AS r_max, L AS chosen_window, greatest(CAST(round(0.4 * L) AS BIGINT), 1) AS chosen_stride, 3.0 / L AS nu FROM s, l",
)
def _(spark, d):
    p = pose(spark, d)
    prm, info = E.calibrate_band(E.motion_triplet(p, CHAINS, 1, 0), lengths(p), min_samples=3, grid=(6, 12, 18))
    return spark.createDataFrame(
        [(prm.window, prm.stride, info["q75"], info["scale"], prm.r_min, prm.r_max, prm.nu)],
        "chosen_window int, chosen_stride int, q75 double, scale double, r_min double, r_max double, nu double",
    )


MISS = f"{KP}, {DENSE}"


@register(
    "quality_report", ints="video n_rows n_frames frame_gaps contiguous missing_frames",
    sql=f"WITH {KP} SELECT video, count(*) AS n_rows, count(DISTINCT frame) AS n_frames, max(frame) - min(frame) + 1 - count(DISTINCT frame) AS frame_gaps, "
    "max(frame) - min(frame) + 1 = count(DISTINCT frame) AS contiguous, count(DISTINCT CASE WHEN x IS NULL OR y IS NULL THEN frame END) AS missing_frames FROM kp GROUP BY 1",
)
def _(spark, d):
    return QL.quality_report(keypoints(spark, d))


@register(
    "joint_spread_report", ints="joint constant documented", doubles="sd_x sd_y",
    sql=f"WITH {POSES} SELECT joint, stddev_pop(x) AS sd_x, stddev_pop(y) AS sd_y, stddev_pop(x) < 1e-9 AND stddev_pop(y) < 1e-9 AS constant, joint = 0 AS documented FROM pose GROUP BY 1",
)
def _(spark, d):
    return QL.joint_spread_report(pose(spark, d), [0])


MP = (
    "pred AS (SELECT video, frame, joint, x + sin(joint + frame) AS px, y + cos(joint * frame) AS py, (frame + joint) % 3 <> 0 AS visible, x, y FROM pose), "
    "er AS (SELECT *, sqrt(pow(px - x, 2) + pow(py - y, 2)) AS e FROM pred)"
)


def _prediction(spark, d):
    p = pose(spark, d)
    pred = p.select("video", "frame", "joint", (F.col("x") + F.sin(F.col("joint") + F.col("frame"))).alias("x"), (F.col("y") + F.cos(F.col("joint") * F.col("frame"))).alias("y"))
    mask = p.select("video", "frame", "joint", ((F.col("frame") + F.col("joint")) % 3 != 0).alias("visible"))
    return p, pred, mask


@register("mpjpe", doubles="error error_visible error_hidden ratio",
          sql=f"WITH {POSES}, {MP} SELECT avg(e) AS error, avg(CASE WHEN visible THEN e END) AS error_visible, avg(CASE WHEN NOT visible THEN e END) AS error_hidden, "
          "avg(CASE WHEN NOT visible THEN e END) / avg(CASE WHEN visible THEN e END) AS ratio FROM er")
def _(spark, d):
    return QL.mpjpe_split(QL.joint_errors(*_prediction(spark, d)))


@register("mpjpe_per_joint", ints="joint", doubles="error", sql=f"WITH {POSES}, {MP} SELECT joint, avg(e) AS error FROM er GROUP BY 1")
def _(spark, d):
    return QL.mpjpe_by(QL.joint_errors(*_prediction(spark, d)), ["joint"])


@register("mpjpe_per_frame", ints="frame", doubles="error", sql=f"WITH {POSES}, {MP} SELECT frame, avg(e) AS error FROM er GROUP BY 1")
def _(spark, d):
    return QL.mpjpe_by(QL.joint_errors(*_prediction(spark, d)), ["frame"])


@register("pose_l1_and_bone_error", doubles="l1 bone_error",
          sql=f"WITH {POSES}, {MP}, bt AS (SELECT abs(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) - sqrt(pow(a.px-b.px,2)+pow(a.py-b.py,2))) AS d FROM pred a JOIN pred b USING (video, frame) WHERE a.joint = 0 AND b.joint > 0) "
          "SELECT (SELECT avg((abs(px - x) + abs(py - y)) / 2) FROM pred) AS l1, (SELECT avg(d) FROM bt) AS bone_error")
def _(spark, d):
    p, pred, _ = _prediction(spark, d)
    return QL.l1_and_bone_error(p, pred, BONES)


@register("pathology_gap", doubles="error error_masked gap",
          sql=f"WITH {POSES}, {MP} SELECT avg(e) AS error, avg(e) * 0.8 AS error_masked, 0.2 AS gap FROM er", digits=6)
def _(spark, d):
    e = QL.joint_errors(*_prediction(spark, d))
    return QL.pathology_gap(e, e.withColumn("error", F.col("error") * 0.8))


@register("reconstruction_mse", ints="video", doubles="mse mse_hidden mse_velocity",
          sql=f"WITH {POSES}, {MP}, dv AS (SELECT video, lead(px - x) OVER w - (px - x) AS dx, lead(py - y) OVER w - (py - y) AS dy FROM pred WINDOW w AS (PARTITION BY video, joint ORDER BY frame)), "
          "v AS (SELECT video, avg((dx*dx + dy*dy) / 2) AS mv FROM dv GROUP BY 1), a AS (SELECT video, avg((pow(px-x,2)+pow(py-y,2)) / 2) AS mse, "
          "sum(CASE WHEN NOT visible THEN pow(px-x,2)+pow(py-y,2) ELSE 0 END) / greatest(2 * sum(CASE WHEN NOT visible THEN 1 ELSE 0 END), 1) AS mse_hidden FROM pred GROUP BY 1) "
          "SELECT video, mse, mse_hidden, coalesce(mv, 0) AS mse_velocity FROM a JOIN v USING (video)")
def _(spark, d):
    return QL.reconstruction_mse(*_prediction(spark, d))
