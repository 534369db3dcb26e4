"""Shared SQL building blocks for the check queries (DuckDB dialect)."""

CODE = (
    "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 "
    "WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END"
)

# state paths
SP = (
    "sp AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS m, "
    f"{CODE} AS state FROM events)"
)
# run-length compressed visits
VISITS = (
    "chg AS (SELECT *, CASE WHEN lag(state) OVER w IS NULL OR lag(state) OVER w <> state THEN 1 ELSE 0 END AS c "
    "FROM sp WINDOW w AS (PARTITION BY video ORDER BY m)), "
    "isl AS (SELECT *, sum(c) OVER (PARTITION BY video ORDER BY m) - 1 AS visit FROM chg), "
    "visits AS (SELECT video, visit, min(state) AS state, count(*) AS dwell, min(m) AS m0 FROM isl GROUP BY 1, 2)"
)
# sparse keypoints
KP = (
    f"kp AS (SELECT user_id AS video, CAST(day(ts) - 1 AS BIGINT) AS frame, {CODE} AS joint, avg(value) AS x, "
    "avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS y FROM events GROUP BY 1, 2, 3)"
)
# dense grid: frames shifted to 0, every frame x joint present
DENSE = (
    "rng AS (SELECT video, min(frame) AS f0, max(frame) AS f1 FROM kp GROUP BY 1), "
    "grid AS (SELECT video, unnest(range(0, f1 - f0 + 1)) AS frame, f0 FROM rng), "
    "gj AS (SELECT g.video, g.frame, g.f0, j.joint FROM grid g, (VALUES (0),(1),(2),(3),(4)) AS j(joint)), "
    "dense AS (SELECT gj.video, gj.frame, gj.joint, kp.x, kp.y FROM gj LEFT JOIN kp "
    "ON kp.video = gj.video AND kp.frame = gj.frame + gj.f0 AND kp.joint = gj.joint)"
)


def _fill(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN p{c} IS NULL AND n{c} IS NULL THEN 0.0 WHEN p{c} IS NULL THEN n{c} "
        f"WHEN n{c} IS NULL THEN p{c} ELSE p{c} + (n{c} - p{c}) * (frame - pf{c}) / (nf{c} - pf{c}) END AS {c}"
    )


def _sides(c: str) -> str:
    return (
        f"last_value({c} IGNORE NULLS) OVER b AS p{c}, first_value({c} IGNORE NULLS) OVER a AS n{c}, "
        f"last_value(CASE WHEN {c} IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS pf{c}, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS nf{c}"
    )


# gap-free poses
POSE = (
    f"sides AS (SELECT *, {_sides('x')}, {_sides('y')} FROM dense WINDOW "
    "b AS (PARTITION BY video, joint ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "a AS (PARTITION BY video, joint ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), "
    f"pose AS (SELECT video, frame, joint, {_fill('x')}, {_fill('y')} FROM sides)"
)
# displacement rows, fps 10
VEL = (
    "vel AS (SELECT * FROM (SELECT video, frame, joint, (lead(x) OVER w - x) * 10.0 AS vx, (lead(y) OVER w - y) * 10.0 AS vy, "
    "FROM pose WINDOW w AS (PARTITION BY video, joint ORDER BY frame)) WHERE vx IS NOT NULL)"
)
# long latents
LAT = (
    "lat AS (SELECT vec_id AS clip_id, label AS video, vec_id AS start_frame, CAST(unnest(embedding) AS DOUBLE) AS mu, "
    "generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"
)
POSES = f"{KP}, {DENSE}, {POSE}"
PATHS = f"{SP}, {VISITS}"
