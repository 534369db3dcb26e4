"""State profiles and the similarity of states built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def state_moments(frames: DataFrame, vel: DataFrame) -> DataFrame:
    """state, joint, n_frames, sxx, sxy, syy, a over the frames of each state.

    ``frames`` is video, state, frame (a set).  Missing velocities add nothing
    to the sums, yet their frames count in ``n_frames``.
    """
    counts = frames.groupBy("state").agg(F.count("*").alias("n_frames"))
    known = vel.where("vx IS NOT NULL AND vy IS NOT NULL")
    sums = frames.join(known.hint("merge"), ["video", "frame"]).groupBy("state", "joint").agg(
        F.sum(F.col("vx") * F.col("vx")).alias("sxx"), F.sum(F.col("vx") * F.col("vy")).alias("sxy"),
        F.sum(F.col("vy") * F.col("vy")).alias("syy"),
    )
    m = sums.join(F.broadcast(counts), "state")  # at most K rows
    out = m.select("state", "joint", "n_frames", *[(F.col(c) / F.col("n_frames")).alias(f"m{c[1:]}") for c in ("sxx", "sxy", "syy")])
    return out.withColumn("a", F.sqrt(F.col("mxx") + F.col("myy")))


def shape_coordinates(moments: DataFrame) -> DataFrame:
    """u1, u2, anisotropy and axis angle of each second-moment matrix; zero trace gives 0."""
    tr = F.col("mxx") + F.col("myy")
    u1 = F.when(tr > 0, (F.col("mxx") - F.col("myy")) / tr).otherwise(0.0)
    u2 = F.when(tr > 0, 2.0 * F.col("mxy") / tr).otherwise(0.0)
    s = moments.withColumns({"u1": u1, "u2": u2})
    return s.withColumns({"anisotropy": F.hypot("u1", "u2"), "axis": 0.5 * F.atan2("u2", "u1")})


def double_center(df: DataFrame, row: str, col: str, value: str, rows_too: bool = True) -> DataFrame:
    """value - column mean (- row mean + grand mean).  The table is K states by J joints."""
    cm = F.avg(value).over(W.partitionBy(col))
    if not rows_too:
        return df.withColumn(value, F.col(value) - cm)
    rm = F.avg(value).over(W.partitionBy(row))
    gm = F.avg(value).over(W.partitionBy(F.lit(0)))
    return df.withColumn(value, F.col(value) - cm - rm + gm)


def _pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every ordered pair of states joined on the joint: K x K x J rows, K and J fixed by the model."""
    a = df.select(F.col("state"), "joint", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = df.select(F.col("state").alias("next_state"), "joint", *[F.col(c).alias(f"{c}_b") for c in cols])
    return a.join(b, "joint")


def _cosine(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    p = _pairs(df, cols)

    def tot(x, y):
        return sum((F.sum(F.col(f"{c}_{x}") * F.col(f"{c}_{y}")) for c in cols), F.lit(0.0))

    s = p.groupBy("state", "next_state").agg(tot("a", "b").alias("ab"), tot("a", "a").alias("aa"), tot("b", "b").alias("bb"))

    def length(c):  # a zero profile has norm 1 by convention, so its cosine is 0
        return F.when(F.sqrt(c) < 1e-12, 1.0).otherwise(F.sqrt(c))

    cos = F.col("ab") / length("aa") / length("bb")
    return s.select("state", "next_state", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)).alias("s"))


def log_magnitude(moments: DataFrame, joints: Sequence[int]) -> DataFrame:
    return moments.where(F.col("joint").isin(list(joints))).select("state", "joint", F.ln(F.greatest("a", F.lit(1e-12))).alias("g"))


def similarity_magnitude(moments: DataFrame, joints: Sequence[int], centring: str = "double") -> DataFrame:
    """Row correlation of log magnitudes: state, next_state, s."""
    g = log_magnitude(moments, joints)
    if centring == "double":
        g = double_center(g, "state", "joint", "g")
    row = F.avg("g").over(W.partitionBy("state"))
    return _cosine(g.withColumn("g", F.col("g") - row), ["g"])


def residual_shape(moments: DataFrame, joints: Sequence[int]) -> DataFrame:
    u = shape_coordinates(moments).where(F.col("joint").isin(list(joints))).select("state", "joint", "u1", "u2")
    return double_center(double_center(u, "state", "joint", "u1"), "state", "joint", "u2")


def similarity_shape(moments: DataFrame, joints: Sequence[int]) -> DataFrame:
    return _cosine(residual_shape(moments, joints), ["u1", "u2"])


def orientation_similarity(moments: DataFrame, joints: Sequence[int]) -> DataFrame:
    """Sum of axis dot products over the sum of their norms; NULL when the weight vanishes."""
    u = residual_shape(moments, joints)
    p = _pairs(u, ["u1", "u2"])
    s = p.groupBy("state", "next_state").agg(
        F.sum(F.col("u1_a") * F.col("u1_b") + F.col("u2_a") * F.col("u2_b")).alias("dot"),
        F.sum(F.hypot("u1_a", "u2_a") * F.hypot("u1_b", "u2_b")).alias("weight"),
    )
    return s.select("state", "next_state", F.when(F.col("weight") > 1e-12, F.col("dot") / F.col("weight")).alias("s"))


def similarity_direction_aware(moments: DataFrame, joints: Sequence[int], omega: float, form: str = "separated") -> DataFrame:
    """Blend of magnitude and shape similarity, or one correlation over three standardised channels."""
    if not 0.0 <= omega <= 1.0:
        raise ValueError("omega must lie in [0, 1]")
    if form == "separated":
        a = similarity_magnitude(moments, joints)
        b = similarity_shape(moments, joints).withColumnRenamed("s", "s2")
        return a.join(b, ["state", "next_state"]).select(
            "state", "next_state", (F.lit(omega) * F.col("s") + F.lit(1.0 - omega) * F.col("s2")).alias("s")
        )
    if form == "scalar":
        return similarity_magnitude(moments, joints)
    if form != "concatenated":
        raise ValueError(f"unknown form {form!r}")
    g = double_center(log_magnitude(moments, joints), "state", "joint", "g")
    wide = g.join(residual_shape(moments, joints), ["state", "joint"])
    every = W.partitionBy(F.lit(0))  # K x J rows
    wide = wide.withColumns({
        c: F.col(c) / F.when(F.stddev_pop(c).over(every) > 0, F.stddev_pop(c).over(every)).otherwise(1.0) for c in ("g", "u1", "u2")
    })
    row = F.avg((F.col("g") + F.col("u1") + F.col("u2")) / 3.0).over(W.partitionBy("state"))
    return _cosine(wide.withColumns({c: F.col(c) - row for c in ("g", "u1", "u2")}), ["g", "u1", "u2"])


def top_bottom_pairs(similarity: DataFrame, n: int = 5) -> DataFrame:
    """The n most and n least similar pairs of different states."""
    half = similarity.where("state < next_state")
    top = half.orderBy(F.col("s").desc(), "state", "next_state").limit(n).withColumn("tail", F.lit("top"))
    low = half.orderBy("s", "state", "next_state").limit(n).withColumn("tail", F.lit("bottom"))
    return top.unionByName(low)


def tercile_decomposition(similarity: DataFrame, jumps: DataFrame) -> DataFrame:
    """Share of visit transitions per tercile of off-diagonal similarity against that tercile's share of state pairs.

    ``jumps`` is state, next_state, n.  Terciles nothing falls into have no row;
    ``degenerate`` says that fewer than three are filled, ``top_over_bottom``
    compares the outermost filled ones.
    """
    off = similarity.where("state <> next_state")
    every = W.partitionBy(F.lit(0))  # K(K-1) rows
    q1, q2 = F.percentile("s", F.lit(1 / 3)).over(every), F.percentile("s", F.lit(2 / 3)).over(every)
    binned = off.withColumns({"_q1": q1, "_q2": q2})
    tier = F.when(F.col("s") <= F.col("_q1"), 0).when(F.col("s") <= F.col("_q2"), 1).otherwise(2)
    j = binned.select("state", "next_state", tier.alias("tercile")).join(jumps, ["state", "next_state"], "left")
    t = j.groupBy("tercile").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.count("*").alias("n_pairs"))
    t = t.withColumns({"observed": F.col("n") / F.sum("n").over(every), "expected": F.col("n_pairs") / F.sum("n_pairs").over(every)})
    t = t.withColumn("rate_ratio", F.col("observed") / F.col("expected"))
    low, high = F.min_by("rate_ratio", "tercile").over(every), F.max_by("rate_ratio", "tercile").over(every)
    n = F.count("*").over(every)
    return t.withColumns({"degenerate": n < 3, "top_over_bottom": F.when((n >= 2) & (low > 0), high / low)})
