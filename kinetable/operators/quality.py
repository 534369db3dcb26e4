"""Input quality, reconstruction error, code usage, attention and endpoint summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetable.operators.frames import dims_of, norm
from kinetable.operators.kinematics import bone_lengths
from kinetable.plans.chunks import shift
from kinetable.plans.quantiles import bounded_quantiles, exact_quantiles


def quality_report(kp: DataFrame) -> DataFrame:
    """Rows, frames, gaps and frames with a missing coordinate per recording.

    Counting goes over one row per frame, so no distinct set is held per recording.
    """
    miss = None
    for v in dims_of(kp):
        miss = F.col(v).isNull() if miss is None else miss | F.col(v).isNull()
    frame = kp.groupBy("video", "frame").agg(F.count("*").alias("n"), F.max(miss).alias("miss"))
    width = F.max("frame") - F.min("frame") + 1
    return frame.groupBy("video").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_frames"), (width - F.count("*")).alias("frame_gaps"),
        (width == F.count("*")).alias("contiguous"), F.count_if("miss").alias("missing_frames"),
    )


def joint_spread_report(pose: DataFrame, documented: Sequence[int], eps: float = 1e-9) -> DataFrame:
    """Spread of every joint; constant joints against the documented ones."""
    dims = dims_of(pose)
    g = pose.groupBy("joint").agg(*[F.stddev_pop(v).alias(f"sd_{v}") for v in dims])
    still = F.lit(True)
    for v in dims:
        still = still & (F.col(f"sd_{v}") < eps)
    return g.withColumns({"constant": still, "documented": F.col("joint").isin(list(documented))})


def joint_errors(truth: DataFrame, pred: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Distance per (video, frame, joint) with the visibility flag if given."""
    dims = dims_of(truth)
    j = truth.join(pred.select("video", "frame", "joint", *[F.col(v).alias(f"p{v}") for v in dims]).hint("merge"), ["video", "frame", "joint"])
    if mask is not None:
        j = j.join(mask.hint("merge"), ["video", "frame", "joint"])
    return j.withColumn("error", norm([F.col(f"p{v}") - F.col(v) for v in dims]))


def mpjpe_split(errors: DataFrame) -> DataFrame:
    """One row: mean joint error overall, over visible and hidden cells, and hidden / visible."""
    vis, hid = F.avg(F.when(F.col("visible"), F.col("error"))), F.avg(F.when(~F.col("visible"), F.col("error")))
    return errors.agg(F.avg("error").alias("error"), vis.alias("error_visible"), hid.alias("error_hidden"), (hid / vis).alias("ratio"))


def mpjpe_by(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    return errors.groupBy(*keys).agg(F.avg("error").alias("error"))


def pathology_gap(errors: DataFrame, errors_without: DataFrame) -> DataFrame:
    """(e - e_without) / e of two error tables."""
    a = errors.agg(F.avg("error").alias("error")).withColumn("_k", F.lit(1))
    b = errors_without.agg(F.avg("error").alias("error_masked")).withColumn("_k", F.lit(1))
    return a.join(F.broadcast(b), "_k").drop("_k").withColumn("gap", (F.col("error") - F.col("error_masked")) / F.col("error"))


def l1_and_bone_error(truth: DataFrame, pred: DataFrame, bones: Sequence[tuple[int, int]]) -> DataFrame:
    """One row: mean absolute coordinate error and mean absolute bone-length error."""
    dims = dims_of(truth)
    j = joint_errors(truth, pred)
    l1 = j.agg((F.avg(sum((F.abs(F.col(f"p{v}") - F.col(v)) for v in dims), F.lit(0.0))) / len(dims)).alias("l1")).withColumn("_k", F.lit(1))
    keys = ["video", "frame"]
    a, b = bone_lengths(truth, bones, keys), bone_lengths(pred, bones, keys).withColumnRenamed("length", "other")
    be = a.join(b.hint("merge"), [*keys, "bone"]).agg(F.avg(F.abs(F.col("length") - F.col("other"))).alias("bone_error")).withColumn("_k", F.lit(1))
    return l1.join(F.broadcast(be), "_k").drop("_k")


def reconstruction_mse(truth: DataFrame, pred: DataFrame, mask: DataFrame) -> DataFrame:
    """Per recording: mean squared error, over hidden coordinates only, and of first differences (0 below 2 frames)."""
    dims = dims_of(truth)
    j = joint_errors(truth, pred, mask).select("video", "frame", "joint", "visible", *[(F.col(f"p{v}") - F.col(v)).alias(f"d{v}") for v in dims])
    s = shift(j, ["video", "joint"], "frame", {f"n{v}": (f"d{v}", 1) for v in dims})
    sq = sum((F.col(f"d{v}") * F.col(f"d{v}") for v in dims), F.lit(0.0))
    vq = sum(((F.col(f"n{v}") - F.col(f"d{v}")) ** 2 for v in dims), F.lit(0.0))
    hidden = F.sum(F.when(~F.col("visible"), sq).otherwise(0.0))
    n_hidden = F.greatest(F.count_if(~F.col("visible")) * len(dims), F.lit(1))
    return s.groupBy("video").agg(
        (F.avg(sq) / len(dims)).alias("mse"), (hidden / n_hidden).alias("mse_hidden"),
        F.coalesce(F.avg(vq) / len(dims), F.lit(0.0)).alias("mse_velocity"),
    )


def codebook_usage(tokens: DataFrame, n_codes: int) -> DataFrame:
    """Distinct codes seen over codes available, per layer."""
    return tokens.select("layer", "code").distinct().groupBy("layer").agg((F.count("*") / F.lit(n_codes)).alias("usage"))


def code_class_cooccurrence(tokens: DataFrame, class_col: str) -> DataFrame:
    """Per layer and code: top class, its share (purity) and the code's share of tokens.

    Counts are merged per (layer, code, class) before any code is looked at whole.
    """
    n = tokens.groupBy("layer", "code", class_col).agg(F.count("*").alias("n"))
    code = n.groupBy("layer", "code").agg(
        F.sum("n").alias("total"), F.max(F.struct("n", (F.lit(-1) * F.col(class_col)).alias("neg"))).alias("_top")
    )
    share = F.col("total") / F.sum("total").over(W.partitionBy("layer"))
    return code.select("layer", "code", "total", (-F.col("_top.neg")).alias("top_class"), (F.col("_top.n") / F.col("total")).alias("purity"), share.alias("weight"))


def mean_purity(codes: DataFrame) -> DataFrame:
    return codes.groupBy("layer").agg((F.sum(F.col("purity") * F.col("weight")) / F.sum("weight")).alias("mean_purity"))


def attention_entropy(att: DataFrame, focus: float = 0.5) -> DataFrame:
    """head, entropy (mean over clips of -sum a ln a), focused (entropy at or below the given quantile over heads)."""
    term = -F.col("a") * F.ln(F.greatest(F.col("a"), F.lit(1e-12)))
    clip = att.groupBy("clip_id", "head").agg(F.sum(term).alias("e"))
    h = clip.groupBy("head").agg(F.avg("e").alias("entropy"))
    cut = F.percentile("entropy", F.lit(float(focus))).over(W.partitionBy(F.lit(0)))  # one row per head
    return h.withColumn("focused", F.col("entropy") <= cut)


def head_correlation(att: DataFrame, n_heads: int) -> DataFrame:
    """Mean over clips of the correlation of two heads' attention over time: head_a < head_b.

    Heads of one time step meet in one short array; moments are then summed.
    """
    t = att.groupBy("clip_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("head", "a"))).alias("m"))
    pairs = F.array(*[F.struct(F.lit(i).alias("head_a"), F.lit(j).alias("head_b")) for i in range(n_heads) for j in range(i + 1, n_heads)])
    p = t.withColumn("p", F.explode(pairs)).select(
        "clip_id", "p.*", F.try_element_at("m", F.col("p.head_a")).alias("u"), F.try_element_at("m", F.col("p.head_b")).alias("v")
    )
    c = p.groupBy("clip_id", "head_a", "head_b").agg(F.corr("u", "v").alias("c"))
    return c.groupBy("head_a", "head_b").agg(F.avg(F.when(~F.isnan("c"), F.col("c"))).alias("mean_corr"))


def attention_motion_cosine(att: DataFrame, motion: DataFrame) -> DataFrame:
    """Per clip: cosine of centred head-averaged attention and centred motion over time."""
    a = att.groupBy("clip_id", "t").agg(F.avg("a").alias("a"))
    j = a.join(motion.hint("merge"), ["clip_id", "t"])
    return j.groupBy("clip_id").agg(F.corr("a", "motion").alias("cosine"))


def endpoint_summary(endpoints: DataFrame, groups: DataFrame) -> DataFrame:
    """Per endpoint: scored recordings, medians overall and by label, their difference, share above 0."""
    e = endpoints.join(groups, "video")
    n = e.groupBy("endpoint").agg(
        F.count("value").alias("n_scored"), F.count(F.when(F.col("label") == 1, F.col("value"))).alias("n_abnormal"),
        F.count_if(F.col("value") > 0).alias("n_positive"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
    )
    med = exact_quantiles(e, ["endpoint"], "value", {"median_all": 0.5})
    by = exact_quantiles(e, ["endpoint", "label"], "value", {"m": 0.5}).groupBy("endpoint").agg(
        F.max(F.when(F.col("label") == 0, F.col("m"))).alias("median_normal"), F.max(F.when(F.col("label") == 1, F.col("m"))).alias("median_abnormal")
    )
    return n.join(med, "endpoint", "left").join(by, "endpoint", "left").withColumn("median_difference", F.col("median_abnormal") - F.col("median_normal"))
