"""State paths: visits, occupancy, dwell, transitions and the walk-level table.

A path is ``video, m, state`` with m = 0, 1, ... in each video; ``K`` states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetable.plans.chunks import CHUNK, over_halo, prefix_sum, shift
from kinetable.plans.quantiles import exact_quantiles
from kinetable.session import cut_lineage

PATH_KEYS = ["video"]


def states_dimension(df: DataFrame, k: int) -> DataFrame:
    """The K state numbers as rows."""
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias("state"))


def zero_fill_states(keys: DataFrame, k: int) -> DataFrame:
    """Every key with every state; K is a model constant, so this is an explode, not a join."""
    return keys.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def visit_sequence(path: DataFrame, keys: Sequence[str] = PATH_KEYS, size: int = CHUNK) -> DataFrame:
    """Run-length compression inside each recording: keys, visit, state, dwell, m0."""
    keys = list(keys)
    p = shift(path.select(*keys, "m", "state"), keys, "m", {"_prev": ("state", -1)}, size)
    change = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("state")), 1).otherwise(0)
    p = prefix_sum(p.withColumn("_c", change), keys, "m", {"visit": "_c"}, size)
    return p.groupBy(*keys, (F.col("visit") - 1).alias("visit")).agg(
        F.min("state").alias("state"), F.count("*").alias("dwell"), F.min("m").alias("m0")
    )


def occupancy(path: DataFrame, k: int, keys: Sequence[str] = PATH_KEYS) -> DataFrame:
    """Share of windows in each state per key group (no keys: overall), zeros included."""
    keys = list(keys)
    wide = path.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col("state") == s).alias(f"_s{s}") for s in range(k)]
    )
    long = wide.select(*keys, "_n", F.posexplode(F.array(*[F.col(f"_s{s}") for s in range(k)])).alias("state", "n"))
    return long.select(*keys, "state", "n", (F.col("n") / F.col("_n")).alias("occupancy"))


def group_state_usage(path: DataFrame, labels: DataFrame, k: int, group: str) -> DataFrame:
    """Occupancy by a recording-level label; recordings without one are left out."""
    known = labels.where(F.col(group).isNotNull()).select("video", group)
    return occupancy(path.join(known, "video"), k, [group])


def dwell_stats(path: DataFrame, k: int, f_win: float, keys: Sequence[str] = PATH_KEYS, by: Sequence[str] | None = None) -> DataFrame:
    """Run lengths in seconds per state: mean, median, max, sd.

    Runs never cross recordings.  A state that is not visited has mean NULL and
    median, max and sd 0.  ``by`` pools runs over recordings when given.
    """
    by = list(keys) if by is None else list(by)
    runs = visit_sequence(path, keys).withColumn("sec", F.col("dwell") / F.lit(float(f_win)))
    stats = runs.groupBy(*by, "state").agg(
        F.count("*").alias("n_runs"), F.avg("sec").alias("mean_dwell"), F.max("sec").alias("max_dwell"),
        F.stddev_pop("sec").alias("sd_dwell"),
    )
    med = exact_quantiles(runs, [*by, "state"], "sec", {"median_dwell": 0.5})
    stats = stats.join(med, [*by, "state"])
    base = path.select(*by).distinct() if by else path.sparkSession.range(1).select()
    full = zero_fill_states(base, k).join(stats, [*by, "state"], "left")
    return full.select(
        *by, "state", F.coalesce("n_runs", F.lit(0)).alias("n_runs"), "mean_dwell",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("median_dwell", "max_dwell", "sd_dwell")],
    )


def dwell_implied(transitions: DataFrame, f_win: float, duration: Column | None = None) -> DataFrame:
    """Expected dwell 1/(1-A_kk) in seconds from the diagonal; infinite at 1, or capped at a recording length."""
    stay = transitions.where("state = next_state")
    sec = F.when(F.col("p") >= 1, F.lit(float("inf"))).otherwise(1.0 / (1.0 - F.col("p"))) / F.lit(float(f_win))
    if duration is not None:
        sec = F.least(sec, duration)
    keys = [c for c in transitions.columns if c not in ("state", "next_state", "n", "p")]
    return stay.select(*keys, "state", sec.alias("implied_dwell"))


def transition_counts(path: DataFrame, k: int, keys: Sequence[str] = PATH_KEYS, by: Sequence[str] | None = None, lag: int = 1) -> DataFrame:
    """Counts of (state, next_state) inside recordings, zeros included, pooled over ``by``."""
    by = list(keys) if by is None else list(by)
    p = shift(path.select(*dict.fromkeys([*keys, *by, "m", "state"])), list(keys), "m", {"next_state": ("state", lag)})
    cells = [(s, t) for s in range(k) for t in range(k)]
    pair = F.col("state") * k + F.col("next_state")
    counts = p.groupBy(*by, pair.alias("_pair")).agg(F.count("*").alias("n")).where("_pair IS NOT NULL")
    base = path.select(*by).distinct() if by else path.sparkSession.range(1).select()
    grid = base.withColumn("_pair", F.explode(F.sequence(F.lit(0), F.lit(len(cells) - 1))))
    return grid.join(counts, [*by, "_pair"], "left").select(
        *by, F.floor(F.col("_pair") / k).cast("int").alias("state"), (F.col("_pair") % k).cast("int").alias("next_state"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def transition_matrix(counts: DataFrame, k: int, empty_row: str = "uniform") -> DataFrame:
    """Row-normalised counts; a row never left becomes uniform, or zeros with ``empty_row='zero'``."""
    keys = [c for c in counts.columns if c not in ("state", "next_state", "n")]
    row = F.sum("n").over(W.partitionBy(*keys, "state"))
    fill = F.lit(1.0 / k) if empty_row == "uniform" else F.lit(0.0)
    return counts.withColumn("p", F.when(row > 0, F.col("n") / row).otherwise(fill))


def jump_chain(matrix: DataFrame) -> DataFrame:
    """Transition matrix with its diagonal removed and rows renormalised; an empty row stays zero."""
    keys = [c for c in matrix.columns if c not in ("state", "next_state", "n", "p")]
    off = F.when(F.col("state") == F.col("next_state"), 0.0).otherwise(F.col("p"))
    m = matrix.withColumn("_off", off)
    row = F.sum("_off").over(W.partitionBy(*keys, "state"))
    return m.withColumn("jump", F.when(row > 0, F.col("_off") / row).otherwise(F.lit(0.0))).drop("_off")


def transition_entropy(matrix: DataFrame, k: int) -> DataFrame:
    """Sum of -p ln p over all positive cells divided by K (not by the number of visited rows)."""
    keys = [c for c in matrix.columns if c not in ("state", "next_state", "n", "p")]
    term = F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)
    return matrix.groupBy(*keys).agg((F.sum(term) / F.lit(float(k))).alias("trans_entropy"))


def transition_rate(path: DataFrame, f_win: float, keys: Sequence[str] = PATH_KEYS) -> DataFrame:
    """State changes per second of recording."""
    v = shift(path.select(*keys, "m", "state"), list(keys), "m", {"_prev": ("state", -1)})
    return v.groupBy(*keys).agg(
        (F.count_if(F.col("_prev") != F.col("state")) / (F.count("*") / F.lit(float(f_win)))).alias("trans_rate")
    )


def walk_metric_table(path: DataFrame, k: int, f_win: float, wide: bool = False) -> DataFrame:
    """occ_k, dwell_k (median), maxdwell_k, trans_rate and trans_entropy per recording, long or wide.

    Everything is read from the table of visits, made once: windows of a state are its dwells, stays are dwell - 1, and
    changes are neighbouring visits.  A row of the transition matrix with n windows out has entropy
    ln n - sum(c ln c) / n over its cells c.
    """
    visits = cut_lineage(visit_sequence(path))
    moves = shift(visits, ["video"], "visit", {"_next": ("state", 1)})
    log = lambda c: F.when(c > 0, c * F.ln(c)).otherwise(0.0)
    cells = moves.groupBy("video", "state", "_next").agg(F.count("*").alias("runs"), F.sum("dwell").alias("windows"), F.max("dwell").alias("longest"))
    out = F.col("_next").isNotNull()
    rows = cells.groupBy("video", "state").agg(
        F.sum("windows").alias("windows"), F.max("longest").alias("longest"), (F.sum("windows") - F.sum("runs")).alias("stays"),
        F.sum(F.when(out, F.col("runs")).otherwise(0)).alias("leaves"), F.sum(F.when(out, log(F.col("runs"))).otherwise(0.0)).alias("leaves_log"),
    )
    median = exact_quantiles(visits, ["video", "state"], "dwell", {"median": 0.5})
    n = F.col("stays") + F.col("leaves")
    entropy = F.when(n > 0, F.ln(n) - (log(F.col("stays")) + F.col("leaves_log")) / n).otherwise(0.0)
    each = rows.join(median, ["video", "state"]).groupBy("video").agg(
        F.sum("windows").alias("n"), F.sum("leaves").alias("changes"), (F.sum(entropy) / F.lit(float(k))).alias("entropy"),
        F.map_from_entries(F.collect_list(F.struct("state", F.struct("windows", "median", "longest")))).alias("of"),  # k entries at most
    )

    def metric(name, value):
        return F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))

    def of(s, field, unit):
        return F.coalesce(F.try_element_at("of", F.lit(s))[field] / unit, F.lit(0.0))

    sec = F.lit(float(f_win))
    values = [metric(f"{m}_{s}", of(s, field, unit)) for m, field, unit in (("occ", "windows", F.col("n")), ("dwell", "median", sec), ("maxdwell", "longest", sec)) for s in range(k)]
    values += [metric("trans_rate", F.col("changes") / (F.col("n") / sec)), metric("trans_entropy", F.col("entropy"))]
    if wide:
        return each.select("video", *[v["value"].alias(name) for v, name in zip(values, [f"{m}_{s}" for m in ("occ", "dwell", "maxdwell") for s in range(k)] + ["trans_rate", "trans_entropy"])])
    return each.select("video", F.explode(F.array(*values)).alias("m")).select("video", "m.metric", "m.value")


def subject_rollup(metrics: DataFrame, walks: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Subject mean of every metric over its walks, with the first known label of each kind by walk order."""
    keep = {c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("video"))).alias(c) for c in labels}
    named = walks.groupBy("subject").agg(*keep.values())
    mean = metrics.join(walks.select("video", "subject"), "video").groupBy("subject", "metric").agg(F.avg("value").alias("value"))
    return mean.join(named, "subject")


def occupancy_entropy(path: DataFrame, k: int) -> DataFrame:
    """Per recording: entropy of its occupancy and mean run length in windows."""
    occ = occupancy(path, k).groupBy("video").agg(
        F.sum(F.when(F.col("occupancy") > 0, -F.col("occupancy") * F.ln("occupancy")).otherwise(0.0)).alias("occ_entropy")
    )
    runs = visit_sequence(path).groupBy("video").agg(F.avg("dwell").alias("mean_run"))
    return occ.join(runs, "video")


def phenotype_vector(path: DataFrame, k: int, f_win: float) -> DataFrame:
    """One row per recording: occupancy and mean dwell of each state, 0 where a state is absent."""
    occ = occupancy(path, k).groupBy("video").pivot("state", list(range(k))).agg(F.first("occupancy"))
    occ = occ.select("video", *[F.col(str(s)).alias(f"occ_{s}") for s in range(k)])
    dw = dwell_stats(path, k, f_win).groupBy("video").pivot("state", list(range(k))).agg(F.first("mean_dwell"))
    dw = dw.select("video", *[F.coalesce(F.col(str(s)), F.lit(0.0)).alias(f"dwell_{s}") for s in range(k)])
    return occ.join(dw, "video")


def transition_times(path: DataFrame, f0: float, l: float, fps: float) -> DataFrame:
    """Second at which each visit after the first begins."""
    v = visit_sequence(path).where("visit > 0")
    return v.select("video", "visit", "state", ((F.lit(float(f0)) + F.lit(float(l)) * F.col("m0")) / F.lit(float(fps))).alias("t"))


def transition_lookup(path: DataFrame, similarity: DataFrame, lag: int = 1) -> DataFrame:
    """Similarity of each (state, state at +lag) pair; ``similarity`` is K x K long: state, next_state, s."""
    p = shift(path, ["video"], "m", {"next_state": ("state", lag)}).where("next_state IS NOT NULL")
    return p.join(F.broadcast(similarity), ["state", "next_state"])  # K x K rows


def label_frames_union(path: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Frames belonging to a state as the set union of its windows' spans [lo, hi): video, state, frame.

    Spans have a fixed width, so overlapping copies per frame are bounded and dropped once.
    """
    spans = path.withColumns({"_lo": lo, "_hi": hi}).where("_hi > _lo")
    frames = spans.select("video", "state", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)).alias("frame"))
    return frames.distinct()


def label_frames_exact(path: DataFrame, f0: int, l: int, n_frames: DataFrame) -> DataFrame:
    """Each window owns its l frames; frames outside the recording are dropped: video, frame, state."""
    p = path.join(n_frames, "video")
    start = F.lit(f0) + F.lit(l) * F.col("m")
    frames = p.select("video", "state", "n_frames", F.explode(F.sequence(start, start + l - 1)).alias("frame"))
    return frames.where("frame >= 0 AND frame < n_frames").drop("n_frames")


def similarity_curve(path: DataFrame, similarity: DataFrame, null_mean: DataFrame, sigma: float, size: int = CHUNK) -> DataFrame:
    """Gaussian-smoothed similarity along the transition index, minus the recording's null mean.

    The kernel weighs every transition of the recording.  Weights vanish to
    double precision beyond 40 sigma, so a halo of that width is the full sum.
    """
    v = visit_sequence(path).select("video", F.col("visit").alias("m"), "state")
    s = transition_lookup(v, similarity).select("video", F.col("m").alias("t"), "s")
    reach = int(40 * sigma) + 1
    near = over_halo(
        s, ["video"], "t",
        {"_near": lambda w: F.collect_list(F.struct("t", "s")).over(w.rangeBetween(-reach, reach))}, reach, reach, size,
    )

    def weight(u):
        return F.exp(-0.5 * F.pow((u - F.col("t")) / F.lit(float(sigma)), F.lit(2)))

    num = F.aggregate("_near", F.lit(0.0), lambda acc, e: acc + weight(e["t"]) * e["s"])
    den = F.aggregate("_near", F.lit(0.0), lambda acc, e: acc + weight(e["t"]))
    smooth = near.select("video", "t", (num / den).alias("smooth"))
    return smooth.join(null_mean, "video").select("video", "t", (F.col("smooth") - F.col("null_mean")).alias("curve"))
