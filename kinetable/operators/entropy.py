"""Direction entropy of limb chains and its reduction to one number per recording."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.operators.windows import entropy_windows, rolling_counts
from kinetable.plans.chunks import shift
from kinetable.plans.quantiles import bounded_quantiles, exact_quantiles


@dataclass(frozen=True)
class Chain:
    """A limb segment parent -> moving with its side (L/R) and class (hip/hand/foot)."""

    name: str
    parent: int
    moving: int
    side: str
    kind: str


@dataclass(frozen=True)
class EntropyParams:
    # fixed values: published thresholds (percent of limb or trunk per frame)
    r_min: float = 4.5
    r_max: float = 8.0
    tau_hip: float = 10.0
    tau_hand: float = 1.0
    tau_foot: float = 2.5
    window: int = 50
    stride: int = 20
    nu: float = 0.2
    bins: int = 8
    scale: float = 1.0


# fixed values: least share of small-amplitude rows per class, chains on the 15-joint layout
MIN_SMALL = {"hip": 0.2, "hand": 0.3, "foot": 0.1}
BODY15_CHAINS = [
    Chain("R hip", 9, 10, "R", "hip"), Chain("L hip", 12, 13, "L", "hip"),
    Chain("R hand", 3, 4, "R", "hand"), Chain("L hand", 6, 7, "L", "hand"),
    Chain("R foot", 10, 11, "R", "foot"), Chain("L foot", 13, 14, "L", "foot"),
]
GROUPS = {"FF": ("hip", "hand", "foot"), "FF_hip": ("hip",), "FF_dist": ("hand", "foot")}
TOP_SHARE = 0.9
MIN_SCORABLE = 0.25


def chains_dimension(spark, chains: Sequence[Chain]) -> DataFrame:
    return spark.createDataFrame(
        [(c.name, c.parent, c.moving, c.side, c.kind) for c in chains], "chain string, parent int, moving int, side string, kind string"
    )


def motion_triplet(pose: DataFrame, chains: Sequence[Chain], neck: int, midhip: int) -> DataFrame:
    """video, frame, chain, side, kind, r, alpha, q for each displacement frame -> frame + 1.

    One pass brings each joint's next position; the joints of a frame then meet
    in one group of J rows.  Zero or missing lengths give NULL.
    """
    n = shift(pose, ["video", "joint"], "frame", {"_nx": ("x", 1), "_ny": ("y", 1)}).where("_nx IS NOT NULL OR _ny IS NOT NULL")
    frame = n.groupBy("video", "frame").agg(
        F.map_from_entries(F.collect_list(F.struct("joint", F.struct("x", "y", F.col("_nx").alias("nx"), F.col("_ny").alias("ny"))))).alias("p")
    )
    spec = F.array(*[
        F.struct(F.lit(c.name).alias("chain"), F.lit(c.side).alias("side"), F.lit(c.kind).alias("kind"), F.lit(c.parent).alias("b"), F.lit(c.moving).alias("c"))
        for c in chains
    ])
    d = frame.withColumn("s", F.explode(spec)).select("video", "frame", "p", "s.*")
    at = lambda key, f: F.try_element_at("p", key).getField(f)
    b, c, nk, mh = F.col("b"), F.col("c"), F.lit(neck), F.lit(midhip)
    vx, vy = at(c, "nx") - at(c, "x"), at(c, "ny") - at(c, "y")
    ux, uy = at(c, "nx") - at(b, "nx"), at(c, "ny") - at(b, "ny")
    limb = F.sqrt(ux * ux + uy * uy)
    trunk = F.hypot(at(nk, "nx") - at(mh, "nx"), at(nk, "ny") - at(mh, "ny"))
    step_b = F.hypot(at(b, "nx") - at(b, "x"), at(b, "ny") - at(b, "y"))
    return d.select(
        "video", "frame", "chain", "side", "kind",
        F.when(limb > 0, 100.0 * F.sqrt(vx * vx + vy * vy) / limb).alias("r"),
        F.atan2(ux * vy - uy * vx, ux * vx + uy * vy).alias("alpha"),
        F.when(trunk > 0, 100.0 * step_b / trunk).alias("q"),
    )


def direction_bin(angle, bins: int):
    """Half-open bins on (-pi, pi]: ceil((a + pi) / width) - 1, folded."""
    return F.pmod(F.ceil((angle + F.pi()) / F.lit(2.0) / F.pi() * F.lit(float(bins))) - 1, F.lit(bins))


def direction_entropy(rows: DataFrame, keys: Sequence[str], angle: str, bins: int = 8) -> DataFrame:
    """Normalised Shannon entropy of the angle histogram per key; groups without an angle do not appear."""
    h = rows.where(F.col(angle).isNotNull()).groupBy(*keys).agg(
        *[F.count_if(direction_bin(F.col(angle), bins) == b).alias(f"_b{b}") for b in range(bins)]
    )
    return h.select(*keys, _histogram_entropy([F.col(f"_b{b}") for b in range(bins)], bins).alias("entropy"))


def _histogram_entropy(counts, bins: int):
    arr = F.array(*counts)
    total = F.aggregate(arr, F.lit(0).cast("long"), lambda s, x: s + x)
    terms = F.transform(arr, lambda c: F.when(c > 0, -(c / total) * F.ln(c / total)).otherwise(0.0))
    import math

    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / F.lit(math.log(bins))


def window_entropy_score(triplets: DataFrame, lengths: DataFrame, p: EntropyParams = EntropyParams()) -> DataFrame:
    """video, chain, side, kind, start, score: NULL if not assessable, 0 if too little lies in the band, else the entropy.

    One grouped pass holds the gate counts and the histogram of each window.
    """
    span = max(p.window - 1, 1)
    w = entropy_windows(triplets, lengths, p.window, p.stride)
    gate = F.when(F.col("kind") == "hip", F.col("r") <= p.tau_hip).when(
        F.col("kind") == "hand", F.col("q") <= p.tau_hand
    ).otherwise(F.col("q") <= p.tau_foot)
    band = F.col("r").between(p.r_min, p.r_max)
    g = w.groupBy("video", "chain", "side", "kind", "start").agg(
        F.count_if(gate).alias("n_small"), F.count_if(band).alias("n_band"),
        *[F.count_if(band & (direction_bin(F.col("alpha"), p.bins) == b)).alias(f"_b{b}") for b in range(p.bins)],
    )
    need = F.when(F.col("kind") == "hip", MIN_SMALL["hip"]).when(F.col("kind") == "hand", MIN_SMALL["hand"]).otherwise(MIN_SMALL["foot"])
    score = F.when(F.col("n_small") / span < need, F.lit(None)).when(F.col("n_band") / span < p.nu, 0.0).otherwise(
        _histogram_entropy([F.col(f"_b{b}") for b in range(p.bins)], p.bins)
    )
    return g.select("video", "chain", "side", "kind", "start", "n_small", "n_band", score.cast("double").alias("score"))


def side_reduce(scores: DataFrame, groups: Mapping[str, Sequence[str]] = GROUPS) -> DataFrame:
    """video, endpoint, s_l, s_r, scorable_l, scorable_r, value (NULL unless both sides have enough scorable windows)."""
    tags = F.filter(
        F.array(*[F.when(F.col("kind").isin(list(kinds)), F.lit(n)) for n, kinds in groups.items()]), lambda e: e.isNotNull()
    )
    s = scores.withColumn("endpoint", F.explode(tags))
    side = s.groupBy("video", "endpoint", "side", "start").agg(F.max("score").alias("s"))
    cover = side.groupBy("video", "endpoint", "side").agg((F.count("s") / F.count("*")).alias("scorable"))
    top = exact_quantiles(side, ["video", "endpoint", "side"], "s", {"s90": TOP_SHARE})
    both = cover.join(top, ["video", "endpoint", "side"], "left").groupBy("video", "endpoint").agg(
        *[F.max(F.when(F.col("side") == x, F.col(c))).alias(f"{n}_{x.lower()}") for c, n in (("s90", "s"), ("scorable", "scorable")) for x in ("L", "R")]
    )
    ok = (F.col("scorable_l") >= MIN_SCORABLE) & (F.col("scorable_r") >= MIN_SCORABLE) & F.col("s_l").isNotNull() & F.col("s_r").isNotNull()
    return both.withColumn("value", F.when(ok, F.least("s_l", "s_r")))


def chain_coverage(scores: DataFrame) -> DataFrame:
    """Share of windows in which each chain could be scored."""
    return scores.groupBy("video", "chain").agg((F.count("score") / F.count("*")).alias("coverage"))


def entropy_endpoints(pose: DataFrame, lengths: DataFrame, chains: Sequence[Chain], neck: int, midhip: int, p: EntropyParams = EntropyParams()) -> DataFrame:
    return side_reduce(window_entropy_score(motion_triplet(pose, chains, neck, midhip), lengths, p))


def calibrate_band(triplets: DataFrame, lengths: DataFrame, p: EntropyParams = EntropyParams(), pct: float = 75.0,
                   min_samples: int = 10, grid: Sequence[int] = (50, 70, 100, 150), overlap: float = 0.4) -> tuple[EntropyParams, dict]:
    """Rescale the five thresholds to the data and pick the shortest window with enough in-band rows.

    Reads back one quantile and at most one median per grid length.
    """
    q75 = exact_quantiles(triplets, [], "r", {"q": pct / 100.0}).first()["q"]
    if q75 is None:
        raise ValueError("no finite amplitudes to calibrate against")
    scale = q75 / (p.r_min * p.r_max) ** 0.5
    s = replace(p, r_min=p.r_min * scale, r_max=p.r_max * scale, tau_hip=p.tau_hip * scale, tau_hand=p.tau_hand * scale,
                tau_foot=p.tau_foot * scale, scale=p.scale * scale)
    medians, chosen, reached = {}, max(grid), False
    for L in sorted(grid):
        c = rolling_counts(triplets, ["video", "chain"], F.col("r").between(s.r_min, s.r_max), L, lengths)
        row = bounded_count_median(c).first()
        medians[L] = row["med"] if row else None
        if medians[L] is not None and medians[L] >= min_samples:
            chosen, reached = L, True
            break
    out = replace(s, window=chosen, stride=max(int(round(overlap * chosen)), 1), nu=min_samples / chosen)
    return out, {"q75": q75, "scale": scale, "median_in_band": medians, "window_reached": reached}


def bounded_count_median(counts: DataFrame) -> DataFrame:
    """Median of window counts: only L distinct values exist, so one percentile buffer stays small."""
    return bounded_quantiles(counts, [], "count", {"med": 0.5})
