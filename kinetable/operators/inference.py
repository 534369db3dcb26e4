"""Group contrasts: rank-sum tests, correlations, resampling, permutations, corrections, mixed models."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from kinetable.functions import special
from kinetable.functions.hashes import SPAN, Numbers
from kinetable.functions.scalar import seeded_uniform
from kinetable.plans.chunks import prefix_sum
from kinetable.plans.draws import WHOLE, draw_blocks, pick_smallest, resample_columns, resample_weights, seeded_order, smallest_sums
from kinetable.plans.python import schema_of, spread
from kinetable.plans.quantiles import exact_quantiles
from kinetable.plans.ranks import mid_ranks, tie_table, value_range
from kinetable.session import cut_lineage, stored

EXACT_LIMIT = 5_000_000


def _labelled(df: DataFrame, keys: Sequence[str], value: str, label: str, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    return tie_table(df, keys, value, {"n1": F.when(F.col(label) == 1, w).otherwise(0), "n0": F.when(F.col(label) == 0, w).otherwise(0)})


def auc_table(df: DataFrame, keys: Sequence[str], value: str = "value", label: str = "label", weight: str | None = None) -> DataFrame:
    """keys, n_pos, n_neg, u, auc, rank_biserial, tie_sum; NULL statistics when a group is empty.

    The pair count comes from running counts over distinct values, so no pair is formed.
    """
    t = _labelled(df, keys, value, label, weight)
    below = F.col("cum_n0") - F.col("n0")
    size = F.col("n1") + F.col("n0")
    g = t.groupBy(*keys).agg(
        F.sum("n1").alias("n_pos"), F.sum("n0").alias("n_neg"), F.sum(F.col("n1") * (below + F.col("n0") / 2.0)).alias("u"),
        F.sum((size * size * size - size).cast("double")).alias("tie_sum"),
    )
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    g = g.withColumn("u", F.when(ok, F.col("u")))
    g = g.withColumn("auc", F.col("u") / (F.col("n_pos") * F.col("n_neg")))
    return g.withColumn("rank_biserial", 2 * F.col("auc") - 1)


def screening_auc(df: DataFrame, keys: Sequence[str], score: str, label: str = "label") -> DataFrame:
    """AUC of the negated score."""
    a = auc_table(df.withColumn("_neg", -F.col(score)), keys, "_neg", label)
    return a.select(*keys, "n_pos", "n_neg", "auc")


def _log_choose(n: Column, k: Column) -> Column:
    return _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1)


@F.pandas_udf(T.DoubleType())
def _lgamma(v: pd.Series) -> pd.Series:
    return v.map(lambda x: math.lgamma(x) if x > 0 else float("nan"))


def rank_sum_test(df: DataFrame, keys: Sequence[str], ids: Sequence[str], value: str = "value", label: str = "label",
                  draws: int = 200_000, seed: int = 0, method: str = "auto") -> DataFrame:
    """auc_table plus a two-sided p.

    auto: exact over all label assignments while there are at most 5,000,000 of
    them (that also bounds the group that is looked at whole); otherwise a label
    permutation with (1 + hits) / (draws + 1).  exact, permutation: that method
    for every group; exact looks at each group whole, whatever its size.
    """
    if method not in ("auto", "exact", "permutation"):
        raise ValueError(f"unknown method: {method}")
    keys = list(keys)
    a = auc_table(df, keys, value, label)
    n = F.col("n_pos") + F.col("n_neg")
    few = _log_choose(n, F.col("n_pos")) <= math.log(EXACT_LIMIT) + 1e-9 if method == "auto" else F.lit(method == "exact")
    a = a.withColumn("_exact", few).withColumn(
        "method", F.when(F.col("u").isNull(), None).when(F.col("_exact"), "exact").otherwise("permutation")
    )
    small = a.where("method = 'exact'").select(*keys, "n_pos", "auc")
    ranks = mid_ranks(df.where(F.col(value).isNotNull() & F.col(label).isin(0, 1)).join(small.select(*keys), keys, "left_semi"), keys, value)
    lists = ranks.groupBy(*keys).agg(F.collect_list("rank").alias("ranks")).join(small, keys)

    @F.pandas_udf("double")
    def exact_p(r: pd.Series, n1: pd.Series, auc: pd.Series) -> pd.Series:
        return pd.Series([special.exact_rank_sum_p(np.asarray(x), int(k), float(o)) for x, k, o in zip(r, n1, auc)], dtype=float)

    exact = spread(lists, *keys).select(*keys, exact_p("ranks", "n_pos", "auc").alias("p"))
    if method == "exact":
        return a.drop("_exact").join(exact, keys, "left")
    large = a.where("method = 'permutation'").select(*keys, "n_pos", "n_neg", F.col("auc").alias("_obs"))
    rows = df.where(F.col(value).isNotNull() & F.col(label).isin(0, 1)).join(large.select(*keys, "n_pos"), keys)
    # the ranks are those of every draw, so only their sums over the drawn rows are needed
    ranked = stored(mid_ranks(rows, keys, value).select(*keys, *ids, "n_pos", "rank"))
    null = smallest_sums(ranked, keys, ids, "rank", "n_pos", draws, seed).join(large, keys)
    u = F.col("sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    mc = null.withColumn("auc", u / (F.col("n_pos") * F.col("n_neg"))).groupBy(*keys).agg(
        ((1 + F.count_if(F.abs(F.col("auc") - 0.5) >= F.abs(F.col("_obs") - 0.5) - 1e-12)) / (draws + 1)).alias("p")
    )
    return a.drop("_exact").join(mc if method == "permutation" else exact.unionByName(mc), keys, "left")


def permuted_labels(df: DataFrame, keys: Sequence[str], ids: Sequence[str], n_pos: str, draws: int, seed: int) -> DataFrame:
    """``draws`` copies of the rows with label ``_lab`` = 1 on exactly ``n_pos`` seeded rows per group and draw."""
    d = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    d = d.withColumn("_u", seeded_uniform(seed, "draw", *ids))
    return pick_smallest(d, [*keys, "draw"], "_u", n_pos, ids, "_lab").drop("_u")


@F.pandas_udf(T.DoubleType())
def _correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([special.correlation_p(a, int(b)) if a == a and a is not None else None for a, b in zip(r, n)], dtype=float)


def correlate(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """keys, n, pearson, pearson_p, spearman, spearman_p over pairwise complete rows; NULL below 4 rows or if constant."""
    keys = list(keys)
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    overall = not keys
    if overall:
        d, keys = d.withColumn("_all", F.lit(0)), ["_all"]
    r = mid_ranks(mid_ranks(d, keys, a, "_ra"), keys, b, "_rb")
    g = r.groupBy(*keys).agg(
        F.count("*").alias("n"), F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"),
        F.stddev_pop(a).alias("_sa"), F.stddev_pop(b).alias("_sb"),
    )
    ok = (F.col("n") >= 4) & (F.col("_sa") > 0) & (F.col("_sb") > 0)
    g = g.withColumns({c: F.when(ok, F.col(c)) for c in ("pearson", "spearman")})
    g = g.withColumns({f"{c}_p": F.when(F.col(c).isNotNull(), _correlation_p(c, "n")) for c in ("pearson", "spearman")})
    return g.drop("_sa", "_sb", "_all") if overall else g.drop("_sa", "_sb")


def correlation_table(endpoints: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlations of the listed endpoint pairs on shared recordings."""
    spec = F.array(*[F.struct(F.lit(x).alias("endpoint_a"), F.lit(y).alias("endpoint_b")) for x, y in pairs])
    names = sorted({e for p in pairs for e in p})
    wide = endpoints.where(F.col("endpoint").isin(names)).groupBy("video").agg(
        F.map_from_entries(F.collect_list(F.struct("endpoint", "value"))).alias("m")
    )
    long = wide.withColumn("s", F.explode(spec)).select(
        "s.*", F.try_element_at("m", F.col("s.endpoint_a")).alias("a"), F.try_element_at("m", F.col("s.endpoint_b")).alias("b")
    )
    return correlate(long, ["endpoint_a", "endpoint_b"], "a", "b")


def replication(endpoints_a: DataFrame, endpoints_b: DataFrame) -> DataFrame:
    """The same endpoints from two models joined on the recording."""
    j = endpoints_a.join(endpoints_b.withColumnRenamed("value", "other"), ["video", "endpoint"])
    return correlate(j, ["endpoint"], "value", "other")


def clinical_test(df: DataFrame, keys: Sequence[str], value: str = "value", label: str = "label") -> DataFrame:
    """AUC, p (exact without ties, else asymptotic), medians, direction and leave-one-out ranges.

    Leaving one recording out changes U by its own pair count, which the tie
    table already holds, so nothing is joined against itself.
    """
    keys = list(keys)
    a = auc_table(df, keys, value, label)
    t = _labelled(df, keys, value, label).join(a.select(*keys, "n_pos", "n_neg", "u"), keys).where("u IS NOT NULL")
    below0 = F.col("cum_n0") - F.col("n0") + F.col("n0") / 2.0
    above1 = F.col("n_pos") - F.col("cum_n1") + F.col("n1") / 2.0
    out = F.array(
        F.when((F.col("n1") > 0) & (F.col("n_pos") > 1), F.struct((F.col("u") - below0).alias("u"), (F.col("n_pos") - 1).alias("a"), F.col("n_neg").alias("b"))),
        F.when((F.col("n0") > 0) & (F.col("n_neg") > 1), F.struct((F.col("u") - above1).alias("u"), F.col("n_pos").alias("a"), (F.col("n_neg") - 1).alias("b"))),
    )
    loo = t.withColumn("l", F.explode(out)).where("l IS NOT NULL").select(*keys, "l.*")
    auc = F.col("u") / (F.col("a") * F.col("b"))
    loo = loo.groupBy(*keys).agg(F.min(auc).alias("loo_auc_min"), F.max(auc).alias("loo_auc_max"))

    @F.pandas_udf("double")
    def p_value(u: pd.Series, n1: pd.Series, n0: pd.Series, ties: pd.Series) -> pd.Series:
        def one(x, i, j, t):
            if x is None or x != x:
                return None
            i, j = int(i), int(j)
            if t == 0 and math.comb(i + j, min(i, j)) <= EXACT_LIMIT:
                return special.untied_u_p(x, i, j)
            return special.asymptotic_u_p(x, i, j, t)

        return pd.Series([one(*r) for r in zip(u, n1, n0, ties)], dtype=float)

    med = exact_quantiles(df, [*keys, label], value, {"m": 0.5}).groupBy(*keys).agg(
        F.max(F.when(F.col(label) == 1, F.col("m"))).alias("median_pos"), F.max(F.when(F.col(label) == 0, F.col("m"))).alias("median_neg")
    )
    return (
        a.withColumn("p", p_value("u", "n_pos", "n_neg", "tie_sum"))
        .withColumn("direction", F.when(F.col("auc") > 0.5, "abnormal>normal").otherwise("normal>abnormal"))
        .join(med, keys, "left").join(loo, keys, "left")
    )


def leave_one_out_p(df: DataFrame, keys: Sequence[str], method: str, value: str = "value", label: str = "label") -> DataFrame:
    """keys, n_left_out, z_min, z_max, loo_p_min, loo_p_max: two-sided rank-sum p with each row left out in turn.

    Leaving a row out changes U by its own pair count and the tie sum by its own value's, both in the tie table, so a row of
    that table stands for all rows of its value and nothing is joined against itself.  z is the distance of U from its mean,
    less 1/2, over its tie-corrected deviation.  asymptotic: p of that z.  exact: p under all
    label assignments, which falls with |U - mean|, so the extremes of each side need one table of sums each; NULL where
    values are tied, as the law of U then depends on the ties.  A row whose group would be empty without it is not left out.
    """
    if method not in ("exact", "asymptotic"):
        raise ValueError(f"unknown method: {method}")
    keys = list(keys)
    a = auc_table(df, keys, value, label).where("u IS NOT NULL")
    t = _labelled(df, keys, value, label).join(a.select(*keys, "n_pos", "n_neg", "u", "tie_sum"), keys)
    below0 = F.col("cum_n0") - F.col("n0") + F.col("n0") / 2.0
    above1 = F.col("n_pos") - F.col("cum_n1") + F.col("n1") / 2.0
    c = (F.col("n1") + F.col("n0")).cast("double")
    ties = F.col("tie_sum") - (c * c * c - c) + ((c - 1) * (c - 1) * (c - 1) - (c - 1))
    side = lambda u, i, j, rows: F.struct(u.alias("u"), i.alias("i"), j.alias("j"), rows.alias("rows"), ties.alias("ties"))
    out = F.array(
        F.when((F.col("n1") > 0) & (F.col("n_pos") > 1), side(F.col("u") - below0, F.col("n_pos") - 1, F.col("n_neg"), F.col("n1"))),
        F.when((F.col("n0") > 0) & (F.col("n_neg") > 1), side(F.col("u") - above1, F.col("n_pos"), F.col("n_neg") - 1, F.col("n0"))),
    )
    left = t.withColumn("l", F.explode(out)).where("l IS NOT NULL").select(*keys, "l.*")
    away = F.abs(F.col("u") - F.col("i") * F.col("j") / 2.0)
    n = F.col("i") + F.col("j")
    var = F.col("i") * F.col("j") / 12.0 * (n + 1 - F.when(n > 1, F.col("ties") / (n * (n - 1))).otherwise(0.0))
    left = left.withColumn("away", away).withColumn("z", F.when(var > 0, (away - 0.5) / F.sqrt(var)))
    sides = left.groupBy(*keys, "i", "j").agg(
        F.sum("rows").alias("rows"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.min("away").alias("near"), F.max("away").alias("far"), F.max("ties").alias("ties"), F.count_if(F.col("z").isNull()).alias("flat"),
    )

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: 1.0 if x is None or x != x else special.normal_two_sided(max(x, 0.0)))  # no spread: p is 1

    @F.pandas_udf("double")
    def counted(d: pd.Series, i: pd.Series, j: pd.Series, tied: pd.Series) -> pd.Series:
        return pd.Series([None if t > 0 else special.untied_u_p(a * b / 2.0 + x, int(a), int(b)) for x, a, b, t in zip(d, i, j, tied)], dtype=float)

    if method == "exact":
        p = sides.withColumn("lo", counted("far", "i", "j", "ties")).withColumn("hi", counted("near", "i", "j", "ties"))
    else:
        p = sides.withColumn("lo", tail("z_max")).withColumn("hi", tail(F.when(F.col("flat") == 0, F.col("z_min"))))
    known = F.bool_and(F.col("lo").isNotNull())
    return p.groupBy(*keys).agg(
        F.sum("rows").alias("n_left_out"), F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max"), F.when(known, F.min("lo")).alias("loo_p_min"), F.when(known, F.max("hi")).alias("loo_p_max"),
    )


def holm(df: DataFrame, p: str = "p", family: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p per family; NULL passes through.  Rows are tests, not data."""
    known = F.col(p).isNotNull()
    part = W.partitionBy(*family, known)
    rank = F.row_number().over(part.orderBy(p))
    m = F.count(p).over(part)
    step = F.when(known, F.least(F.lit(1.0), (m - rank + 1) * F.col(p)))
    d = df.withColumn("_step", step).withColumn("_r", rank)
    adj = F.max("_step").over(part.orderBy("_r").rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("p_holm", F.when(known, adj)).drop("_step", "_r")


def bonferroni(df: DataFrame, n_tests: int, p: str = "p") -> DataFrame:
    """min(p n, 1) with every metric counted in n, also the skipped ones."""
    adj = F.when(F.col(p).isNotNull(), F.least(F.col(p) * n_tests, F.lit(1.0)))
    return df.withColumns({"p_bonferroni": adj, "significant": F.coalesce(adj < 0.05, F.lit(False))})


def verdict(tests: DataFrame) -> DataFrame:
    """One row: GO if any metric is significant, with their names."""
    return tests.agg(
        F.when(F.bool_or("significant"), "GO").otherwise("NO-GO").alias("verdict"),
        F.array_sort(F.collect_list(F.when(F.col("significant"), F.col("metric")))).alias("metrics"),
    )


def bootstrap_auc_ci(df: DataFrame, keys: Sequence[str], ids: Sequence[str], reps: int = 10_000, seed: int = 0,
                     value: str = "value", label: str = "label") -> DataFrame:
    """Percentile interval and sd of the AUC, each label group resampled at its own size; NULL under 2 a group."""
    keys = list(keys)
    d = df.where(F.col(value).isNotNull() & F.col(label).isin(0, 1))
    aucs = cut_lineage(resampled_auc(d, keys, ids, reps, seed, value, label))
    q = exact_quantiles(aucs, keys, "auc", {"low": 0.025, "high": 0.975})
    sd = aucs.groupBy(*keys).agg(F.stddev_samp("auc").alias("se"))
    obs = auc_table(d, keys, value, label).select(*keys, "n_pos", "n_neg", "auc")
    j = obs.join(q, keys, "left").join(sd, keys, "left")
    ok = (F.col("n_pos") >= 2) & (F.col("n_neg") >= 2)
    return j.withColumns({c: F.when(ok, F.col(c)) for c in ("low", "high", "se")})


def resampled_auc(df: DataFrame, keys: Sequence[str], ids: Sequence[str], reps: int, seed: int, value: str = "value", label: str = "label", wide: int = 16, most: int = WHOLE) -> DataFrame:
    """keys, rep, auc: auc_table of every resample.

    Groups of at most ``most`` rows are packed, and tasks take blocks of reps over them.  If a group is larger, the running
    counts of at most ``wide`` reps are columns of one pass over the values.
    """
    keys, n = list(keys), math.ceil(reps / math.ceil(reps / wide))
    total, top = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    if top is not None and top <= most:
        return _packed_auc(df, keys, ids, reps, seed, value, label, total)
    part = [*keys, "_block"]
    boot = resample_columns(df, [*keys, label], ids, reps, seed, n)
    sums = [F.sum(F.when(F.col(label) == k, F.col(f"_w{i}")).otherwise(0)).alias(f"_n{k}_{i}") for k in (0, 1) for i in range(n)]
    t = value_range(boot.groupBy(*part, value).agg(*sums), part, value)
    t = prefix_sum(t, part, "", {f"_c{i}": f"_n0_{i}" for i in range(n)}, bucket=F.col("_range"), order=[value])
    u = [F.sum(F.col(f"_n1_{i}") * (F.col(f"_c{i}") - F.col(f"_n0_{i}") / 2.0)).alias(f"_u{i}") for i in range(n)]
    g = t.groupBy(*part).agg(*u, *[F.sum(f"_n{k}_{i}").alias(f"_s{k}_{i}") for k in (0, 1) for i in range(n)])
    ok = lambda i: (F.col(f"_s1_{i}") > 0) & (F.col(f"_s0_{i}") > 0)
    one = [F.struct((F.col("_block") * n + i + 1).alias("rep"), F.when(ok(i), F.col(f"_u{i}") / (F.col(f"_s1_{i}") * F.col(f"_s0_{i}"))).alias("auc")) for i in range(n)]
    return g.select(*keys, F.explode(F.array(*one)).alias("_r")).select(*keys, "_r.*").where(F.col("rep") <= reps)


def _packed_auc(df: DataFrame, keys: list[str], ids: Sequence[str], reps: int, seed: int, value: str, label: str, total: int) -> DataFrame:
    slots = seeded_order(df, [*keys, label], ids, seed, "_pos")  # the places that resample_weights draws
    head = F.concat_ws(":", F.lit(str(seed + 1)), *[F.col(c).cast("string") for c in [*keys, label]])
    rows = slots.select(*keys, F.col(label).alias("_label"), "_pos", F.col(value).cast("double").alias("_v"), head.alias("_head"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_label", "_pos"])
        distinct, code = np.unique(pdf["_v"].to_numpy(float), return_inverse=True)
        one = pdf.iloc[:1][keys].reset_index(drop=True)
        one["values"] = len(distinct)
        for k in (0, 1):
            mine = (pdf["_label"] == k).to_numpy()
            one[f"head{k}"], one[f"code{k}"] = (pdf["_head"][mine].iloc[0] if mine.any() else ""), code[mine].astype("<i4").tobytes()
        return one

    packed = stored(rows.groupBy(*keys).applyInPandas(pack, schema_of(rows, keys, "values int", "head0 string", "code0 binary", "head1 string", "code1 binary")))

    def run(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                drawn = []
                for k in (0, 1):
                    code = np.frombuffer(r[f"code{k}"], "<i4")
                    drawn.append((f"{r[f'head{k}']}:", code, Numbers([str(i).encode() for i in range(len(code))])))
                size, reps_, aucs = min(x.batch for *_, x in drawn), range(r["_from"], r["_to"] + 1), []
                n0, n1 = len(drawn[0][1]), len(drawn[1][1])
                for s in range(0, len(reps_), size):
                    counts = []
                    for head, code, numbers in drawn:
                        u = numbers([f"{head}{j}:".encode() for j in reps_[s:s + size]]) / SPAN
                        counts.append([np.bincount(code[x], minlength=r["values"]) for x in np.floor(u * len(code)).astype("i8")])
                    aucs += [float((b * (a.cumsum() - a / 2.0)).sum()) / (n1 * n0) if n1 and n0 else None for a, b in zip(*counts)]
                yield pd.DataFrame({**{c: [r[c]] * len(aucs) for c in keys}, "rep": reps_, "auc": pd.Series(aucs, dtype=float)})

    return draw_blocks(packed, total, reps).mapInPandas(run, schema_of(df, keys, "rep int", "auc double"))


def bootstrap(df: DataFrame, ids: Sequence[str], statistic: Callable[[DataFrame, list[str]], DataFrame], reps: int, seed: int = 0) -> DataFrame:
    """Row bootstrap of any statistic: ``statistic(rows, ["rep"])`` sees a ``weight`` column."""
    d = resample_weights(df.withColumn("_g", F.lit(0)), ["_g"], ids, reps, seed).drop("_g")
    return statistic(d, ["rep"])


def block_bootstrap(df: DataFrame, block: str, value: str, reps: int = 500, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """point, low, high of the mean under resampling of whole time blocks.

    A block's rows enter a mean only through their sum and count, so blocks are
    summed first and the draws work on one row per block.
    """
    sums = df.groupBy(block).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    boot = resample_weights(sums.withColumn("_g", F.lit(0)), ["_g"], [block], reps, seed)
    means = boot.groupBy("rep").agg((F.sum(F.col("_s") * F.col("weight")) / F.sum(F.col("_n") * F.col("weight"))).alias("m"))
    q = exact_quantiles(means, [], "m", {"low": (1 - ci) / 2, "high": (1 + ci) / 2}).withColumn("_k", F.lit(1))
    point = sums.agg((F.sum("_s") / F.sum("_n")).alias("point")).withColumn("_k", F.lit(1))
    return point.join(F.broadcast(q), "_k").drop("_k")


def moving_block_bootstrap(path: DataFrame, block: int, rep: int = 1, seed: int = 0) -> DataFrame:
    """Random contiguous blocks laid end to end to the original length: video, m, source_m and the moved columns.

    Each output slot (block number) copies rows start .. start + block - 1.
    """
    n = path.groupBy("video").agg((F.max("m") + 1).alias("_n"))
    slots = n.withColumn("_b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / block) - 1)))
    start = F.when(F.col("_n") <= block, 0).otherwise(F.floor(seeded_uniform(seed, "video", F.lit(rep), "_b") * (F.col("_n") - block + 1)))
    take = slots.withColumn("_s", start.cast("long")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    take = take.select("video", (F.col("_b") * block + F.col("_o")).alias("_to"), (F.col("_s") + F.col("_o")).alias("m"), "_n")
    take = take.where(F.col("_to") < F.col("_n")).drop("_n")
    return path.join(take, ["video", "m"]).withColumnRenamed("m", "source_m").withColumnRenamed("_to", "m")


def permutation_two_groups(df: DataFrame, ids: Sequence[str], group: str, block: str, value: str, draws: int = 500, seed: int = 0) -> DataFrame:
    """observed mean difference of two videos and p from shuffling the video label inside time blocks."""
    names = [r[0] for r in df.select(group).distinct().orderBy(group).limit(3).collect()]
    if len(names) != 2:
        raise ValueError("this test compares exactly two groups")
    first = F.when(F.col(group) == names[0], 1).otherwise(0)
    d = df.withColumn("_first", first)
    size = d.groupBy(block).agg(F.sum("_first").alias("_k"))
    d = d.join(size, block)
    p = permuted_labels(d, [block], ids, "_k", draws, seed)
    mean = lambda lab: F.avg(F.when(F.col(lab) == 1, F.col(value))) - F.avg(F.when(F.col(lab) == 0, F.col(value)))
    null = p.groupBy("draw").agg(mean("_lab").alias("_d")).withColumn("_k", F.lit(1))
    obs = d.agg(mean("_first").alias("observed")).withColumn("_k", F.lit(1))
    return null.join(F.broadcast(obs), "_k").groupBy("observed").agg(
        ((1 + F.count_if(F.abs("_d") >= F.abs("observed"))) / (draws + 1)).alias("p_value")
    )


def _contrast(df: DataFrame, keys: Sequence[str], value: str, label: str, statistic: str) -> DataFrame:
    keys = list(keys)
    if statistic == "auc":
        return auc_table(df, keys, value, label).select(*keys, (F.col("auc") - 0.5).alias("t"))
    if statistic != "median_diff":
        raise ValueError(f"unknown statistic {statistic!r}")
    med = exact_quantiles(df, [*keys, label], value, {"m": 0.5})
    return med.groupBy(*keys).agg(
        (F.max(F.when(F.col(label) == 1, F.col("m"))) - F.max(F.when(F.col(label) == 0, F.col("m")))).alias("t")
    )


def maxstat_permutation(df: DataFrame, column: str, statistic: str = "median_diff", draws: int = 10_000, seed: int = 0) -> DataFrame:
    """column, observed, p_corrected, p_uncorrected.

    ``df`` is video, column, value, label.  Recordings' labels are permuted, and
    each column's statistic is held against the largest over columns.
    """
    people = df.select("video", "label").distinct()
    k = people.agg(F.sum("label").alias("_k1"), F.count("*").alias("_kn"))
    ok = k.first()
    if not ok["_k1"] or ok["_k1"] == ok["_kn"]:
        raise ValueError("one label group is empty")
    lab = permuted_labels(people.withColumn("_k1", F.lit(ok["_k1"])).withColumn("_g", F.lit(0)), ["_g"], ["video"], "_k1", draws, seed)
    null = _contrast(df.join(lab.select("video", "draw", "_lab"), "video"), ["draw", column], "value", "_lab", statistic)
    top = F.max(F.abs("t")).over(W.partitionBy("draw"))  # one row per column
    null = null.withColumn("_top", top)
    obs = _contrast(df, [column], "value", "label", statistic).withColumnRenamed("t", "observed")
    return null.join(obs, column).groupBy(column, "observed").agg(
        ((1 + F.count_if(F.col("_top") >= F.abs("observed"))) / (draws + 1)).alias("p_corrected"),
        ((1 + F.count_if(F.abs("t") >= F.abs("observed"))) / (draws + 1)).alias("p_uncorrected"),
    )


def mixed_model(table: DataFrame, metrics: Sequence[str], clinical: str, covariates: Sequence[str] = ("cohort", "sex")) -> DataFrame:
    """metric, n, n_subjects, coef, p, p_bonferroni, significant: random-intercept ML fit of metric on clinical + covariates.

    ``table`` is long (subject_id, metric, value, clinical, covariates).  Each
    subject is reduced to X'X, X'y, y'y and its row sums; only their totals per
    subject size reach the driver, where one variance ratio is searched.
    Categories enter as indicator columns against the smallest one.
    """
    d = table.where(F.col(clinical).isNotNull() & F.col("value").isNotNull() & F.col("metric").isin(list(metrics)))
    levels = {c: [r[0] for r in d.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).collect()] for c in covariates}
    levels = {c: v for c, v in levels.items() if len(v) > 1}
    for c in levels:
        d = d.where(F.col(c).isNotNull())
    cols = [F.lit(1.0), F.col(clinical).cast("double")]
    for c, v in levels.items():
        cols += [F.when(F.col(c) == x, 1.0).otherwise(0.0) for x in v[1:]]
    k = len(cols)
    d = d.select("metric", "subject_id", F.col(clinical).alias("_c"), F.col("value").cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(cols)])
    names = [f"x{i}" for i in range(k)] + ["y"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    per = d.groupBy("metric", "subject_id").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in names], *[F.sum(F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for a, b in pairs],
        F.min("_c").alias("c0"), F.max("_c").alias("c1"),
    )
    # subjects of one size share their variance factor, so their moments add up
    size = per.groupBy("metric", "n").agg(
        F.count("*").alias("g"), *[F.sum(f"q_{a}_{b}").alias(f"q_{a}_{b}") for a, b in pairs],
        *[F.sum(F.col(f"s_{a}") * F.col(f"s_{b}")).alias(f"t_{a}_{b}") for a, b in pairs], F.min("c0").alias("c0"), F.max("c1").alias("c1"),
    )
    spark = table.sparkSession
    rows = []
    got = size.toPandas()
    for m in metrics:
        s = got[got.metric == m]
        n_obs, n_sub = (int((s.n * s.g).sum()), int(s.g.sum())) if len(s) else (0, 0)
        if not len(s) or s.c0.min() == s.c1.max() or n_sub < 3:
            rows.append((m, n_obs, n_sub, None, None))
            continue
        coef, p = _random_intercept(s, pairs, names, n_obs)
        rows.append((m, n_obs, n_sub, coef, p))
    fit = spark.createDataFrame(rows, "metric string, n long, n_subjects long, coef double, p double")
    return bonferroni(fit, len(metrics))


def _random_intercept(s: pd.DataFrame, pairs, names, n_obs: int) -> tuple[float | None, float | None]:
    """Profile likelihood over lambda = tau^2 / sigma^2; V^-1 = I - lambda / (1 + n lambda) 11'."""
    k = len(names) - 1

    def moments(lam):
        shrink = lam / (1.0 + s.n.to_numpy(float) * lam)
        m = np.zeros((k + 1, k + 1))
        for a, b in pairs:
            i, j = names.index(a), names.index(b)
            m[i, j] = m[j, i] = float((s[f"q_{a}_{b}"].to_numpy(float) - shrink * s[f"t_{a}_{b}"].to_numpy(float)).sum())
        return m[:k, :k], m[:k, k], m[k, k]

    def fit(lam):
        xx, xy, yy = moments(lam)
        beta = np.linalg.pinv(xx, hermitian=True) @ xy
        rss = max(yy - xy @ beta, 1e-300)
        logdet = float((s.g * np.log1p(s.n * lam)).sum())
        return beta, xx, rss, -0.5 * (n_obs * math.log(rss / n_obs) + logdet)

    lo, hi = math.log(1e-8), math.log(1e6)
    grid = np.linspace(lo, hi, 60)
    best = int(np.argmax([fit(math.exp(g))[3] for g in grid]))
    a, b = grid[max(best - 1, 0)], grid[min(best + 1, 59)]
    r = (math.sqrt(5.0) - 1.0) / 2.0
    for _ in range(80):
        c, d = b - r * (b - a), a + r * (b - a)
        if fit(math.exp(c))[3] >= fit(math.exp(d))[3]:
            b = d
        else:
            a = c
    lam = math.exp((a + b) / 2.0)
    if fit(0.0)[3] >= fit(lam)[3]:
        lam = 0.0
    beta, xx, rss, _ = fit(lam)
    var = rss / n_obs * np.linalg.pinv(xx, hermitian=True)[1, 1]
    if not var > 0:
        return float(beta[1]), None
    return float(beta[1]), special.normal_two_sided(beta[1] / math.sqrt(var))
