"""Seeded subsets, permutations and resamples keyed by stable ids.

Random choices are hashes of (seed, keys), so a lost task redraws the same
numbers.  Picking k of n goes by hash ranges: only the range that holds the
k-th smallest hash is ever sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetable.functions.hashes import Numbers
from kinetable.functions.scalar import seeded_uniform
from kinetable.plans.chunks import ordered_index
from kinetable.plans.python import schema_of, spread
from kinetable.session import stored

RANGES = 1024
WHOLE = 4_000_000  # rows of a group that one task may hold packed
BLOCKS = 48


def pick_smallest(df: DataFrame, keys: Sequence[str], u: str, n_pick: str, tie: Sequence[str], name: str, ranges: int = RANGES) -> DataFrame:
    """Flag exactly ``n_pick`` rows per key group, those with the smallest ``u`` in [0, 1) (ties by ``tie``)."""
    keys = list(keys)
    d = df.withColumn("_rg", F.floor(F.col(u) * ranges).cast("int"))
    counts = d.groupBy(*keys, "_rg").agg(F.count("*").alias("_cn"))
    before = F.coalesce(F.sum("_cn").over(W.partitionBy(*keys).orderBy("_rg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.join(counts.select(*keys, "_rg", "_cn", before.alias("_cb")), [*keys, "_rg"])
    left = F.col(n_pick) - F.col("_cb")
    state = F.when(left >= F.col("_cn"), 1).when(left <= 0, 0).otherwise(2)
    d = d.withColumn("_st", state)
    order = F.row_number().over(W.partitionBy(*keys, "_rg", "_st").orderBy(u, *tie))
    picked = F.when(F.col("_st") == 2, (order <= left).cast("int")).otherwise(F.col("_st"))
    return d.withColumn(name, picked).drop("_rg", "_cn", "_cb", "_st")


def seeded_order(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int, name: str, ranges: int = RANGES) -> DataFrame:
    """0-based position of each row in a seeded random order of its group."""
    u = seeded_uniform(seed, *keys, *ids)
    d = df.withColumn("_u", u)
    bucket = F.floor(F.col("_u") * ranges).cast("long")
    return ordered_index(d, keys, bucket, ["_u", *ids], name).drop("_u")


def smallest_sums(df: DataFrame, keys: Sequence[str], ids: Sequence[str], value: str, n_pick: str, draws: int, seed: int, ranges: int = RANGES, most: int = WHOLE) -> DataFrame:
    """keys, draw, sum: per group and draw the sum of ``value`` over the ``n_pick`` rows with the smallest seeded uniform (ties by ``ids``).

    The picks are those of pick_smallest.  Groups of at most ``most`` rows are packed, and tasks take blocks of draws over
    them; groups share the numbers of rows they share.  If a group is larger, hash ranges below the cut add up before the
    shuffle, and only the rows of the range that holds the cut are sorted.
    """
    keys = list(keys)
    sizes = stored(df.groupBy(*keys).agg(F.count("*").alias("_n")))
    total, top = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if top is not None and top <= most:
        return _packed_sums(df, sizes, keys, list(ids), value, n_pick, draws, seed, most, total)
    d = df.select(*keys, *ids, value, n_pick).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    d = d.withColumn("_u", seeded_uniform(seed, "draw", *ids)).withColumn("_rg", F.floor(F.col("_u") * ranges).cast("int"))
    sums = d.groupBy(*keys, "draw", "_rg").agg(F.count("*").alias("_cn"), F.sum(value).alias("_cv"), F.max(n_pick).alias("_k"))
    upto = W.partitionBy(*keys, "draw").orderBy("_rg").rowsBetween(W.unboundedPreceding, 0)
    sums = stored(sums.withColumn("_left", F.col("_k") - F.sum("_cn").over(upto) + F.col("_cn")))
    whole = sums.where(F.col("_left") >= F.col("_cn")).select(*keys, "draw", F.col("_cv").alias("sum"))
    # one row a group and draw; as a stored table the planner knows its size
    cuts = stored(sums.where((F.col("_left") > 0) & (F.col("_left") < F.col("_cn"))).select(*keys, "draw", "_rg", "_left"))
    order = F.row_number().over(W.partitionBy(*keys, "draw").orderBy("_u", *ids))
    last = d.join(cuts, [*keys, "draw", "_rg"]).withColumn("_at", order).where(F.col("_at") <= F.col("_left"))
    return whole.unionByName(last.select(*keys, "draw", F.col(value).alias("sum"))).groupBy(*keys, "draw").agg(F.sum("sum").alias("sum"))


def draw_blocks(groups: DataFrame, rows: int, draws: int) -> DataFrame:
    """``groups`` once for each block ``_from``..``_to`` of draws 1..``draws``, enough blocks to spread ``rows`` numbers a draw over the cluster."""
    step = -(-draws // max(1, min(draws, BLOCKS, rows * draws // 20_000_000)))
    blocks = groups.withColumn("_from", F.explode(F.sequence(F.lit(1), F.lit(draws), F.lit(step))))
    return spread(blocks.withColumn("_to", F.least(F.col("_from") + step - 1, F.lit(draws))))


def _packed_sums(df: DataFrame, sizes: DataFrame, keys: list[str], ids: list[str], value: str, n_pick: str, draws: int, seed: int, most: int, total: int) -> DataFrame:
    # groups in a row share a bundle while they have at most ``most`` rows together: one row a group in the window
    before = F.sum("_n").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1))
    bundles = stored(sizes.select(*keys, F.floor(F.coalesce(before, F.lit(0)) / most).alias("_bundle")))
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ids])
    rows = df.join(bundles.hint("merge"), keys).select("_bundle", *keys, *ids, text.alias("_text"), F.col(value).cast("double").alias("_v"), F.col(n_pick).cast("long").alias("_k"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ids, kind="stable", na_position="first")
        pdf["_at"], texts = pd.factorize(pdf["_text"])
        one = pdf.groupby(keys, sort=False, dropna=False)
        got = one[["_k"]].first().reset_index()
        got["at"] = [g.to_numpy("<i4").tobytes() for _, g in one["_at"]]
        got["v"] = [g.to_numpy("<f8").tobytes() for _, g in one["_v"]]
        got["texts"] = [list(texts) if i == 0 else None for i in range(len(got))]
        return got.assign(_bundle=int(pdf["_bundle"].iloc[0]))

    packed = stored(rows.groupBy("_bundle").applyInPandas(pack, schema_of(rows, ["_bundle", *keys, "_k"], "at binary", "v binary", "texts array<string>")))
    whole = packed.groupBy("_bundle").agg(F.collect_list(F.struct(*keys, "_k", "at", "v")).alias("groups"), F.flatten(F.collect_list("texts")).alias("texts"))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                groups, numbers = r[pdf.columns.get_loc("groups")], Numbers([t.encode() for t in r[pdf.columns.get_loc("texts")]])
                shared: dict[tuple, list] = {}
                for i, g in enumerate(groups):
                    shared.setdefault((g["_k"], bytes(g["at"])), []).append(i)
                every = np.arange(len(numbers.texts), dtype="<i4").tobytes()
                same = [(int(k), slice(None) if at == every else np.frombuffer(at, "<i4"), of, np.stack([np.frombuffer(groups[i]["v"], "<f8") for i in of], 1)) for (k, at), of in shared.items()]
                draw = np.arange(r[pdf.columns.get_loc("_from")], r[pdf.columns.get_loc("_to")] + 1)
                sums = np.empty((len(draw), len(groups)))
                for s in range(0, len(draw), numbers.batch):
                    u = numbers([f"{seed}:{j}:".encode() for j in draw[s:s + numbers.batch]])
                    for k, at, of, values in same:
                        sums[s:s + numbers.batch, of] = _smallest(u[:, at], k) @ values
                for g, x in zip(groups, sums.T):
                    yield pd.DataFrame({**{c: [g[c]] * len(draw) for c in keys}, "draw": draw, "sum": x})

    return draw_blocks(whole, total, draws).mapInPandas(run, schema_of(df, keys, "draw int", "sum double"))


def _smallest(u: np.ndarray, k: int) -> np.ndarray:
    """1.0 at the ``k`` smallest numbers of each row, 0.0 elsewhere; of equal ones the first."""
    if k <= 0 or k >= u.shape[1]:
        return np.full(u.shape, float(k > 0))
    cut = np.partition(u, k - 1, axis=1)[:, k - 1:k]
    picked = u <= cut
    for i in np.flatnonzero(picked.sum(1) != k):
        picked[i] = False
        picked[i, np.argsort(u[i], kind="stable")[:k]] = True
    return picked.astype(float)


def resample_weights(df: DataFrame, keys: Sequence[str], ids: Sequence[str], reps: int, seed: int) -> DataFrame:
    """n-of-n resampling with replacement: each row with its count ``weight`` per ``rep`` (only rows drawn).

    Row j of a group of n stands for draw slot j and points to row floor(u(rep, j) * n).
    """
    d, slots = _slots(df, list(keys), ids, reps, seed)
    hits = slots.groupBy(*keys, "rep", "_pos").agg(F.count("*").alias("weight"))
    return d.join(hits, [*keys, "_pos"]).drop("_pos")


def resample_columns(df: DataFrame, keys: Sequence[str], ids: Sequence[str], reps: int, seed: int, wide: int = 16) -> DataFrame:
    """The weights of resample_weights side by side: rows with ``_block`` and ``_w0`` to ``_w{wide - 1}``, the weights in reps block * wide + 1 on.

    A draw crosses the network once, as a group, a position and a rep; the rows move once a block and not once a rep.
    """
    keys = list(keys)
    d, slots = _slots(df, keys, ids, reps, seed)
    at = F.col("rep") - 1
    slots = slots.select(*keys, "_pos", F.floor(at / wide).cast("int").alias("_block"), (at % wide).cast("byte").alias("_i")).repartition(*keys, "_pos")
    hits = slots.groupBy(*keys, "_pos", "_block").agg(*[F.count_if(F.col("_i") == i).cast("int").alias(f"_w{i}") for i in range(wide)])
    return d.join(hits.hint("merge"), [*keys, "_pos"]).drop("_pos")


def _slots(df: DataFrame, keys: list[str], ids: Sequence[str], reps: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows with ``_pos``, their place in a seeded order, and one row a draw: keys, rep, ``_pos`` of the row drawn."""
    d = seeded_order(df, keys, ids, seed, "_pos")
    n = d.groupBy(*keys).agg(F.count("*").alias("_n"))
    slots = d.select(*keys, "_pos").join(n, keys).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    target = F.floor(seeded_uniform(seed + 1, *keys, "rep", "_pos") * F.col("_n")).cast("long")
    return d, slots.select(*keys, "rep", target.alias("_pos"))
