"""Ordered work over long series without putting one series into one task.

A recording may hold a large share of all rows.  Windows here are therefore
keyed by (series, chunk of positions), so a task sees at most ``size``
positions plus a halo; what has to cross chunks travels as one summary row per
chunk.  Positions are integers (frame or window index) and keys are not null.
Rows meet their chunk's or recording's summary by a merge join, here and in the
operators: rows that an explode has made look few to the planner, and as a
broadcast they would fill the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CHUNK = 4096
_FIRST = W.unboundedPreceding


def chunk_of(pos: str | Column, size: int = CHUNK) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(size)).cast("long")


def with_halo(df: DataFrame, pos: str, before: int, after: int, size: int = CHUNK) -> DataFrame:
    """Add ``_chunk`` and ``_home``; rows near an edge are copied to the chunks that look at them.

    ``before``/``after`` say how far back and ahead a row looks.
    """
    p = F.col(pos)
    ids = F.sequence(chunk_of(p - F.lit(after), size), chunk_of(p + F.lit(before), size))
    return df.withColumn("_chunk", F.explode(ids)).withColumn("_home", F.col("_chunk") == chunk_of(p, size))


def over_halo(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Mapping[str, "callable"],
    before: int = 0,
    after: int = 0,
    size: int = CHUNK,
) -> DataFrame:
    """Evaluate window columns that look at most ``before`` back and ``after`` ahead.

    Each value of ``columns`` is a function of the ordered window spec.
    """
    h = with_halo(df, pos, before, after, size)
    spec = W.partitionBy(*keys, "_chunk").orderBy(pos)
    h = h.withColumns({name: fn(spec) for name, fn in columns.items()})
    return h.where("_home").drop("_chunk", "_home")


def at_offset(value: str | Column, offset: int):
    """Window function: the value held exactly ``offset`` positions away, else NULL."""
    return lambda spec: F.first(value).over(spec.rangeBetween(offset, offset))


def shift(df: DataFrame, keys: Sequence[str], pos: str, columns: Mapping[str, tuple], size: int = CHUNK) -> DataFrame:
    """Add ``name -> (value, offset)`` columns read at ``pos + offset`` in the same series."""
    offs = [o for _, o in columns.values()]
    return over_halo(
        df, keys, pos, {n: at_offset(v, o) for n, (v, o) in columns.items()},
        before=max(0, -min(offs)), after=max(0, max(offs)), size=size,
    )


def prefix_sum(
    df: DataFrame, keys: Sequence[str], pos: str, values: Mapping[str, str | Column],
    size: int = CHUNK, inclusive: bool = True, bucket: Column | None = None, order: Sequence | None = None,
) -> DataFrame:
    """Running sums along a series: local sums inside a chunk plus the totals of earlier chunks.

    ``bucket`` may replace the position chunk by any column that grows with the order.
    """
    keys = list(keys)
    order = list(order) if order else [pos]
    base = df.withColumn("_chunk", bucket if bucket is not None else chunk_of(pos, size))
    vals = {f"_v_{n}": (F.col(v) if isinstance(v, str) else v) for n, v in values.items()}
    base = base.withColumns(vals)
    totals = base.groupBy(*keys, "_chunk").agg(*[F.sum(v).alias(f"_o{v}") for v in vals])
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(_FIRST, -1)
    totals = totals.withColumns({f"_o{v}": F.coalesce(F.sum(f"_o{v}").over(earlier), F.lit(0)) for v in vals})
    local = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(_FIRST, 0 if inclusive else -1)
    out = base.join(totals.hint("merge"), [*keys, "_chunk"])
    out = out.withColumns({
        n: F.coalesce(F.sum(f"_v_{n}").over(local), F.lit(0)) + F.col(f"_o_v_{n}") for n in values
    })
    return out.drop("_chunk", *vals, *[f"_o{v}" for v in vals])


def ordered_index(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence, name: str) -> DataFrame:
    """0-based rank in each series when only an order exists; ``bucket`` must grow with the order."""
    out = prefix_sum(df, keys, "", {name: F.lit(1)}, bucket=bucket, order=order)
    return out.withColumn(name, (F.col(name) - 1).cast("long"))


def neighbours_known(df: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str], size: int = CHUNK) -> DataFrame:
    """Add ``_prev_v`` and ``_next_v`` for each value v: struct(p, v) of the nearest known value at or before / after."""
    keys = list(keys)
    base = df.withColumn("_chunk", chunk_of(pos, size)).withColumns({
        f"_known_{v}": F.when(F.col(v).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(v).alias("v"))) for v in values
    })
    ends = base.groupBy(*keys, "_chunk").agg(
        *[F.max(f"_known_{v}").alias(f"_hi_{v}") for v in values],
        *[F.min(f"_known_{v}").alias(f"_lo_{v}") for v in values],
    )
    w = W.partitionBy(*keys).orderBy("_chunk")
    ends = ends.select(
        *keys, "_chunk",
        *[F.last(f"_hi_{v}", True).over(w.rowsBetween(_FIRST, -1)).alias(f"_before_{v}") for v in values],
        *[F.first(f"_lo_{v}", True).over(w.rowsBetween(1, W.unboundedFollowing)).alias(f"_after_{v}") for v in values],
    )
    local = W.partitionBy(*keys, "_chunk").orderBy(pos)
    back, ahead = local.rowsBetween(_FIRST, 0), local.rowsBetween(0, W.unboundedFollowing)
    cols = {}
    for v in values:
        cols[f"_prev_{v}"] = F.coalesce(F.last(f"_known_{v}", True).over(back), F.col(f"_before_{v}"))
        cols[f"_next_{v}"] = F.coalesce(F.first(f"_known_{v}", True).over(ahead), F.col(f"_after_{v}"))
    gone = [f"_{n}_{v}" for n in ("known", "before", "after") for v in values]
    return base.join(ends.hint("merge"), [*keys, "_chunk"]).withColumns(cols).drop("_chunk", *gone)


def spread_positions(ranges: DataFrame, keys: Sequence[str], lo: str, hi: str, name: str, size: int = CHUNK) -> DataFrame:
    """One row per integer position in [lo, hi]; long ranges are cut into chunks before they are filled."""
    chunks = ranges.withColumn("_chunk", F.explode(F.sequence(chunk_of(lo, size), chunk_of(hi, size))))
    chunks = chunks.repartition(*keys, "_chunk")
    first = F.greatest(F.col(lo), F.col("_chunk") * size)
    last = F.least(F.col(hi), F.col("_chunk") * size + (size - 1))
    return chunks.withColumn(name, F.explode(F.sequence(first, last))).drop("_chunk")
