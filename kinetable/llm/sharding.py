"""Sharding by a hierarchical weighted hash tree.

A shard lives in a rack, a rack in a region.  A document descends region, rack, shard; at each level every child makes
an exponential draw ``-ln(u) / weight`` from a hash of (document key, child name), and the smallest draw wins.  A
child's weight is the sum below it, so each shard receives documents in proportion to its weight.  A draw depends on
the child's own name and weight only: if a weight changes, documents move to or from that child and nowhere else.

``grow`` puts a new shard into a region of its own.  No other weight changes, so documents move only into it.  Adding
inside an existing region is possible too (build the tree that way); rows then also move within that region.

Defined cases: null text has size ``overhead``; a null key hashes as the word null; repeated rows share a shard and get
different slots; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, per_region: int = 8) -> list[Shard]:
    return [Shard(f"g{i // per_region}", f"k{i // per_rack}", i) for i in range(shards)]


def grow(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a new region and rack."""
    regions, racks = {s.region for s in tree}, {s.rack for s in tree}
    new = max(s.shard for s in tree) + 1
    region = next(f"g{i}" for i in range(len(regions) + 1) if f"g{i}" not in regions)
    rack = next(f"k{i}" for i in range(len(racks) + 1) if f"k{i}" not in racks)
    return [*tree, Shard(region, rack, new, weight)]


def unit(key: Column, name: Column) -> Column:
    """A number in (0, 1) from 52 bits of md5(key/name); any SQL engine can repeat it."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, name)), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def _children(items: Sequence[tuple[str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(i).alias("at")) for i, (n, w) in enumerate(items)])


def _pick(key: Column, children: Column) -> Column:
    draws = F.transform(children, lambda c: F.struct((-F.log(unit(key, c["name"])) / c["weight"]).alias("draw"), c["at"].alias("at")))
    return F.array_min(draws)["at"]


def _sums(pairs) -> dict[str, float]:
    out: dict[str, float] = {}
    for name, weight in pairs:
        out[name] = out.get(name, 0.0) + weight
    return out


def shard_of(df: DataFrame, key: Column, tree: Sequence[Shard], out: str) -> DataFrame:
    """Adds column ``out`` with the shard that the tree draws for ``key``."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    regions = _sums((s.region, s.weight) for s in tree)
    racks = {r: _sums((s.rack, s.weight) for s in tree if s.region == r) for r in regions}
    shards = {(r, k): [(f"s{s.shard}", s.weight) for s in tree if (s.region, s.rack) == (r, k)] for r in regions for k in racks[r]}
    numbers = F.array(*[F.array(*[F.array(*[F.lit(int(n[1:])) for n, _ in shards[r, k]]) for k in racks[r]]) for r in regions])
    rack_lists = F.array(*[_children(list(racks[r].items())) for r in regions])
    shard_lists = F.array(*[F.array(*[_children(shards[r, k]) for k in racks[r]]) for r in regions])
    df = df.withColumn("_region", _pick(key, _children(list(regions.items()))))
    df = df.withColumn("_rack", _pick(key, rack_lists[F.col("_region")]))
    df = df.withColumn("_shard", _pick(key, shard_lists[F.col("_region")][F.col("_rack")]))
    return df.withColumn(out, numbers[F.col("_region")][F.col("_rack")][F.col("_shard")]).drop("_region", "_rack", "_shard")


def assign_shards(
    docs: DataFrame,
    shards: int = 40,
    doc_id: str = "doc_id",
    text: str = "text",
    overhead: int = 16,
    rows_per_run: int = 50_000,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots follow the document's own hash.  They are numbered in runs of about ``rows_per_run`` rows of a shard, and run
    starts come from a table of run sizes, so no shard is sorted in one task.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    tree = even_tree(shards)
    key = F.col("doc_id")
    rows = shard_of(shard_of(rows, key, tree, "shard"), key, grow(tree), "grown_shard")
    runs = max(1, math.ceil(docs.count() / (shards * rows_per_run)))
    rows = rows.withColumn("place", unit(F.coalesce(key.cast("string"), F.lit("null")), F.lit("slot")))
    rows = rows.withColumn("run", F.floor(F.col("place") * runs).cast("int"))
    starts = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "run").orderBy("place", "doc_id", "size", "text_crc32")
    return rows.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth")).alias("slot"), "grown_shard"
    )
