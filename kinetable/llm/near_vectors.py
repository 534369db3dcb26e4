"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks in double precision.

A table hashes a normalised vector to the cells of ``m`` Gaussian projections, cut into steps of ``width``.  ``m`` grows
with the logarithm of the number of different vectors, so that unrelated vectors share few buckets, and the number of
tables follows from ``m`` and the recall wanted for a pair exactly at the threshold; closer pairs are found more often.

Pairs are never listed inside a group of near copies:
1. equal vectors are one class;
2. in a bucket of two tables together, the smallest class leads.  A class within half the threshold angle of a leader lies in
   that leader's ball; any two classes of a ball are linked by the triangle inequality, without looking at the pair;
3. buckets hold balls.  A bucket of more than ``block`` balls is cut into blocks, and only block pairs of bounded
   size meet in a task.  Two balls remain if the distance of a projection of their centres to 16 orthonormal directions
   (a lower bound) and their radii allow a link;
4. the exact angle of the centres and the radii then say that all, none, or some members are linked; in the last
   case members meet in blocks and each pair is decided by its own cosine, and only counts leave the task.
A pair that is not found shares no bucket in any table, nor do any two members of its balls.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components are linked with nothing, as are vectors
of different lengths with each other.  Repeated rows are equal vectors.  A null id counts as a row; a component's id is the
smallest id in it, null if all are null (such rows are kept).  An empty table gives an empty result.  Other
columns are not read and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import mix
from .shared import Scratch

SLACK = 1e-6  # radians; rounding of an angle stays far below
SKETCH = 16
UNIT = 127.0


def same_cell(distance: float, width: float) -> float:
    """Probability that two vectors at ``distance`` share the cell of one projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, least: float, recall: float, width: float, crowd: int) -> tuple[int, int]:
    """(projections a table, tables): about ``crowd`` unrelated vectors a bucket; the recall holds at the threshold."""
    m = max(2, math.ceil(math.log(max(2.0, n / crowd)) / -math.log(same_cell(math.sqrt(2), width))))
    hit = same_cell(math.sqrt(2 - 2 * least), width) ** m
    return m, 2 * math.ceil(math.log(1 - recall) / math.log1p(-hit) / 2)


class Hashes:
    """Bucket numbers and sketches of unit vectors; all random numbers follow from the seed and the dimension."""

    def __init__(self, m: int, tables: int, width: float, seed: int):
        self.m, self.tables, self.width, self.seed, self.made = m, tables, width, seed, {}

    def _parts(self, d: int):
        if d not in self.made:
            rng = np.random.default_rng([self.seed, d])
            lines = rng.standard_normal((d, self.tables * self.m))
            shift = rng.uniform(0, self.width, self.tables * self.m)
            odd = rng.integers(0, 1 << 63, (self.tables, self.m), "u8") * np.uint64(2) + np.uint64(1)
            name = mix(np.arange(1, self.tables + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d))
            basis = np.linalg.qr(rng.standard_normal((d, min(d, SKETCH))))[0]
            self.made[d] = lines, shift, odd, name, basis
        return self.made[d]

    def buckets(self, x: np.ndarray) -> np.ndarray:
        lines, shift, odd, name, _ = self._parts(x.shape[1])
        cells = np.floor((x @ lines + shift) / self.width).astype("i8").astype("u8").reshape(len(x), self.tables, self.m)
        return mix((cells * odd).sum(axis=2, dtype="u8") ^ name)

    def sketch(self, x: np.ndarray) -> np.ndarray:
        basis = self._parts(x.shape[1])[4]
        out = np.zeros((len(x), SKETCH), "i1")
        out[:, : basis.shape[1]] = np.rint(x @ basis * UNIT)
        return out.view("<i8")


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each vector length in a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        x = flat[starts[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches cut so that no group of equal keys is torn, each with the bounds of its groups."""
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        turn = np.zeros(len(whole), bool)
        turn[0] = True
        for k in keys:
            values = longs(whole, k)
            turn[1:] |= values[1:] != values[:-1]
        return whole, np.flatnonzero(turn)

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        whole, firsts = joined()
        if firsts[-1]:
            yield whole.slice(0, firsts[-1]), firsts
            held = [whole.slice(firsts[-1])]
        else:
            held = [whole]
    if held:
        whole, firsts = joined()
        yield whole, np.append(firsts, len(whole))


def pairs_within(bounds: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), i < j, inside each group of consecutive rows, some millions at a time."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    follow = ends - np.arange(len(ends)) - 1
    total = np.cumsum(follow)
    at = 0
    while at < len(follow):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        i = np.repeat(np.arange(at, stop), follow[at:stop])
        before = np.repeat(total[at:stop] - follow[at:stop], follow[at:stop])
        yield i, i + 1 + np.arange(len(i)) + (total[at - 1] if at else 0) - before
        at = stop


def in_blocks(rows: DataFrame, key: list[str], sizes: DataFrame, block: int, salt: str) -> DataFrame:
    """Rows of each group dealt to blocks of about ``block``, once for every pair of blocks (low, high) they take part in."""
    counted = rows.join(sizes, key).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    dealt = counted.withColumn("own", F.pmod(F.xxhash64(salt, F.lit(41)), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("blocks", "other", "size")


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", least: float = 0.95, recall: float = 0.99, width: float = 2.0, crowd: int = 16, block: int = 256, seed: int = 11) -> DataFrame:
    """(id_column, n_links, component_id, kept) for every row of ``vectors``.

    n_links: other rows linked directly; component_id: smallest id reachable by links, its own included.
    """
    if not 0 < least <= 1 or not 0 < recall < 1:
        raise ValueError("0 < least <= 1 and 0 < recall < 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "near_vectors")
    theta = math.acos(least)
    narrow = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = narrow.withColumn("v", F.when(usable, F.col("v")))
    classes = rows.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("least_id"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    if n == 0:
        return rows.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    m, tables = plan_tables(n, least, recall, width, crowd)
    hashes = Hashes(m, tables, width, seed)

    nodes = _balls(classes, hashes, theta, scratch)
    balls = nodes.groupBy("ball").agg(F.max("angle").alias("radius"), F.sum("c").alias("weight"), F.count(F.lit(1)).alias("members"))
    balls = scratch.keep(balls.join(classes.select(F.col("node").alias("ball"), "v"), "ball"), "balls")

    met = scratch.keep(_ball_pairs(nodes, balls, hashes, theta, block), "met")
    judged = scratch.keep(_judge(met, balls, least, theta), "judged")
    some = judged.where("sure = 0").select("p", "q")
    counts = scratch.keep(_count_members(some, nodes, balls, least, block), "counts")

    sure = judged.where("sure = 1")
    whole = sure.select(F.col("p").alias("ball"), F.col("wq").alias("w")).unionByName(sure.select(F.col("q").alias("ball"), F.col("wp").alias("w")))
    by_ball = whole.groupBy("ball").agg(F.sum("w").alias("all_linked"))
    by_node = counts.where("edge = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("some_linked"))
    edges = sure.select(F.col("p").alias("a"), F.col("q").alias("b")).unionByName(counts.where("edge = 1").select("a", "b"))
    roots = components(edges).select(F.col("node").alias("ball"), "root")

    done = nodes.join(balls.select("ball", "weight"), "ball").join(by_ball, "ball", "left").join(roots, "ball", "left").join(by_node, "node", "left")
    done = done.select(
        "node", "least_id", F.coalesce("root", "ball").alias("root"),
        (F.col("weight") - 1 + F.coalesce("all_linked", F.lit(0)) + F.coalesce("some_linked", F.lit(0))).alias("n_links"),
    )
    done = scratch.keep(done, "done")
    names = done.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = done.join(names, "root").join(classes.select("node", "v"), "node").select("v", "n_links", "component_id")
    out = rows.join(named, "v", "left")  # unusable vectors are null and find nothing
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )


def _balls(classes: DataFrame, hashes: Hashes, theta: float, scratch: Scratch) -> DataFrame:
    """(node, c, least_id, v, ball, angle): each class with the ball it lies in and its angle from the ball's centre."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = longs(batch, "node")
            for own, x in matrices(batch.column("v")):
                b = hashes.buckets(x)
                twice = mix(b[:, 0::2] * np.uint64(3) + b[:, 1::2])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[own], twice.shape[1])), pa.array(twice.ravel().view("i8"))], ["node", "bucket"])

    tight = scratch.keep(classes.select("node", "v").mapInArrow(narrow, "node long, bucket long"), "tight")
    leads = tight.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "leader")
    asked = tight.join(leads, "bucket").where("node <> leader").select("node", "leader").distinct()
    asked = asked.join(classes.select("node", "v"), "node").join(classes.select(F.col("node").alias("leader"), F.col("v").alias("u")), "leader")
    near = math.cos(theta / 2 - SLACK)

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = paired_cosines(batch.column("v"), batch.column("u"))
            ok = cosine >= near
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(pa.array(ok)), batch.column("leader").filter(pa.array(ok)), pa.array(np.arccos(np.minimum(cosine[ok], 1.0)))], ["node", "leader", "angle"])

    found = asked.select("node", "leader", "v", "u").mapInArrow(led, "node long, leader long, angle double")
    found = found.groupBy("node").agg(F.min(F.struct("leader", "angle")).alias("best"))
    joined = classes.join(found, "node", "left")
    return scratch.keep(joined.select("node", "c", "least_id", "v", F.coalesce("best.leader", "node").alias("ball"), F.coalesce("best.angle", F.lit(0.0)).alias("angle")), "nodes")


def paired_cosines(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Cosine of each pair of rows; -1 where lengths differ."""
    out = np.full(len(left), -1.0)
    a, b = ({x.shape[1]: (rows, x) for rows, x in matrices(side)} for side in (left, right))
    for d in a.keys() & b.keys():
        (i, x), (j, y) = a[d], b[d]
        both, at, to = np.intersect1d(i, j, assume_unique=True, return_indices=True)
        out[both] = np.einsum("ij,ij->i", x[at], y[to])
    return out


def _ball_pairs(nodes: DataFrame, balls: DataFrame, hashes: Hashes, theta: float, block: int) -> DataFrame:
    """(p, q), p < q: balls that share a bucket and whose sketches and radii allow a link."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ball, radius = longs(batch, "ball"), longs(batch, "radius")
            centre = np.zeros((len(batch), 2), "<i8")
            for own, u in matrices(batch.column("u")):
                centre[own] = hashes.sketch(u)
            for own, x in matrices(batch.column("v")):
                b = hashes.buckets(x).view("i8")
                k = np.repeat(own, b.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (b.ravel(), ball[k], radius[k], centre[k, 0], centre[k, 1])], ["bucket", "ball", "radius", "s0", "s1"])

    with_centre = nodes.select("ball", "v").join(balls.select("ball", "radius", F.col("v").alias("u")), "ball")
    entries = with_centre.mapInArrow(spread, "bucket long, ball long, radius double, s0 long, s1 long").dropDuplicates(["bucket", "ball"])
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    lanes = in_blocks(entries, ["bucket"], sizes, block, "ball")
    keys = ["bucket", "low", "high"]
    lanes = lanes.repartition(*keys).sortWithinPartitions(*keys)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, keys):
            ball, own, radius = longs(batch, "ball"), longs(batch, "own"), longs(batch, "radius")
            mixed = longs(batch, "low") != longs(batch, "high")
            sketch = np.stack([longs(batch, "s0"), longs(batch, "s1")], 1).astype("<i8").view("i1").astype("f4")
            for i, j in pairs_within(bounds):
                apart = ((sketch[i] - sketch[j]) ** 2).sum(axis=1)
                reach = 2 * np.sin(np.minimum((theta + radius[i] + radius[j]) / 2, math.pi / 2)) + math.sqrt(SKETCH) / UNIT + SLACK
                ok = (apart <= (reach * UNIT) ** 2) & (~mixed[i] | (own[i] != own[j]))
                i, j = i[ok], j[ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ball[i], ball[j])), pa.array(np.maximum(ball[i], ball[j]))], ["p", "q"])

    return lanes.mapInArrow(meet, "p long, q long").distinct()


def _judge(met: DataFrame, balls: DataFrame, least: float, theta: float) -> DataFrame:
    """(p, q, wp, wq, sure): 1 if all members are linked, 0 if some may be; pairs with no link are left out."""
    sides = [balls.select(F.col("ball").alias(k), F.col("weight").alias(f"w{k}"), F.col("radius").alias(f"r{k}"), F.col("v").alias(f"v{k}")) for k in "pq"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = paired_cosines(batch.column("vp"), batch.column("vq"))
            angle, r = np.arccos(np.clip(cosine, -1, 1)), longs(batch, "rp") + longs(batch, "rq")
            points = r == 0
            sure = np.where(points, cosine >= least, angle + r <= theta - SLACK)
            keep = pa.array(np.where(points, sure, angle - r <= theta + SLACK))
            cols = [batch.column(k).filter(keep) for k in ("p", "q", "wp", "wq")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sure.astype("i4")).filter(keep)], ["p", "q", "wp", "wq", "sure"])

    return met.join(sides[0], "p").join(sides[1], "q").mapInArrow(judge, "p long, q long, wp long, wq long, sure int")


def _count_members(some: DataFrame, nodes: DataFrame, balls: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b, edge): edge 0, class a is linked with b more rows of another ball; edge 1, balls a and b hold a link."""
    parts = balls.select("ball", F.ceil(F.col("members") / block).cast("int").alias("parts"))
    member = nodes.select("ball", "node", "c", "v").join(parts, "ball").withColumn("part", F.pmod(F.xxhash64("node", F.lit(43)), F.col("parts")).cast("int"))
    tiles = some.join(parts.toDF("p", "np"), "p").join(parts.toDF("q", "nq"), "q")
    tiles = tiles.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("np") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    member = member.select("ball", "part", "node", "c", "v")
    left = tiles.join(member.toDF("p", "i", "node", "c", "v"), ["p", "i"]).withColumn("side", F.lit(0))
    right = tiles.join(member.toDF("q", "j", "node", "c", "v"), ["q", "j"]).withColumn("side", F.lit(1))
    keys = ["p", "q", "i", "j"]
    both = left.unionByName(right).select(*keys, "side", "node", "c", "v").repartition(*keys).sortWithinPartitions(*keys, "side")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, keys):
            node, c, side, p, q = (longs(batch, k) for k in ("node", "c", "side", "p", "q"))
            out: list[np.ndarray] = []
            units = list(matrices(batch.column("v")))  # balls of one pair have one length
            x = np.zeros((len(batch), max(u.shape[1] for _, u in units)))
            for rows, unit in units:
                x[rows, : unit.shape[1]] = unit
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                mid = lo + int((side[lo:hi] == 0).sum())
                hit = x[lo:mid] @ x[mid:hi].T >= least
                if hit.any():
                    here, there = hit @ c[mid:hi], c[lo:mid] @ hit
                    out.append(np.stack([node[lo:mid], here, np.zeros_like(here)], 1))
                    out.append(np.stack([node[mid:hi], there, np.zeros_like(there)], 1))
                    out.append(np.array([[p[lo], q[lo], 1]]))
            flat = np.concatenate(out) if out else np.zeros((0, 3), "i8")
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(flat[:, 2].astype("i4"))], ["a", "b", "edge"])

    return both.mapInArrow(count, "a long, b long, edge int")
