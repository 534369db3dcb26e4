"""Near-duplicate components by exact n-gram Jaccard similarity over a count-vector R-tree.

A document is its set of word shingles.  Shingles are hashed into groups (64, or more for longer texts); the counts by group are a point.  For
two points, the sum of coordinate minima bounds the overlap of the sets from above, and for two boxes so does the
sum over their upper corners.

One tree over all points prunes little: in so many dimensions the boxes of unrelated documents of like size overlap
almost fully (see the README).  So the tree is a forest with one tree per shingle, and a document lies only in the
trees of its prefix: two sets that are similar enough share one of the (1 - t) n + 1 rarest shingles of each.  Rarity is
read from counters of fixed size over all documents; it decides the order only, never the result.

Work in a tree never grows with the square of a group of near copies:
1. equal sets are one node;
2. each node meets the first node of each tree it lies in (a star); the survivors of the bound are verified, and verified
   pairs are united to components;
3. only trees that still hold several components go on.  In each round the large ones among them draw DRAWS nodes, which their
   entries of other components meet and which then leave the tree.  The trees of one group of near copies draw different nodes, so each
   copy meets DRAWS for each tree it lies in, and the group falls together.  Rounds go on while they unite a quarter of the components;
4. the entries that are left form leaves of bounded size by size band, leaves have boxes, and only leaf pairs, then entry
   pairs, that pass the bound and lie in different components are verified.
A pair left out is thus excluded by a bound or already in one component; no link between components is lost.  The number of
rounds decides the work only, never the result.

Verification intersects the full shingle sets.  They are recomputed from the texts of candidate nodes only; a bit set of
bounded size keeps the others from being sent.

Defined cases: null and empty texts have no shingles and are linked with nothing; texts with fewer words than the shingle
length are one shingle.  Null doc_id sorts as the largest.  Repeated rows are equal sets.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import Words, mix, runs, utf8
from .shared import Scratch, free_name
from .tables import merged
from .tokens import slices

GROUPS = 64
BOX = 32
LEAF = 256
DRAWS, LARGE = 8, 64
WORD_CELLS, SHINGLE_CELLS = 1 << 19, 1 << 18


def occurrences(words: Words, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its sorted distinct shingle hashes, and the number of a word at which each begins."""
    grams = runs(words.hash, k)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            items, at = np.unique(grams[a : b - k + 1], return_index=True)
            yield items, at + a
        elif b > a:
            yield mix(runs(words.hash[a:b], b - a) + np.uint64(b - a)), np.array([a])
        else:
            yield np.empty(0, "u8"), np.empty(0, "i8")


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, ASCII-lower-cased."""
    return (items for items, _ in occurrences(Words(utf8(texts), lower=True), k))


class Rarity:
    """Orders shingles, rarest first, by counters of a fixed size over all documents.

    A shingle whose own counter stands far above the mean (a repeated passage) comes late, by powers of two; otherwise the
    product of its words' frequencies decides, as a shingle is at most as frequent as its rarest word.
    """

    def __init__(self, cells: np.ndarray):
        words, shingles = cells[:WORD_CELLS], cells[WORD_CELLS:]
        self.word = np.log2(np.maximum(words, 1)).astype("f4")
        self.level = np.log2(np.maximum(shingles / max(1.0, 2 * shingles.mean()), 1)).astype("i1")

    @staticmethod
    def count(texts: list[str | None], k: int, cells: np.ndarray) -> None:
        words = Words(utf8(texts), lower=True)
        sets = [items for items, _ in occurrences(words, k)]
        cells[:WORD_CELLS] += np.bincount((words.hash % np.uint64(WORD_CELLS)).astype("i8"), minlength=WORD_CELLS)
        if sets:
            cells[WORD_CELLS:] += np.bincount((np.concatenate(sets) % np.uint64(SHINGLE_CELLS)).astype("i8"), minlength=SHINGLE_CELLS)

    def ranked(self, texts: list[str | None], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each text's sorted shingles, and their order from rare to frequent."""
        words = Words(utf8(texts), lower=True)
        total = np.concatenate((np.zeros(1), np.cumsum(self.word[(words.hash % np.uint64(WORD_CELLS)).astype("i8")], dtype="f8"), np.zeros(k)))
        for items, at in occurrences(words, k):
            frequency = np.round(total[np.minimum(at + k, len(words.hash))] - total[at], 3)
            yield items, np.lexsort((items, frequency, self.level[(items % np.uint64(SHINGLE_CELLS)).astype("i8")]))


def set_key(items: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(items.tobytes())


def need(n: int, percent: int) -> int:
    """The least overlap that a set of n items must have with any similar one."""
    return -(-percent * n // 100)


def _lists(parts: list[np.ndarray], kind: str) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype("i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0), kind))


def _batches(batch: pa.RecordBatch, column: str):
    texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
    return [(a, b, texts[a:b]) for a, b in slices(texts)]


def resolution(n: int) -> int:
    """Groups for a set of n shingles: about n / 8, a power of two of at least GROUPS.

    A group is a range of hashes, so two neighbouring groups are one group of the next coarser resolution.
    """
    return max(GROUPS, 1 << max(0, min(n, 1 << 15) // 8 - 1).bit_length())


def bound(a: Column, b: Column) -> Column:
    """Summed coordinate minima of two count vectors of one resolution."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, x: s + x)


def halved(v: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), (F.size(v) / 2).cast("int")), lambda i: (F.element_at(v, 2 * i - 1) + F.element_at(v, 2 * i)).cast("smallint"))


def bound_any(a: Column, b: Column) -> Column:
    """The same for sets of like size, whose resolutions are equal or a factor of two apart; further apart is no match."""
    same, first, second = F.size(a) == F.size(b), F.size(a) == 2 * F.size(b), 2 * F.size(a) == F.size(b)
    return F.when(same, bound(a, b)).when(first, bound(halved(a), b)).when(second, bound(a, halved(b))).otherwise(F.lit(0))


def passes(a: str, b: str, percent: int) -> Column:
    """Whether the bound lets the nodes with prefixes a and b be similar."""
    return bound_any(F.col(f"{a}vec"), F.col(f"{b}vec")) * (100 + percent) >= (F.col(f"{a}n") + F.col(f"{b}n")) * percent


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, leaf_rows: int = LEAF
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.  Linked: 100 * overlap >= percent * union."""
    return _grouped(docs, doc_id, text, k, percent, leaf_rows).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, doc_id: str, text: str, k: int, percent: int, leaf_rows: int) -> DataFrame:
    """near_duplicates with the component's node (null without shingles) and the md5 of the text, which tells rows of one id apart."""
    if not 51 <= percent <= 100:
        raise ValueError("percent must be 51 to 100: sets of less like sizes have no common resolution")
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = rows.withColumn("mark", text_mark("text"))

    def count(batches: Iterator[pa.RecordBatch], cells: np.ndarray) -> None:
        for batch in batches:
            for _, _, texts in _batches(batch, "text"):
                Rarity.count(texts, k, cells)

    rarity = spark.sparkContext.broadcast(Rarity(merged(rows.select("text"), count, WORD_CELLS + SHINGLE_CELLS, "i8", np.add)))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, marks = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "mark"))
            for a, b, texts in _batches(batch, "text"):
                n, keys, vecs, prefixes = [], [], [], []
                for s, order in rarity.value.ranked(texts, k):
                    n.append(len(s))
                    keys.append(set_key(s))
                    groups = resolution(len(s))
                    vecs.append(np.bincount((s >> np.uint64(65 - groups.bit_length())).astype("i8"), minlength=groups).astype("i2"))
                    first = len(s) - need(len(s), percent) + 1 if len(s) else 0
                    prefixes.append(s[order[:first]].view("i8"))
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], marks[a:b], pa.array(np.arange(at, at + b - a)), pa.array(n, "int32"), pa.array(keys, "binary"), _lists(vecs, "int16"), _lists(prefixes, "int64")],
                    ["doc_id", "mark", "row", "n", "key", "vec", "prefix"],
                )
                at += b - a

    all_points = scratch.keep(marked.mapInArrow(points, "doc_id long, mark binary, row long, n int, key binary, vec array<smallint>, prefix array<long>"), "points")
    ids = scratch.keep(all_points.select("doc_id", "mark", "row", "n", "key"), "ids")
    sets = scratch.keep(ids.where("n > 0").groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"), F.first("n").alias("n")), "sets")
    nodes = all_points.join(sets.select("node"), F.col("row") == F.col("node"), "left_semi")
    nodes = scratch.keep(nodes.select(F.col("row").alias("node"), "n", "vec", "prefix"), "prefixed")
    scratch.drop("points")

    entries = nodes.select("node", F.explode("prefix").alias("tree"))
    trees = entries.groupBy("tree").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = scratch.keep(entries.join(trees, "tree"), "shared")
    nodes = scratch.keep(nodes.select("node", "n", "vec", coarse("vec").alias("box")), "nodes")
    scratch.drop("prefixed")  # prefixes are the larger part of points and nodes; from here on the trees hold them

    texts = _Sets(rows, sets, k, percent, scratch)
    stars = shared.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    roots = scratch.keep(components(texts.verified(_bounded(stars, nodes, percent), "star")), "roots0")
    entries = shared.where("c > 2 AND node <> pivot").select("tree", "node")
    opened = scratch.keep(_open(entries, roots).join(nodes.select("node", "n", "box"), "node"), "open0")
    scratch.drop("shared")
    turn, apart, before = 0, _apart(opened), None
    while apart and (before is None or 4 * apart <= 3 * before):
        turn, before = turn + 1, apart
        drawn = scratch.keep(_drawn(opened, turn), f"drawn{turn}")
        roots = _joined(roots, texts.verified(_bounded(_star_pairs(opened, drawn, percent), nodes, percent), f"star{turn}"), scratch, turn)
        rest = opened.join(drawn.select("tree", "node"), ["tree", "node"], "left_anti").drop("root")
        opened = scratch.keep(_open(rest, roots), f"open{turn}")
        scratch.drop(f"open{turn - 1}", f"drawn{turn}")
        apart = _apart(opened)
    roots = _joined(roots, texts.verified(_leaf_pairs(opened, nodes, percent, leaf_rows, scratch), "leaf"), scratch, turn + 1)
    texts.close()
    scratch.drop("nodes", f"open{turn}")

    named = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = scratch.keep(named.select("key", "root", "low"), "named")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.join(lows, "root").select("key", "root", "component_id")
    linked = ids.where("n > 0").join(classes, "key").select("doc_id", "mark", F.col("n").cast("long").alias("n_shingles"), "component_id", "root")
    alone = ids.where("n = 0").select("doc_id", "mark", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return linked.unionByName(alone)


def text_mark(text: str) -> Column:
    """16 bytes that stand for the text beside its id."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _side(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("vec").alias(f"{name}_vec"))


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bound of their points lets through."""
    return pairs.join(_side(nodes, "a"), "a").join(_side(nodes, "b"), "b").where(passes("a_", "b_", percent)).select("a", "b")


def coarse(vec: str) -> Column:
    """The count vector summed to BOX coordinates; its bound holds too, and it is short."""
    step = (F.size(vec) / BOX).cast("int")
    return F.array(*[F.aggregate(F.slice(vec, F.lit(1) + step * i, step), F.lit(0), lambda s, x: s + x) for i in range(BOX)])


def _open(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries (tree, node and further columns) of trees that hold several components, with the component."""
    named = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = named.groupBy("tree").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("tree")
    return named.join(mixed, "tree", "left_semi")


def _apart(opened: DataFrame) -> int:
    """How many components meet in large trees."""
    large = opened.groupBy("tree").count().where(F.col("count") > LARGE)
    return opened.join(large, "tree", "left_semi").agg(F.count_distinct("root")).first()[0]


def _drawn(opened: DataFrame, turn: int) -> DataFrame:
    """The entries that large trees draw in this round."""
    draws = [F.max_by("node", F.xxhash64("node", "tree", F.lit(turn), F.lit(i))) for i in range(DRAWS)]
    picked = opened.groupBy("tree").agg(F.count(F.lit(1)).alias("c"), F.array(*draws).alias("picked")).where(F.col("c") > LARGE)
    return opened.join(picked.select("tree", F.explode(F.array_distinct("picked")).alias("node")), ["tree", "node"], "left_semi")


def _star_pairs(opened: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """Entries against those their tree draws, where sizes and short points let them be similar and the components differ."""
    centre = drawn.select("tree", *[F.col(c).alias(f"p_{c}") for c in ("node", "root", "n", "box")])
    like = F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent
    near = bound(F.col("box"), F.col("p_box")) * (100 + percent) >= (F.col("n") + F.col("p_n")) * percent
    met = opened.join(centre, "tree").where((F.col("root") != F.col("p_root")) & like & near)
    return met.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()


def _joined(roots: DataFrame, links: DataFrame, scratch: Scratch, turn: int) -> DataFrame:
    """Components of the earlier ones with more links."""
    return scratch.keep(components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), f"roots{turn}")


def _leaf_pairs(entries: DataFrame, nodes: DataFrame, percent: int, leaf_rows: int, scratch: Scratch) -> DataFrame:
    """Entry pairs of different components in one tree that pass the bounds of their leaves and their own.

    Entries and boxes carry BOX coordinates; the full vectors join the pairs that are left.
    """
    entries = entries.withColumn("band", F.floor(F.log("n") / float(-np.log(percent / 100))).cast("int"))
    sizes = entries.groupBy("tree", "band").agg(F.ceil(F.count(F.lit(1)) / leaf_rows).alias("leaves"))
    entries = entries.join(sizes, ["tree", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("leaves"))).drop("leaves")
    entries = scratch.keep(entries, "entries")
    leaves = entries.groupBy("tree", "band", "part").agg(
        F.min("n").alias("least"), F.min("root").alias("r0"), F.max("root").alias("r1"), *[F.max(F.col("box")[i]).alias(f"m{i}") for i in range(BOX)]
    ).select("tree", "band", "part", "least", "r0", "r1", F.array(*[f"m{i}" for i in range(BOX)]).alias("top"))

    def renamed(df: DataFrame, mark: str) -> DataFrame:
        return df.select([F.col("tree") if c == "tree" else F.col(c).alias(mark + c) for c in df.columns])

    one, two = renamed(leaves, "x"), renamed(leaves, "y")
    meets = (bound(F.col("xtop"), F.col("ytop")) * (100 + percent) >= (F.col("xleast") + F.col("yleast")) * percent) & (
        ((F.col("yband") == F.col("xband")) & (F.col("xpart") <= F.col("ypart"))) | (F.col("yband") == F.col("xband") + 1)
    ) & ~((F.col("xr0") == F.col("xr1")) & (F.col("yr0") == F.col("yr1")) & (F.col("xr0") == F.col("yr0")))
    pairs = one.join(two, (one["tree"] == two["tree"]) & meets).select(one["tree"], "xband", "xpart", "yband", "ypart")
    left = pairs.join(renamed(entries, "x"), ["tree", "xband", "xpart"])
    right = renamed(entries, "y")
    same = (F.col("xband") != F.col("yband")) | (F.col("xpart") != F.col("ypart")) | (F.col("xnode") < F.col("ynode"))
    like = F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * percent  # cheap, so it comes first
    near = like & (bound(F.col("xbox"), F.col("ybox")) * (100 + percent) >= (F.col("xn") + F.col("yn")) * percent)
    both = left.join(right, ["tree", "yband", "ypart"]).where(same & (F.col("xroot") != F.col("yroot")) & near)
    return _bounded(both.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct(), nodes, percent)


class _Sets:
    """Full shingle sets of candidate nodes, computed from the texts once for each node that some pair asks for."""

    def __init__(self, rows: DataFrame, sets: DataFrame, k: int, percent: int, scratch: Scratch):
        self.rows, self.sets, self.k, self.percent, self.scratch = rows, sets, k, percent, scratch
        self.found: DataFrame | None = None
        self.names: list[str] = []

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        pairs = self.scratch.keep(pairs, f"{name}_pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if self.found is not None:
            wanted = wanted.join(self.found.select("node"), "node", "left_anti")
        wanted = self.scratch.keep(self.sets.join(wanted, "node").select("node", "key", "low"), f"{name}_wanted")
        many = wanted.count()
        if many or self.found is None:
            new = self.scratch.keep(self._from_texts(wanted, many), f"{name}_items")
            self.found = new if self.found is None else self.found.unionByName(new)
            self.names.append(f"{name}_items")
        left, right = (self.found.select(F.col("node").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab")
        overlap = F.size(F.array_intersect("a_items", "b_items"))
        links = pairs.join(left, "a").join(right, "b").where(overlap * (100 + self.percent) >= (F.size("a_items") + F.size("b_items")) * self.percent)
        links = self.scratch.keep(links.select("a", "b"), f"{name}_links")
        self.scratch.drop(f"{name}_pairs", f"{name}_wanted")
        return links

    def close(self) -> None:
        self.scratch.drop(*self.names)

    def _from_texts(self, wanted: DataFrame, many: int) -> DataFrame:
        k = self.k
        bits = 1 << max(16, min(29, int(16 * max(1, many)).bit_length()))

        def spots(keys: list[bytes], ids: list[int | None]) -> np.ndarray:
            raw = np.frombuffer(b"".join(keys), "u8").reshape(-1, 2)
            own = np.array([-1 if i is None else i for i in ids], "i8").view("u8")
            return np.stack([mix(raw[:, j] ^ mix(own)) & np.uint64(bits - 1) for j in (0, 1)]).astype("i8")

        def fill(batches: Iterator[pa.RecordBatch], cells: np.ndarray) -> None:
            for batch in batches:
                if batch.num_rows:
                    at = spots(batch.column(0).to_pylist(), batch.column(1).to_pylist()).ravel()
                    np.bitwise_or.at(cells, at >> 3, np.left_shift(1, at & 7).astype("u1"))

        seen = self.rows.sparkSession.sparkContext.broadcast(merged(wanted.select("key", "low"), fill, bits // 8, "u1", np.bitwise_or))

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
                for a, b, texts in _batches(batch, "text"):
                    own = list(shingle_sets(texts, k))
                    keys = [set_key(s) for s in own]
                    at = spots(keys, ids[a:b])
                    keep = np.flatnonzero(((seen.value[at >> 3] >> (at & 7).astype("u1")) & 1).all(0)).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[a + i] for i in keep], "int64"), pa.array([keys[i] for i in keep], "binary"), _lists([own[i].view("i8") for i in keep], "int64")],
                        ["own_id", "own_key", "items"],
                    )

        found = self.rows.mapInArrow(full, "own_id long, own_key binary, items array<long>")
        found = found.join(wanted, (F.col("own_key") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("low"))).select("node", "items")
        return found.dropDuplicates(["node"])


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, leaf_rows: int = LEAF) -> DataFrame:
    """One document of each component, the one with the smallest id (no id comes last, then by digest); columns as given.

    Rows are told apart by id and text.  Rows that repeat both are one document and stay or go together; texts without words stay.
    """
    groups = Scratch(docs.sparkSession, "keep_first").keep(_grouped(docs, doc_id, text, k, percent, leaf_rows).where("root IS NOT NULL").select("root", "doc_id", "mark"), "groups")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("best"), F.count(F.lit(1)).alias("c")).where("c > 1")
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("mark") == F.col("best.mark"))
    name, mark = free_name(docs, "_gone"), free_name(docs, "_mark")
    gone = groups.join(best, "root").where(~same).select(F.col("doc_id").alias(name), F.col("mark").alias(f"{name}_mark")).distinct()
    marked = docs.withColumn(mark, text_mark(text))
    own = F.col(doc_id).cast("long").eqNullSafe(F.col(name)) & (F.col(mark) == F.col(f"{name}_mark"))
    return marked.join(gone, own, "left_anti").select(*docs.columns)
