"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts and benchmark items are normalised (ASCII lower case, each run of white space one space).  An item is covered by
overlapping parts of ``part`` bytes (a shorter item is one part).  A part of m bytes occurs in a text within
k = m * percent / 100 edits only if some diagonal band shares at least m - q + 1 - k * q of its q-grams with the text.
Bands of width 2 k overlap by half, so any k-wide spread of diagonals lies inside one band.  Regions that reach the bound
are verified by alignment inside the band.

Parts start every k bytes, so a verbatim excerpt of ``part`` bytes or more, from wherever in an item, lacks fewer than k
bytes of some part and is found; one of part + k - 1 bytes holds a whole part and may have k edits in it.

q-grams are indexed once an item.  Hits first have to fill a band of their item (which every part's band must lie in);
only those are dealt to the parts that cover them.

Documents stream past the item index in one pass without a shuffle.  The index is sent in blocks of items of bounded
size (``block_chars`` characters each); a larger benchmark means more blocks, each a pass of its own.

Defined cases: null and empty texts and items match nothing; items shorter than 2 q characters must occur unchanged.
Repeated documents and items are reported each.  Null ids are reported as null.  Empty tables give an empty result.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import give_back, slices

_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
SIEVE = 1 << 22


def normal(text: str | None) -> bytes:
    """ASCII lower case with single spaces, as UTF-8; lengths and edits below count bytes."""
    return _SPACE.sub(b" ", text.encode().lower()).strip() if isinstance(text, str) else b""


def grams(data: bytes, q: int) -> np.ndarray:
    """Each run of q <= 8 bytes as one number."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, "u8")
    words = np.ndarray(n, "<u8", data + bytes(8 - q), strides=(1,))
    return words & np.uint64((1 << 8 * q) - 1)


def sieve_at(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SIEVE.bit_length() + 1)).astype("i8")


def align(part: bytes, region: bytes, k: int) -> tuple[int, int, int] | None:
    """Least edits of ``part`` against any stretch of ``region`` if at most k, with the stretch's bounds.

    Banded: in the row after r characters of the part only the places r - k .. r + spare + k of the region are
    kept, spare being what the region is longer than the part.  A path with k edits cannot leave that band.
    """
    p, m, n = np.frombuffer(part, "u1"), len(part), len(region)
    band = n - m + 2 * k + 1
    if band < 1:
        return None
    far = m + n + 1
    t = np.full(m + band + 1, 256, "i2")  # t[i] is the character before place i - k
    t[k + 1 : min(len(t), k + 1 + n)] = np.frombuffer(region, "u1")[: max(0, len(t) - k - 1)]
    steps = np.arange(band)
    inside = (steps - k >= 0) & (steps - k <= n)
    cost, start = np.where(inside, 0, far), steps - k
    for r, c in enumerate(p, 1):
        before = t[r : r + band]
        new = cost + np.where(before == 256, far, before != c)
        origin = start.copy()
        skip = cost[1:] + 1  # the part's character is missing from the region
        better = skip < new[:-1]
        new[:-1][better] = skip[better]
        origin[:-1][better] = start[1:][better]
        slope = new - steps  # characters only the region has: a running minimum along the row
        least = np.minimum.accumulate(slope)
        where = np.maximum.accumulate(np.where(slope == least, steps, 0))
        cost, start = np.minimum(least + steps, far), origin[where]
        if cost.min() > k:
            return None
    place = steps - k + m
    cost = np.where((place >= 0) & (place <= n), cost, far)
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), int(place[end])) if cost[end] <= k else None


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ranges lo .. hi - 1 one after another, and how many each range has."""
    n = hi - lo
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), n


class Index:
    """q-grams of a block of items, and the parts of each."""

    def __init__(self, items: list[tuple[int | None, bytes]], q: int, percent: int, part: int):
        self.q, self.texts = q, [text for _, text in items if text]
        ids = [item for item, text in items if text]
        step = max(1, part * percent // 100)
        places = [sorted({*range(0, max(0, len(t) - part) + 1, step), max(0, len(t) - part)}) for t in self.texts]
        self.owner = np.repeat(np.arange(len(places)), [len(a) for a in places])
        self.item = [ids[i] for i in self.owner]
        self.place = np.array([a for own in places for a in own], "i8")
        whole = np.array([len(t) for t in self.texts], "i8")
        self.size = np.minimum(whole, part)[self.owner]
        self.budget = np.where(self.size >= 2 * q, self.size * percent // 100, 0)
        width = np.minimum(self.size, q)
        self.bound = np.maximum(1, self.size - width + 1 - self.budget * q)
        first = np.searchsorted(self.owner, np.arange(len(places)))  # all parts of an item have one size, budget and bound
        self.whole, self.slack, self.least = whole, self.budget[first], self.bound[first]
        rows = [(np.full(max(0, len(t) - q + 1), i), np.arange(max(0, len(t) - q + 1)), grams(t, q)) for i, t in enumerate(self.texts)]
        # parts first + [from, to) of an item hold the q-gram at a place of it
        spans = [(np.searchsorted(a, r[1] - min(part, len(t)) + q), np.searchsorted(a, r[1], "right")) for a, r, t in zip(places, rows, self.texts)]
        codes = np.concatenate([r[2] for r in rows]) if rows else np.empty(0, "u8")
        order = np.argsort(codes, kind="stable")
        self.codes = codes[order]
        self.of = np.concatenate([r[0] for r in rows])[order] if rows else np.empty(0, "i8")
        self.at = np.concatenate([r[1] for r in rows])[order] if rows else np.empty(0, "i8")
        self.lo = np.concatenate([f + x for f, (x, _) in zip(first, spans)])[order] if rows else np.empty(0, "i8")
        self.hi = np.concatenate([f + x for f, (_, x) in zip(first, spans)])[order] if rows else np.empty(0, "i8")
        self.first, heads = np.unique(self.codes, return_index=True)
        self.bounds = np.append(heads, len(self.codes))
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[sieve_at(self.codes)] = True
        self.tiny = np.flatnonzero(self.size < q).tolist()

    def part(self, i: int) -> bytes:
        return self.texts[self.owner[i]][self.place[i] : self.place[i] + self.size[i]]

    @property
    def parts(self) -> list[bytes]:
        return [self.part(i) for i in range(len(self.size))]

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, part, edits, start, end) of the parts that occur in normalised texts."""
        for i in self.tiny:
            for d, text in enumerate(texts):
                if (at := text.find(self.part(i))) >= 0:
                    yield d, i, 0, at, at + int(self.size[i])
        if len(self.codes) == 0:
            return
        data = b"\n".join(texts) + b"\n"  # a byte that normalised texts never hold, so no q-gram spans two
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        codes = grams(data, self.q)
        spot = np.flatnonzero(self.sieve[sieve_at(codes)])
        lo = np.searchsorted(self.first, codes[spot])
        real = self.first[np.minimum(lo, len(self.first) - 1)] == codes[spot]
        spot, lo = spot[real], lo[real]
        pick, n = ranges(self.bounds[lo], self.bounds[lo + 1])
        place = np.repeat(spot, n)
        doc = np.searchsorted(starts, place, "right") - 1
        place, item = place - starts[doc], self.of[pick]
        pairs, pair = np.unique(doc * len(self.texts) + item, return_inverse=True)
        keep = (np.bincount(pair, minlength=len(pairs)) >= self.least[pairs % len(self.texts)])[pair]
        pair, doc, place, item, pick = pair[keep], doc[keep], place[keep], item[keep], pick[keep]
        keep = np.zeros(len(pick), bool)
        for half in (0, 1):
            band = (place - self.at[pick] + self.whole[item] + half * (self.slack[item] + 1)) // (2 * self.slack[item] + 1)
            cells, back, count = np.unique((pair << 32) + band, return_inverse=True, return_counts=True)
            keep |= count[back] >= self.least[item]
        doc, place, pick = doc[keep], place[keep], pick[keep]
        part, n = ranges(self.lo[pick], self.hi[pick])
        doc, place, own = np.repeat(doc, n), np.repeat(place, n), np.repeat(self.at[pick], n) - self.place[part]
        pairs, pair = np.unique(doc * len(self.size) + part, return_inverse=True)
        docs, parts = np.divmod(pairs, len(self.size))
        width = 2 * self.budget[part] + 1
        regions: dict[int, set[tuple[int, int]]] = {}
        for half in (0, 1):  # two tilings of the diagonals, half a band apart
            band = (place - own + self.size[part] + half * (self.budget[part] + 1)) // width
            key = (pair << 32) + band
            cells, back, count = np.unique(key, return_inverse=True, return_counts=True)
            full = np.flatnonzero((count >= self.bound[parts[cells >> 32]])[back])
            # a q-gram of the part counts once in a band, however often the text repeats it
            once = np.unique(np.stack([back[full], own[full]]), axis=1)[0]
            cell, count = np.unique(once, return_counts=True)
            for c, n in zip(cells[cell].tolist(), count.tolist()):
                i, d = int(parts[c >> 32]), int(docs[c >> 32])
                if n >= self.bound[i]:
                    k, size = int(self.budget[i]), int(self.size[i])
                    first = (c & 0xFFFFFFFF) * (2 * k + 1) - half * (k + 1) - size
                    regions.setdefault(c >> 32, set()).add((max(0, first - k), max(0, min(len(texts[d]), first + 3 * k + 1 + size))))
        for c, spans in regions.items():
            d, i = int(docs[c]), int(parts[c])
            if best := self._best(i, texts[d], spans):
                yield d, i, *best

    def _best(self, i: int, text: bytes, spans: set[tuple[int, int]]) -> tuple[int, int, int] | None:
        """The occurrence of part i with fewest edits in the regions given."""
        best, own = None, self.part(i)
        for a, b in sorted(spans):
            at = text.find(own, a, b)
            if at >= 0:
                return 0, at, at + len(own)
            found = align(own, text[a:b], int(self.budget[i]))
            if found and (best is None or found[0] < best[0]):
                best = found[0], a + found[1], a + found[2]
        return best


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The benchmark in blocks of bounded size; the whole of it is never held."""
    block, held = [], 0
    for r in items.select(item_id, text).orderBy(item_id, text).toLocalIterator():
        own = normal(r[text])
        if block and held + len(own) > most:
            yield block
            block, held = [], 0
        block.append((r[item_id], own))
        held += len(own)
    yield block


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    q: int = 8,
    percent: int = 10,
    part: int = 100,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, parts, edits, start, end.

    parts: parts of the item found; edits: fewest edits of any; start, end: bytes of that one in the normalised text.
    """
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    names = ["doc_id", "row", "item_id", "part", "edits", "start", "end"]
    out = None
    for block in _blocks(benchmark, item_id, item_text, block_chars):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, q, percent, part))

        def scan(frames: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            own = index.value
            for frame in frames:
                found = []
                texts, ids, row = frame["text"].tolist(), frame["doc_id"].tolist(), frame["row"].tolist()
                for a, b in slices(texts):
                    for d, i, *rest in own.matches([normal(t) for t in texts[a:b]]):
                        found.append((None if pd.isna(ids[a + d]) else ids[a + d], row[a + d], own.item[i], i, *rest))
                out = pd.DataFrame(found, columns=names)
                for c, k in (("doc_id", kind), ("item_id", item_kind)):
                    out[c] = out[c].astype("Int64") if k in ("int", "bigint") else out[c]
                yield out

        hits = rows.mapInPandas(scan, f"doc_id {kind}, row long, item_id {item_kind}, part int, edits int, start int, end int")
        best = hits.groupBy("doc_id", "row", "item_id").agg(F.count(F.lit(1)).alias("parts"), F.min(F.struct("edits", "start", "end")).alias("best"))
        best = best.select("doc_id", "item_id", "parts", "best.edits", "best.start", "best.end")
        out = best if out is None else out.unionByName(best)
    return out


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = 8, percent: int = 10, part: int = 100, block_chars: int = 4_000_000
) -> DataFrame:
    """The documents in which no benchmark item was found; columns as given.

    Each row is judged where it is read, so ids may be null or repeat, and nothing is shuffled.
    """
    at = docs.columns.index(text)
    for block in _blocks(benchmark, item_id, item_text, block_chars):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, q, percent, part))

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).to_pylist()
                keep = np.ones(len(texts), bool)
                for a, b in slices(texts):
                    keep[[a + found[0] for found in index.value.matches([normal(t) for t in texts[a:b]])]] = False
                yield batch.filter(pa.array(keep))
            give_back()

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
