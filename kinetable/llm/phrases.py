"""Substring deduplication: recurring passages are confirmed, compiled into Aho-Corasick automata, and removed.

A window is ``length`` consecutive words.  Windows that recur anywhere in the corpus mark their words for removal.

1. Anchors.  Every window names the smallest hash among its runs of ``anchor`` words, so equal windows name equal
   anchors, and only a few positions of a text are named.  Anchors named at one position only are settled: no window with
   such an anchor recurs.  A bit set of bounded size holds the others.
2. Confirmation.  Windows whose anchor may recur are counted by hash over the corpus; count two or more confirms.
3. Shards.  Documents are dealt to shards of about ``shard_bytes`` of text, and the hash of each confirmed window goes to
   the shards it occurs in.  A shard joins one occurrence of each of its windows to passages, cuts these into pieces of half a
   window and compiles an automaton over word numbers.  The shard's documents that hold a confirmed window stream
   through it; at a hit the window's occurrence in a passage gives the diagonal, the words are compared along it, and
   stretches of a whole window or more are removed.

An automaton is never larger than its shard's text, whatever the corpus holds, and total work is proportional to it.
A passage in a third of all documents is combined before the counting shuffle; its rows are then spread by shard.

Defined cases: null text is the empty text.  Repeated rows are documents of their own, so their windows recur.  Texts
shorter than a window keep all words.  Null doc_id is allowed.  An empty table gives an empty result.  Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import Words, mix, runs, utf8
from .shared import Scratch
from .tables import merged
from .tokens import slices


def named_anchors(words: Words, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside a text, and the anchor (position, hash) that each names: the leftmost smallest."""
    start = window_starts(words, length)
    if not len(start):
        return start, start, np.empty(0, "u8")
    grams = runs(words.hash, anchor)
    span = length - anchor + 1
    at = np.empty(len(start), "i8")
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    for a in range(0, len(start), 1 << 15):
        at[a : a + (1 << 15)] = views[start[a : a + (1 << 15)]].argmin(1)
    at += start
    return start, at, grams[at]


def locate(ids: np.ndarray, first: np.ndarray, passages: list[tuple[int, int]], length: int, twin: np.ndarray) -> np.ndarray:
    """Mask of the words of all texts that lie in an occurrence of a window of a passage.

    ``ids``: word numbers of all texts one after the other; ``first``: bounds of texts; ``passages``: (start, stop) in ids,
    ascending; ``twin``: for each place where a confirmed window should start, its place in a passage, else -1.

    Every such window holds a whole piece.  A hit of a piece looks at the windows around it that are not settled: the
    window's twin gives the diagonal, and the words are compared along it as far as the passage goes.
    """
    removed = np.zeros(len(ids), bool)
    piece = (length + 1) // 2
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for a, b in passages:
        for p in range(a, b - piece + 1, piece):
            automaton.add_word(tuple(ids[p : p + piece].tolist()), True)
    if not passages:
        return removed
    automaton.make_automaton()
    starts = [a for a, _ in passages]
    pending = twin >= 0
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo < length or not pending[lo:hi].any():
            continue
        for end, _ in automaton.iter(tuple(ids[lo:hi].tolist())):
            q = lo + end - piece + 1
            begin = max(lo, q + piece - length)
            while (ahead := pending[begin : q + 1]).any():
                s = begin + int(ahead.argmax())
                p = int(twin[s])
                a, b = passages[bisect_right(starts, p) - 1]
                left = _same(ids[max(a, p - (s - lo)) : p][::-1], ids[max(lo, s - (p - a)) : s][::-1])
                reach = min(b - p, hi - s)
                right = _same(ids[p : p + reach], ids[s : s + reach])
                if right >= length:
                    removed[s - left : s + right] = True
                    pending[s - left : s + right - length + 1] = False
                pending[s] = False
    return removed


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common start."""
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else len(x)


def kept_texts(words: Words, removed: np.ndarray) -> list[bytes]:
    """The kept words of each text joined by one space."""
    data = words.data.copy()
    data[words.end] = 32
    keep = ~removed
    change = np.zeros(len(data) + 1, "i1")
    change[words.start[keep]] = 1
    change[words.end[keep] + 1] -= 1
    out = data[np.cumsum(change[:-1], dtype="i1").astype(bool)].tobytes()
    sizes = np.concatenate(([0], np.cumsum((words.end - words.start + 1) * keep)))[words.first]
    return [out[a : max(a, b - 1)] for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist())]


def window_starts(words: Words, length: int) -> np.ndarray:
    """Starts of all windows that lie inside a text."""
    if len(words.hash) < length:
        return np.empty(0, "i8")
    return np.flatnonzero(words.doc[length - 1 :] == words.doc[: len(words.doc) - length + 1])


def clean_shard(texts: list[str | None], confirmed: np.ndarray, length: int) -> tuple[Words, np.ndarray]:
    """Words of all texts of one shard, and which of them lie in a confirmed window (given by hash)."""
    words = Words(utf8(texts))
    start = window_starts(words, length)
    if not len(start) or not len(confirmed):
        return words, np.zeros(len(words.hash), bool)
    hashes = runs(words.hash, length)[start]
    known = np.isin(hashes, confirmed)
    start, hashes = start[known], hashes[known]
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)  # one occurrence of each window
    twin = np.full(len(words.hash), -1)
    twin[start] = start[one][which]
    _, ids = np.unique(words.hash, return_inverse=True)
    return words, locate(ids, words.first, _by_text(np.sort(start[one]), words, length), length, twin)


def _by_text(start: np.ndarray, words: Words, length: int) -> list[tuple[int, int]]:
    """Runs of neighbouring window starts in one text, as (first word, end)."""
    if not len(start):
        return []
    doc = words.doc[start]
    cut = np.flatnonzero((np.diff(start) > 1) | (np.diff(doc) != 0))
    begin, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(start) - 1]))
    return list(zip(start[begin].tolist(), (start[last] + length).tolist()))


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = 35,
    anchor: int = 8,
    shard_bytes: int = 4 << 20,
    with_text: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text."""
    scratch = Scratch(docs.sparkSession, "phrases")
    context = docs.sparkSession.sparkContext
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                _, at, found = named_anchors(Words(utf8(texts[a:b])), length, anchor)
                _, one = np.unique(at, return_index=True)
                values, n = np.unique(found[one], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view("i8")), pa.array(n, "int64")], ["a", "n"])

    recurring = rows.select("text").mapInArrow(anchors, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a")
    recurring = scratch.keep(recurring, "anchors")
    bits = 1 << max(16, min(29, int(16 * max(1, recurring.count())).bit_length()))

    def spots(values: np.ndarray) -> np.ndarray:
        return np.stack([mix(values + np.uint64(j)) & np.uint64(bits - 1) for j in (1, 2)]).astype("i8")

    def fill(batches: Iterator[pa.RecordBatch], cells: np.ndarray) -> None:
        for batch in batches:
            at = spots(batch.column(0).to_numpy().view("u8")).ravel()
            np.bitwise_or.at(cells, at >> 3, np.left_shift(1, at & 7).astype("u1"))

    maybe = context.broadcast(merged(recurring, fill, bits // 8, "u1", np.bitwise_or))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, shard = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            found, owner = [np.empty(0, "u8")], [np.empty(0, "i4")]
            for a, b in slices(texts):
                words = Words(utf8(texts[a:b]))
                start, _, named = named_anchors(words, length, anchor)
                at = spots(named)
                start = start[((maybe.value[at >> 3] >> (at & 7).astype("u1")) & 1).all(0)]
                found.append(runs(words.hash, length)[start])
                owner.append(shard[a:b][words.doc[start]])
            w, of = np.concatenate(found), np.concatenate(owner)
            order = np.lexsort((of, w))
            w, of = w[order], of[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (of[1:] != of[:-1])
            head = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(w[head].view("i8")), pa.array(of[head]), pa.array(np.diff(np.append(head, len(w))))], ["w", "shard", "n"])

    # a batch has combined its copies, so a window has at most a row for each shard and batch, however hot it is
    candidates = rows.select("text", "shard").mapInArrow(windows, "w long, shard int, n long")
    confirmed = candidates.withColumn("n", F.sum("n").over(Window.partitionBy("w"))).where("n > 1").select("shard", "w")

    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("text").to_pylist()
        words, removed = clean_shard(texts, right.column("w").to_numpy().view("u8"), length)
        kept = kept_texts(words, removed)
        gone = np.concatenate(([0], np.cumsum(removed)))[words.first]
        columns = {
            "doc_id": left.column("doc_id"),
            "n_words": pa.array(np.diff(words.first)),
            "n_removed": pa.array(np.diff(gone)),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], "string"),
        }
        return pa.table(columns | ({"kept_text": pa.array([t.decode() for t in kept], "string")} if with_text else {}))

    return rows.groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInArrow(clean, schema)
