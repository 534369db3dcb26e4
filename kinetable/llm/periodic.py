"""Periodic runs of words, found on a Re-Pair grammar of each text.

A run is a stretch of at least ``least`` words and two periods in which words one (smallest) period apart are equal and
that no neighbouring word extends.

1. A run of period q and length L repeats its first L - q >= ``least`` / 2 words, and those two copies cover it.  So every word
   of a run lies in a word sequence of half the least length that occurs twice in the text; other words are cut away.
2. Re-Pair: the pair of symbols that occurs most often is replaced by a new symbol everywhere, until no pair occurs
   twice.  Ties go to the pair seen first, which keeps the rules of a repeated passage balanced.  What is left is halved like a
   balanced tree of rules that occur once.
3. Every run lies in exactly one smallest node of the derivation that holds it, and crosses the boundary between the node's two
   sides.  For each rule the runs that cross its boundary are computed once, from longest common extensions (Z arrays), for all
   periods together.
4. They are moved to all places where the rule was applied.  Stretches cut off by the end of a node lie inside
   the run found at a larger node with the same period, so only stretches that no other of their period holds stay.

One pass over the rows without a shuffle; texts are read to word ids in slices, and equal words are equal bytes.

Defined cases: null, empty and blank texts have no words, no run and an empty collapsed text.  Repeated rows each get their row.  A
null id is passed on (and to ``repeat``).  An empty table gives an empty result.  Columns other than the two named are not
read and may have any name.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix

BLANK = re.compile(rb"[\x20\x09-\x0d]")
SEPARATOR = -1


def word_ids(text: bytes, most: int = 1 << 20) -> tuple[np.ndarray, list[bytes]]:
    """Ids of the words in order, and the word of each id."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        cut = BLANK.search(text, at + most) if len(text) - at > most else None
        stop = cut.start() if cut else len(text)
        parts.append(np.array([known.setdefault(w, len(known)) for w in text[at:stop].split()], "i4"))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, "i4"), list(known)


def recurring(ids: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a sequence of k words that occurs at least twice (a clash of hashes only adds some)."""
    n = len(ids) - k + 1
    covered = np.zeros(len(ids) + 1, "i4")
    if n > 1:
        spread = mix(ids.astype("u8") + np.uint64(1))
        key = np.zeros(n, "u8")
        for j in range(k):
            key = key * np.uint64(0x9E3779B97F4A7C15) + spread[j : j + n]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(covered, np.flatnonzero(twice), 1)
        np.add.at(covered, np.flatnonzero(twice) + k, -1)
    return np.cumsum(covered)[:-1] > 0


def re_pair(symbols: np.ndarray) -> tuple[list[tuple[list[int], int, int]], list[tuple[int, int]]]:
    """Rules as (places, length of the left side, length), and the symbols left at the end as (place, length).

    Places count in ``symbols``; separators join no pair and are not returned.
    """
    n = len(symbols)
    sym, size = symbols.tolist(), {}
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue: list[tuple[int, int, tuple[int, int]]] = []
    found: dict[tuple[int, int], list[int]] = {}
    if n > 1:
        pair = (symbols[:-1].astype("i8") << 32) | symbols[1:].astype("i8")
        pair[(symbols[:-1] == SEPARATOR) | (symbols[1:] == SEPARATOR)] = -1
        order = np.argsort(pair, kind="stable")
        cuts = np.flatnonzero(np.diff(pair[order], prepend=-2)).tolist() + [n - 1]
        groups = [order[a:b].tolist() for a, b in zip(cuts, cuts[1:]) if b - a > 1 and pair[order[a]] >= 0]
        for places in sorted(groups, key=lambda g: g[0]):
            key = sym[places[0]], sym[places[0] + 1]
            found[key] = places
            queue.append((-len(places), len(queue), key))
    heapq.heapify(queue)
    serial, fresh, rules = len(queue), (int(symbols.max()) if n else 0) + 1, []
    while queue:
        count, born, key = heapq.heappop(queue)
        a, b = key
        places, taken = [], -1
        for i in found.pop(key):  # what is still there, without overlaps
            if i != taken and sym[i] == a and after[i] < n and sym[after[i]] == b:
                places.append(i)
                taken = after[i]
        if len(places) < 2:
            continue
        if queue and -len(places) > queue[0][0]:
            found[key] = places
            heapq.heappush(queue, (-len(places), born, key))
            continue
        left = size.get(a, 1)
        size[fresh] = left + size.get(b, 1)
        for i in places:
            j = after[i]
            sym[i], sym[j], k = fresh, None, after[j]
            after[i] = k
            if k < n:
                before[k] = i
        new: dict[tuple[int, int], list[int]] = {}
        for i in places:
            h, k = before[i], after[i]
            if h >= 0 and sym[h] != fresh and sym[h] != SEPARATOR:
                new.setdefault((sym[h], fresh), []).append(h)
            if k < n and sym[k] != SEPARATOR:
                new.setdefault((fresh, sym[k]), []).append(i)
        for pair_key, where in new.items():
            if len(where) > 1:
                found[pair_key] = where
                heapq.heappush(queue, (-len(where), serial, pair_key))
                serial += 1
        rules.append((places, left, size[fresh]))
        fresh += 1
    top, i = [], 0
    while i < n:
        if sym[i] != SEPARATOR:
            top.append((i, size.get(sym[i], 1)))
        i = after[i]
    return rules, top


def z_array(s: list[int]) -> list[int]:
    """For each place, how far the text from there agrees with its beginning."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def crossing(t: list[int], b: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period): stretches of ``t`` around the boundary before word b that cannot be extended in ``t``."""
    u, v = t[:b], t[b:]
    if t[b - 1] not in v and v[0] not in u:
        return []
    best: dict[tuple[int, int], int] = {}

    def add(start: int, end: int, q: int) -> None:
        if start < b < end and end - start >= max(least, 2 * q) and q < best.get((start, end), q + 1):
            best[start, end] = q

    if t[b - 1] in v:  # a whole period on the right side
        ahead, back = z_array(v), z_array(u[::-1] + [SEPARATOR] + t[::-1])
        for q in range(1, len(v) + 1):
            add(b - back[len(u) + 1 + len(v) - q], b + (ahead[q] if q < len(v) else 0) + q, q)
    if v[0] in u:  # a whole period on the left side
        ahead, back = z_array(v + [SEPARATOR] + t), z_array(u[::-1])
        for q in range(1, len(u) + 1):
            add(b - q - (back[q] if q < len(u) else 0), b + ahead[len(v) + 1 + b - q], q)
    return [(s, e, q) for (s, e), q in best.items()]


def find_runs(ids: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    covered = recurring(ids, (least + 1) // 2)
    edge = np.diff(covered.astype("i1"), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return np.zeros((0, 3), "i8")
    where = np.concatenate([np.append(np.arange(a, b), b) for a, b in zip(starts, ends)])
    symbols = np.concatenate([np.append(ids[a:b], SEPARATOR) for a, b in zip(starts, ends)]).astype("i8")
    rules, top = re_pair(symbols)
    words = symbols.tolist()
    found: list[np.ndarray] = []

    def node(places: list[int], left: int, size: int) -> None:
        at = places[0]
        runs = crossing(words[at : at + size], left, least) if size >= least else []
        if runs:
            moved = where[np.array(places)][:, None, None] + np.array(runs)[None, :, :] * np.array([1, 1, 0])
            moved[:, :, 2] = np.array(runs)[None, :, 2]
            found.append(moved.reshape(-1, 3))

    for rule in rules:
        node(*rule)
    last = [i for i, (at, size) in enumerate(top) if i + 1 == len(top) or top[i + 1][0] != at + size]
    first = 0
    for stop in last:  # what is left of each stretch, halved by number of symbols
        spans = [(first, stop + 1)]
        while spans:
            lo, hi = spans.pop()
            if hi - lo > 1:
                mid = (lo + hi) // 2
                node([top[lo][0]], top[mid][0] - top[lo][0], top[hi - 1][0] + top[hi - 1][1] - top[lo][0])
                spans += [(lo, mid), (mid, hi)]
        first = stop + 1
    if not found:
        return np.zeros((0, 3), "i8")
    start, end, q = np.concatenate(found).T
    order = np.lexsort((-end, start, q))
    start, end, q = start[order], end[order], q[order]
    reach = np.maximum.accumulate(end + q * (len(ids) + 1))
    whole = np.ones(len(q), bool)
    whole[1:] = (end + q * (len(ids) + 1))[1:] > reach[:-1]
    out = np.stack([start, end - start, q], 1)[whole]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapse(ids: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Ids without the words that a run holds after its first period."""
    turn = np.zeros(len(ids) + 1, "i4")
    np.add.at(turn, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turn, runs[:, 0] + runs[:, 1], -1)
    return ids[np.cumsum(turn)[:-1] == 0]


def periodic_runs(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = 12, repeat: Callable[[object, int], tuple[int, int] | None] | None = None, most: int = 1 << 22
) -> DataFrame:
    """(id_column, runs array<struct<start, length, period>>, collapsed): runs by start, then period, and the text without repeats.

    repeat: given a row's id and number of words, (a, p) lets the words from number a on repeat the p words from
    there, for texts with known runs; None leaves the text as it is.  most: bytes of a batch of results.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    kind = documents.schema[id_column].dataType.simpleString()
    read = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, texts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate([np.zeros((0, 3), "i8"), *rows])
            bounds = np.cumsum([0, *map(len, rows)]).astype("i4")
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["start", "length", "period"])
            out = pa.RecordBatch.from_arrays([pa.array(keys, source.type), pa.ListArray.from_arrays(pa.array(bounds), items), pa.array(texts, "binary")], ["id", "runs", "collapsed"])
            for held_list in (keys, rows, texts):
                held_list.clear()
            return out

        for batch in batches:
            source = batch.column("id")
            for key, body in zip(source, batch.column("text")):
                ids, names = word_ids(body.as_py())
                place = repeat(key.as_py(), len(ids)) if repeat else None
                if place is not None:
                    a, p = place
                    ids = np.concatenate([ids[:a], ids[a + np.arange(len(ids) - a) % p]])
                runs = find_runs(ids, least)
                kept = collapse(ids, runs) if len(runs) else ids
                keys.append(key.as_py())
                rows.append(runs)
                texts.append(b" ".join([names[i] for i in kept.tolist()]))
                held += len(texts[-1]) + 24 * len(runs) + 64
                if held > most:
                    yield flush()
                    held = 0
            if keys:
                yield flush()
                held = 0

    found = read.mapInArrow(run, f"id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.select(F.col("id").alias(id_column), "runs", F.col("collapsed").cast("string").alias("collapsed"))
