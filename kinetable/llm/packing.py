"""Best-fit-decreasing packing of token pieces into windows of a fixed length.

A document's ids plus an end id are cut into full windows from the start; the rest, shorter than a window, is
one piece.  Full windows are sequences by themselves.  Rests are dealt by a hash of the document into groups of about
``group_rows`` pieces; a group is packed longest piece first, and a segment tree indexed by remaining capacity finds
the tightest open window.  Each id lies in exactly one piece, and no piece crosses a window.

Tokenising happens in one pass that returns piece rows (place, length, checksum and, if asked, the ids), so packing moves
only these narrow rows.  Group sizes depend on row counts alone: a hot source or very long documents do not concentrate.

Defined cases: null and empty texts are the single end id.  Equal rows and rows with equal or null doc_id are separate
documents.  An empty table gives an empty result.  Columns other than the two named are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch
from .tokens import encoder, give_back, slices

ROWS, CHARS = 512, 1 << 19
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, piece long"


class OpenWindows:
    """Segment tree over remaining capacities 0..size; a leaf counts the open windows with that capacity."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, step: int) -> None:
        at = self.base + capacity
        while at:
            self.count[at] += step
            at >>= 1

    def put(self, window: int, capacity: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least capacity of at least ``need``, removed from the tree; None if there is none."""
        at, count = self.base + need, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.base
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length, packed longest first."""
    window, offset = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    tree, used = OpenWindows(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if (found := tree.take(need)) is None:
            found = used, size
            used += 1
        window[i], capacity = found
        offset[i] = size - capacity
        if capacity > need:
            tree.put(found[0], capacity - need)
    return window, offset


def cut(ids: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for start in range(0, len(ids), size):
        yield start, ids[start : start + size]


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, doc_id: str, text: str, with_ids: bool) -> DataFrame:
    """One row per piece of a document, before packing."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = PIECES.format(id=kind) + (", ids binary" if with_ids else "")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, key = encoder(tokenizer), TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # few texts at a time, whatever a batch holds
                part = batch.slice(at, ROWS)
                texts, owners = part.column(1).to_pylist(), part.column(0)
                for a, b in slices(texts, CHARS):
                    ids_all, bounds = enc.encode(texts[a:b])
                    rows = []
                    for i, lo, hi in zip(range(a, b), bounds[:-1], bounds[1:]):
                        ids = np.append(ids_all[lo:hi], np.uint32(end_id)).astype("<u4")
                        for start, own in cut(ids, size):
                            raw = own.tobytes()
                            rows.append((i, start, len(own), zlib.crc32(raw), len(ids), key, *([raw] if with_ids else [])))
                            key += 1
                    owner, *rest = zip(*rows)
                    kinds = ["int64"] * 5 + (["binary"] if with_ids else [])
                    yield pa.RecordBatch.from_arrays([owners.take(pa.array(owner)), *[pa.array(c, k) for c, k in zip(rest, kinds)]], names)
        enc.forget()
        give_back()

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    group_rows: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """Piece rows with sequence_id and offset; ``with_ids`` adds the ids themselves as little-endian unsigned 32-bit."""
    scratch = Scratch(docs.sparkSession, "packing")
    cuts = scratch.keep(pieces(docs, tokenizer, size, end_id, doc_id, text, with_ids), "pieces")
    # a full window is its own sequence, numbered by its piece; sequences of packed rests have negative numbers
    full = cuts.where(F.col("length") == size).withColumn("sequence_id", F.col("piece")).withColumn("offset", F.lit(0).cast("long"))
    rest = cuts.where(F.col("length") < size)
    groups = max(1, math.ceil(rest.count() / group_rows))
    rest = rest.withColumn("grp", F.pmod(F.xxhash64("piece"), F.lit(groups)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "piece"], ascending=[False, True], kind="stable")
        window, offset = best_fit(frame["length"].to_numpy("i8"), size)
        return frame.drop(columns="grp").assign(sequence_id=-1 - (frame["grp"].to_numpy("i8") * group_span + window), offset=offset)

    # a group's windows are at most its pieces; eight times the mean size is far beyond what a hash deals out
    group_span = 8 * group_rows
    packed = rest.groupBy("grp").applyInPandas(run, full.schema)
    return full.unionByName(packed).drop("piece")
