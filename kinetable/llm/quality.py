"""Document quality from random-indexing word vectors and a small network.

Every word has a fixed sparse index vector from its hash.  A word's vector is the sum of the index vectors of its
neighbours over ALL documents; words share a table of ``buckets`` rows by hash, so the table has a fixed size however
large the vocabulary.  Tasks return partial tables in slices, which are summed in two levels.  A document is pooled
(mean and spread of its words' unit vectors), and a network with one hidden layer, trained in numpy on a
bounded sample of labelled rows, gives a probability; a temperature fitted on rows kept out of training calibrates it.

Defined cases: null text is the empty text, whose pooled vector is zero; it gets a score like any other.  Label rows
with null label or null doc_id are not learned from; repeated label rows count as often as they occur.  With no usable
labels, or one class only, every score is the share of label 1 (0.5 without any).  Labels and documents may have any
other columns.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, mix, utf8
from .tokens import slices

SLICES = 64


def index_places(hashes: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a word's index vector is +1 and -1."""
    x = mix(hashes ^ np.uint64(0x51ED270B))
    plus = (x % np.uint64(dim)).astype("i8")
    minus = ((x >> np.uint64(32)) % np.uint64(dim - 1)).astype("i8")
    return plus, (plus + 1 + minus) % dim


def context_sums(texts: list[str | None], buckets: int, dim: int, reach: int) -> np.ndarray:
    """Summed neighbour index vectors by word bucket, over the texts given."""
    words = Words(utf8(texts), marks=True)
    row = (words.hash % np.uint64(buckets)).astype("i8") * dim
    plus, minus = index_places(words.hash, dim)
    at, add, sub = [], [], []
    for step in range(1, reach + 1):
        near = np.flatnonzero(words.doc[step:] == words.doc[:-step])
        at += [row[near], row[near + step]]
        add += [plus[near + step], plus[near]]
        sub += [minus[near + step], minus[near]]
    cells = np.concatenate(at) if at else np.empty(0, "i8")
    n = buckets * dim
    return np.bincount(cells + np.concatenate(add), minlength=n) - np.bincount(cells + np.concatenate(sub), minlength=n)


def word_table(docs: DataFrame, buckets: int, dim: int, reach: int) -> np.ndarray:
    """Unit word vectors, buckets x dim, from all documents."""
    step = buckets // SLICES * dim

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros(buckets * dim, "i8")
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in slices(texts):
                total += context_sums(texts[a:b], buckets, dim, reach)
        parts = [(i, p) for i, p in enumerate(np.split(total, SLICES)) if p.any()]
        task = TaskContext.get().partitionId()
        yield pd.DataFrame({"slice": [i for i, _ in parts], "task": task, "sums": [p.astype("<i8").tobytes() for _, p in parts]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(step, "i8")
        for raw in frame["sums"]:
            sums += np.frombuffer(raw, "<i8")
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "task": 0, "sums": [sums.tobytes()]})

    schema = "slice int, task int, sums binary"
    parts = docs.select("text").mapInPandas(partial, schema)
    merged = parts.groupBy("slice", F.pmod("task", F.lit(64)).alias("lane")).applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
    table = np.zeros((SLICES, step), "f8")
    for r in merged.toLocalIterator():  # the table has a fixed size
        table[r["slice"]] = np.frombuffer(r["sums"], "<i8")
    table = table.reshape(buckets, dim)
    used = np.abs(table).sum(1) > 0
    if used.any():
        table[used] -= table[used].sum(0) / max(1.0, np.abs(table).sum()) * np.abs(table[used]).sum(1, keepdims=True)
    norm = np.sqrt((table**2).sum(1, keepdims=True))
    return (table / np.maximum(norm, 1e-9)).astype("f4")


def pooled(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and its logarithmic length."""
    words = Words(utf8(texts), marks=True)
    dim = table.shape[1]
    out = np.zeros((len(texts), 2 * dim + 1), "f4")
    n = np.diff(words.first)
    has = np.flatnonzero(n)
    if len(has):
        vectors = table[(words.hash % np.uint64(len(table))).astype("i8")]
        starts = words.first[:-1][has]
        mean = np.add.reduceat(vectors, starts, axis=0, dtype="f4") / n[has, None]
        square = np.add.reduceat(vectors * vectors, starts, axis=0, dtype="f4") / n[has, None]
        out[has, :dim] = mean
        out[has, dim:-1] = np.sqrt(np.maximum(square - mean**2, 0))
        out[has, -1] = np.log1p(n[has])
    return out


class Network:
    """Two layers, standardised input, probabilities at a fitted temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.constant = None
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        order = rng.permutation(len(y))
        held, train = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-6
        x = ((x - self.mean) / self.scale).clip(-8, 8)
        d = x.shape[1]
        w = [rng.normal(0, (1 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        best, self.w = np.inf, w
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
                h = np.tanh(x[batch] @ w[0] + w[1])
                err = (_sigmoid(h @ w[2] + w[3]) - y[batch]) / len(batch)
                back = np.outer(err, w[2]) * (1 - h**2)
                grads = [x[batch].T @ back + 1e-4 * w[0], back.sum(0), h.T @ err + 1e-4 * w[2], err.sum(keepdims=True)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
            if len(held):
                loss = _loss(np.tanh(x[held] @ w[0] + w[1]) @ w[2] + w[3], y[held])
                if loss < best:
                    best, self.w = loss, [p.copy() for p in w]
            else:
                self.w = w
        z = np.tanh(x[held] @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]
        grid = np.exp(np.linspace(np.log(0.25), np.log(4), 65))
        self.temperature = float(grid[np.argmin([_loss(z / k, y[held]) for k in grid])]) if len(held) else 1.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        x = ((x - self.mean) / self.scale).clip(-8, 8)
        return _sigmoid((np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    buckets: int = 1 << 15,
    dim: int = 32,
    reach: int = 2,
    sample: int = 6000,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    ``sample``: about how many labelled rows the network learns from.  The word table covers all documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = word_table(rows, buckets, dim, reach)
    vectors = spark.sparkContext.broadcast(table)

    usable = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("double").alias("label"))
    usable = usable.where("label_id IS NOT NULL AND label IS NOT NULL").where(~F.coalesce(held_out(F.col("label_id")), F.lit(True)))
    share = sample / max(1, usable.count())
    chosen = usable.where(F.pmod(F.xxhash64("label_id", F.lit("quality")), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30))))
    known = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))  # about ``sample`` narrow rows

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            x = [row.tobytes() for a, b in slices(texts) for row in pooled(texts[a:b], vectors.value)]
            yield pd.DataFrame({"label": frame["label"], "x": x, "k": frame["label_id"]})

    got = known.select("label", "text", "label_id").mapInPandas(features, "label double, x binary, k long").toPandas()
    got = got.sort_values(["k", "label"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), "f4").reshape(len(got), 2 * dim + 1).astype("f8")
    network = Network(x, got["label"].to_numpy("f8"))

    kind = docs.schema[doc_id].dataType.simpleString()

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            parts = [network(pooled(texts[a:b], vectors.value).astype("f8")) for a, b in slices(texts)]
            out = frame[["doc_id", "held_out"]].copy()
            out["score"] = np.concatenate(parts) if parts else np.empty(0)
            out["predicted"] = (out["score"] >= 0.5).astype("int32")
            yield out

    marked = rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return marked.mapInPandas(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
