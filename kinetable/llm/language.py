"""Language of whole texts: a family first, then pairwise linear support vector machines inside the family.

Features are relative frequencies of hashed byte pairs and triples of the lower-cased text, other ASCII than letters read as
space.  A softmax model tells families apart; inside a family each pair of languages has a linear support vector
machine (squared hinge), and the language with most votes wins, summed margins breaking ties.  All models are linear
in the frequencies, so a text is scored by looking up and summing table rows: one pass, no shuffle.

The models learn from a sample of about ``per_language`` rows of each language, chosen by a hash of the id; predictions
use the text alone.

Defined cases: null texts and texts without a letter are ``und`` with score 0.  Rows without lang are not learned from.  With
one language only, it is predicted with score 1; with none, everything is ``und``.  Repeated rows are scored each.  An
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kinetable.session import ship_package

from .hashing import utf8
from .quality import held_out
from .shared import free_name
from .tokens import give_back, slices

# Language families by ISO 639-1 code.  A code not named here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_CLEAN = np.full(256, 32, "u4")
_CLEAN[[*range(97, 123)]] = np.arange(97, 123)
_CLEAN[[*range(65, 91)]] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def grams(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of byte pairs and triples (one after the other), starts of each text in them, and counts."""
    raw = [b" " + t + b"  " for t in utf8(texts)]
    b = _CLEAN[np.frombuffer(b"".join(raw), "u1")]
    shift = np.uint32(32 - width.bit_length() + 1)
    pair = b[:-2] | b[1:-1] << np.uint32(8)
    triple = pair | b[2:] << np.uint32(16)
    # spaces in a row say nothing about language
    blank = (pair == 0x2020).astype("i8")
    features = np.stack([(pair + np.uint32(1 << 24)) * np.uint32(2654435761) >> shift, triple * np.uint32(2654435761) >> shift])
    ends = np.cumsum([len(t) for t in raw])
    starts = np.concatenate(([0], ends[:-1]))
    features[:, blank.astype(bool)] = width  # a row of zeros
    seen = np.concatenate((np.zeros(1, "i8"), np.cumsum(1 - blank)))
    stops = np.maximum(ends - 2, starts)
    stops = np.minimum(stops, len(blank))
    return features, starts, np.maximum(seen[stops] - seen[np.minimum(starts, len(blank))], 1)


def frequencies(texts: list[str | None], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), "f4")
    for i, text in enumerate(texts):
        f, _, n = grams([text], width)
        out[i] = np.bincount(f.ravel(), minlength=width + 1)[:width] / n[0]
    return out


class Models:
    """Family and pair models over standardised frequencies, as one table of width + 1 rows."""

    def __init__(self, x: np.ndarray, langs: list[str], width: int):
        self.width = width
        self.langs = sorted(set(langs))
        by_family = defaultdict(list)
        for code in self.langs:
            by_family[FAMILY.get(code, code)].append(code)
        self.families = sorted(by_family)
        self.members = [by_family[f] for f in self.families]
        self.pairs = [p for m in self.members for p in combinations(m, 2)]
        y = np.array(langs)
        scale = 1 / np.sqrt(x.mean(0) + 1e-5) if len(x) else np.ones(width)
        z = (x * scale).astype("f4")
        norm = float(np.sqrt((z**2).sum(1)).mean()) if len(z) else 1.0
        z /= max(norm, 1e-9)
        weights, bias = [], []
        if len(self.families) > 1:
            w, b = softmax(z, np.array([self.families.index(FAMILY.get(c, c)) for c in langs]), len(self.families))
            weights += list(w.T)
            bias += list(b)
        for one, two in self.pairs:
            rows = (y == one) | (y == two)
            w, b = hinge(z[rows], np.where(y[rows] == one, 1.0, -1.0))
            weights.append(w)
            bias.append(b)
        self.bias = np.array(bias)
        table = np.array(weights).T * (scale / max(norm, 1e-9))[:, None] if weights else np.zeros((width, 0))
        self.table = np.concatenate((table, np.zeros((1, table.shape[1])))).astype("f4")

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if not self.langs:
            return np.full(n, "und", object), np.zeros(n)
        out = np.zeros((n, self.table.shape[1]))
        if self.table.shape[1]:
            features, starts, counts = grams(texts, self.width)
            for f in features:
                out += np.add.reduceat(self.table[f], np.minimum(starts, len(f) - 1), axis=0)
            out = out / counts[:, None] + self.bias
        k = len(self.families) if len(self.families) > 1 else 0
        if k:
            e = np.exp(out[:, :k] - out[:, :k].max(1, keepdims=True))
            share = e / e.sum(1, keepdims=True)
        else:
            share = np.ones((n, 1))
        family = share.argmax(1)
        lang, score = np.empty(n, object), share.max(1)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(family == f)
            votes = np.zeros((len(rows), len(members)))
            margins, sure = np.zeros_like(votes), np.zeros_like(votes)
            for j, (one, two) in enumerate(self.pairs):
                if one in members:
                    m = out[rows, k + j]
                    p = 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
                    for code, sign, sides in ((one, 1, p), (two, -1, 1 - p)):
                        at = members.index(code)
                        votes[:, at] += sign * m >= 0 if sign > 0 else sign * m > 0
                        margins[:, at] += sign * m
                        sure[:, at] += sides
            best = (votes * 1e6 + np.clip(margins, -1e5, 1e5)).argmax(1) if len(rows) else np.empty(0, "i8")
            lang[rows] = np.array(members, object)[best]
            if len(members) > 1:
                score[rows] *= sure[np.arange(len(rows)), best] / (len(members) - 1)
        return lang, np.clip(score, 0, 1)


def softmax(z: np.ndarray, y: np.ndarray, classes: int, steps: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    onehot = np.eye(classes)[y] / np.bincount(y, minlength=classes)[y][:, None] / classes  # classes weigh the same
    weight = onehot.sum(1, keepdims=True)

    def slope(w):
        s = z @ w[:-1] + w[-1]
        e = np.exp(s - s.max(1, keepdims=True))
        r = e / e.sum(1, keepdims=True) * weight - onehot
        return np.concatenate((z.T @ r + ridge * w[:-1], r.sum(0, keepdims=True)))

    w = descend(slope, np.zeros((z.shape[1] + 1, classes)), steps, 4.0)
    return w[:-1], w[-1]


def hinge(z: np.ndarray, y: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))

    def slope(w):
        short = np.maximum(0, 1 - y * (z @ w[:-1] + w[-1]))
        r = -2 * weight * y * short
        return np.append(z.T @ r + ridge * w[:-1], r.sum())

    w = descend(slope, np.zeros(z.shape[1] + 1), steps, 0.2)
    return w[:-1], float(w[-1])


def descend(slope, w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Accelerated gradient descent at a fixed rate."""
    ahead, t = w, 1.0
    for _ in range(steps):
        new = ahead - rate * slope(ahead)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def fit(docs: DataFrame, doc_id: str, text: str, lang: str, width: int, per_language: int) -> Models:
    """Models from a sample of the rows that are not held out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    usable = rows.where(F.coalesce(~held_out(F.col("doc_id")), F.lit(False))).where(r"lang IS NOT NULL AND text RLIKE '\\p{L}'")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row a language
    rate = F.lit(0)
    for code, n in sorted(counts.items()):
        rate = F.when(F.col("lang") == code, F.lit(int(min(1.0, per_language / n) * (1 << 30)))).otherwise(rate)
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < rate)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"k": frame["k"], "lang": frame["lang"], "x": [r.astype("f2").tobytes() for r in frequencies(frame["text"].tolist(), width)]})

    got = chosen.select(F.xxhash64("doc_id", "text").alias("k"), "lang", "text").mapInPandas(features, "k long, lang string, x binary").toPandas()
    got = got.sort_values(["k", "lang"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), "f2").reshape(len(got), width).astype("f4")
    return Models(x, got["lang"].tolist(), width)


def add_language(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", out: tuple[str, str] = ("lang_pred", "score"), width: int = 4096, per_language: int = 300
) -> DataFrame:
    """The documents with two more columns, the predicted language and its score; names in ``out`` must be free."""
    if taken := {c.lower() for c in docs.columns} & {c.lower() for c in out}:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    ship_package(docs.sparkSession)
    return _scored(docs, fit(docs, doc_id, text, lang, width, per_language), text, out)


def _scored(docs: DataFrame, fitted: Models, text: str, out: tuple[str, str]) -> DataFrame:
    models = docs.sparkSession.sparkContext.broadcast(fitted)
    columns = docs.columns
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_lettered")
    at = columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            parts = [models.value.predict(texts[a:b]) for a, b in slices(texts)]
            known = batch.column(len(columns)).to_numpy(zero_copy_only=False).astype(bool)
            named = np.where(known, np.concatenate([p for p, _ in parts]) if parts else np.empty(0, object), "und")
            sure = np.where(known, np.concatenate([s for _, s in parts]) if parts else np.empty(0), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(named.tolist(), "string"), pa.array(sure, "float64")], [*columns, *out])
        give_back()

    schema = StructType([*docs.schema.fields, StructField(out[0], StringType()), StructField(out[1], DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in columns], lettered).mapInArrow(score, schema)


def predict_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return add_language(rows, **options).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", width: int = 4096, per_language: int = 300) -> DataFrame:
    """The documents that have a language (not ``und``); columns as given.

    Every text with a letter is given one of the learned languages, so what goes are texts without a letter; the rule is the same
    where no row has a label to learn from.
    """
    ship_package(docs.sparkSession)
    models = fit(docs, doc_id, text, lang, width, per_language)
    if not models.langs:
        return docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    name, sure = free_name(docs, "_lang"), free_name(docs, "_sure")
    return _scored(docs, models, text, (name, sure)).where(F.col(name) != "und").select(*docs.columns)
