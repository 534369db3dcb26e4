"""Language and quality: held-out accuracy, awkward rows, no labels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.llm.language import add_language, keep_known, predict_language
from kinetable.llm.quality import Network, score_quality

from .conftest import prose

SYLLABLES = {"en": ["th", "ing", "er", "and", "wh"], "de": ["sch", "ung", "ein", "tz", "ach"], "fr": ["eau", "ette", "oui", "é", "que"], "es": ["ción", "ado", "ñ", "ll", "os"]}


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice(SYLLABLES[c]) for _ in range(rng.randrange(1, 4))) for _ in range(40)), c) for i, c in enumerate(rng.choice(list(SYLLABLES)) for _ in range(400))]
    return spark.createDataFrame([*rows, (1000, None, "en"), (1001, "", None), (1002, "12 !!", "fr"), (None, "thing and where", None)], "doc_id long, text string, lang string")


def test_language_of_held_out_rows(tongues):
    got = predict_language(tongues).join(tongues, "doc_id").toPandas()
    sure = got[got.held_out & (got.doc_id < 1000)]
    assert (sure.lang == sure.lang_pred).mean() > 0.98 and sure.score.between(0, 1).all() and sure.score.mean() > 0.6
    assert set(got[got.doc_id >= 1000].lang_pred) == {"und"}


def test_language_filter_and_edge_tables(tongues, awkward, nothing):
    kept = keep_known(tongues)
    assert kept.columns == tongues.columns and kept.count() == 401
    assert {r.lang_pred for r in predict_language(awkward).collect()} == {"en", "und"}
    assert predict_language(nothing).count() == 0 and {r.lang_pred for r in predict_language(tongues.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    with pytest.raises(ValueError):
        add_language(awkward)  # it has a column score
    assert set(keep_known(awkward).columns) == set(awkward.columns)


def test_quality_of_held_out_rows(spark, awkward, nothing):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = prose(rng, rng.randrange(20, 80))
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split())))
        labels.append((i, int(good), 1))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, text int")
    got = score_quality(docs, marks, buckets=1 << 10).toPandas()
    assert len(got) == 403 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    truth = dict((i, q) for i, q, _ in labels)
    held = got[got.held_out & got.doc_id.notna() & (got.doc_id < 400)]
    assert np.mean([truth[int(i)] == p for i, p in zip(held.doc_id, held.predicted)]) > 0.97
    assert score_quality(nothing, marks, buckets=1 << 10).count() == 0
    assert {r.score for r in score_quality(awkward, marks.limit(0), buckets=1 << 10).collect()} == {0.5}


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    p = 1 / (1 + np.exp(-1.5 * x[:, 0]))
    y = (rng.random(3000) < p).astype(float)
    got = Network(x[:2000], y[:2000])(x[2000:])
    assert abs(got.mean() - y[2000:].mean()) < 0.05 and np.abs(got - p[2000:]).mean() < 0.12
