"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

WORDS = "the of and to in that with from river stone mountain paper engine garden window silver copper winter summer yellow".split()
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("score", StringType()), StructField("n", LongType()), StructField("key", StringType())])


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randrange(300))]) for _ in range(n))


def awkward_rows():
    rng = random.Random(5)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    words = base.split()
    near = [" ".join(words[:i] + [f"edit{i}"] + words[i + 1 :]) for i in (3, 50, 70, 110)]
    texts = [
        None, "", "  \t\n ", "one", "two words", "Now three words", base, base.upper(), base, *near,
        prose(rng, 40) + " " + passage + " " + prose(rng, 30), prose(rng, 10) + "\n" + passage, prose(rng, 4000), "same " * 90, "a b " * 60,
        "Élan vital ÉLAN", "élan vital Élan", "!!! 123 ???", *[prose(rng, rng.randrange(1, 90)) for _ in range(25)],
    ]
    rows = [(i, t, "en" if i % 3 else None, "x", 7, "k") for i, t in enumerate(texts)]
    rows += [rows[6], rows[8], (None, base, None, None, None, None), (None, "no id here at all", None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")
