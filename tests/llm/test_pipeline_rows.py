"""Filters judge rows, not ids; the whole pipeline against its stages on small tables."""

import random

import pytest

import corpus_pipeline
from kinetable.llm import decontaminate, exact_dedup, jaccard, language
from kinetable.llm.packing import pack

WORDS = "the of and to in that with from river stone mountain paper engine garden window silver copper winter summer yellow".split()
NAMES = "doc_id long, text string, lang string, source string, n_chars long, _digest string, _gone string, _leaked long, _lang0 string, _mark int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "d", "g", 2, "l", 3) for i, t, lang in rows], NAMES).repartition(2)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_leaks_of_a_row_do_not_take_rows_of_the_same_id(spark):
    rng = random.Random(1)
    item = prose(rng, 40)
    clean = prose(rng, 80), prose(rng, 80)
    leaked = prose(rng, 10) + " " + item + " " + prose(rng, 10)
    docs = table(spark, [(None, leaked, "en"), (None, clean[0], "en"), (1, leaked, "en"), (1, clean[1], "en"), (2, None, "en")])
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    out = decontaminate.drop_leaks(docs, benchmark)
    assert out.columns == docs.columns
    assert kept(out) == kept(docs.where("text IS NULL OR length(text) > 0").where(~docs["text"].eqNullSafe(leaked)))
    assert kept(decontaminate.drop_leaks(docs, benchmark.limit(0))) == kept(docs)


def test_near_copies_of_a_row_do_not_take_rows_of_the_same_id(spark):
    rng = random.Random(2)
    one, two = prose(rng, 100), prose(rng, 100)
    near = one + " tail"
    docs = table(spark, [(3, one, "en"), (7, near, "en"), (7, two, "en"), (None, near + " more", "en"), (None, prose(rng, 50), "en"), (9, "", "en"), (9, None, "en")])
    got = kept(jaccard.keep_first(docs, k=5, percent=80))
    assert [t for _, t in got].count(one) == 1 and two in [t for _, t in got] and near not in [t for _, t in got] and len(got) == 5
    assert jaccard.keep_first(docs, k=5, percent=80).columns == docs.columns


def test_columns_with_inner_names_survive(spark):
    rng = random.Random(3)
    text = prose(rng, 20)
    docs = table(spark, [(1, text, "en"), (2, text.upper(), "en"), (4, prose(rng, 20), "fr")])
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns and kept(out) == kept(docs.where("doc_id > 1")) and {r["_digest"] for r in out.collect()} == {"d"}
    assert kept(language.keep_known(docs)) == kept(docs)


def test_texts_with_letters_stay_when_no_language_is_known(spark):
    docs = table(spark, [(1, "some words", None), (2, "other words", None), (3, "123 !!", None), (4, None, None), (5, "", None)])
    out = language.keep_known(docs)
    assert out.columns == docs.columns and kept(out) == [(1, "some words"), (2, "other words")]


def brute(rows, item, rng):
    """The stages on lists of (id, text): letters, exact copies, near copies, the benchmark passage."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    last = {}
    for i, t in rows:
        last[t.lower()] = max(last.get(t.lower(), (-1, "")), (i, t))
    rows = sorted(last.values())
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    return [r for r in rows if item not in r[1]]


def test_run_equals_the_stages_by_brute_force(spark, tmp_path, tokenizer):
    rng = random.Random(4)
    item = prose(rng, 40)
    base = prose(rng, 120)
    rows = [(i, prose(rng, rng.randrange(6, 80))) for i in range(30)]
    rows += [(40 + i, " ".join(base.split()[:i] + ["edit"] + base.split()[i + 1 :])) for i in range(0, 30, 3)]
    rows += [(80, rows[3][1]), (81, rows[3][1].upper()), (82, "12 34"), (83, ""), (84, None), (85, prose(rng, 5) + " " + item), (86, prose(rng, 3000))]
    table(spark, [(i, t, "en" if i % 2 else "de") for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    want = brute(rows, item, rng)
    assert sorted(set(got["doc_id"])) == sorted(i for i, _ in want)
    alone = pack(spark.createDataFrame(want, "doc_id long, text string"), tokenizer).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(got[["doc_id", "doc_tokens"]].drop_duplicates().itertuples(index=False, name=None)) == sorted(alone[["doc_id", "doc_tokens"]].drop_duplicates().itertuples(index=False, name=None))
    assert got.groupby("doc_id")["length"].sum().to_dict() == alone.groupby("doc_id")["length"].sum().to_dict() and set(key) <= set(got.columns)
