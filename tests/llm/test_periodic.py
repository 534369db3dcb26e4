"""Grammar-compressed runs against a scan of every period, and the parts of the grammar on their own."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetable.llm.periodic import collapse, crossing, find_runs, periodic_runs, re_pair, recurring, word_ids, z_array
from kinetable.llm.queries import op13, repeated_tail


def scan(words, least=12):
    """Every period, every stretch: the smallest period of each stretch stays."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def runs_of(words, least=12):
    return [tuple(r) for r in find_runs(np.array(words, "i4"), least).tolist()]


def test_equals_the_scan_on_repetitive_texts():
    rng = random.Random(1)
    for _ in range(1500):
        k, n, words = rng.choice([1, 2, 2, 3, 4, 30]), rng.choice([0, 1, 11, 12, 13, 30, 80, 200]), []
        while len(words) < n:
            words += [rng.randrange(k) for _ in range(rng.randrange(1, 20))] * rng.choice([1, 1, 2, 3, 4, 7])
        least = rng.choice([2, 5, 12, 12])
        assert runs_of(words[:n], least) == scan(words[:n], least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 14))
def test_equals_the_scan(words, least):
    assert runs_of(words, least) == scan(words, least)


def test_rules_spell_the_text_and_rules_of_a_period_are_balanced():
    words = np.tile(np.arange(64), 9).astype("i8")
    rules, top = re_pair(np.append(words, -1))
    assert sum(size for _, size in top) == len(words)
    for places, left, size in rules:
        assert 0 < left < size and all((words[p : p + size] == words[places[0] : places[0] + size]).all() for p in places)
    assert sum(size for _, _, size in rules if size <= 64) <= 64 * 7  # not of the order of 64 * 64


def test_long_texts_of_one_word_and_of_one_period():
    assert runs_of([0] * 50_000) == [(0, 50_000, 1)]
    assert runs_of(list(range(3000)) * 5) == [(0, 15_000, 3000)]


def test_boundary_runs_and_z():
    assert z_array([0, 1, 0, 1, 0, 2]) == [6, 0, 3, 0, 1, 0]
    assert sorted(crossing([9, 0, 1, 0, 1, 0, 8], 3, 2)) == [(1, 6, 2)]
    assert crossing([0, 1, 2, 3], 2, 2) == []


def test_words_are_read_in_slices():
    text = b"aa  bb\tcc\x0bdd\xc2\xa0ee aa " * 300
    whole, names = word_ids(text)
    assert [names[i] for i in whole] == [w for w in re.split(rb"[\x20\x09-\x0d]+", text) if w]
    cut, again = word_ids(text, 50)
    assert (whole == cut).all() and names == again
    assert recurring(np.array([1, 2, 3, 4, 1, 2, 9]), 2).tolist() == [True, True, False, False, True, True, False]


SCHEMA = "doc_id long, text string, runs int, collapsed string, id string"


def awkward_rows():
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "a " * 40, "a b " * 30 + "c", *[" ".join(rng.choice("pqrst") + str(rng.randrange(20)) for _ in range(rng.randrange(1, 400))) for _ in range(120)]]
    line = "the same line of eight words is here\n"
    texts += [line * 5 + "other " + line * 2, "x y " * 6000, "w" * 200_000, "w" * 200_000]
    return [(i, t, 1, "c", "d") for i, t in enumerate(texts)] + [(None, "z " * 30, 0, "", ""), (5, "a b " * 30 + "c", 0, "", "")]


def expected(key, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = scan(words) if len(words) < 3000 else [(0, len(words), 2)]
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    row = (len(runs), best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (0, None, None, None, None)
    return (key, *row, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_on_awkward_rows(spark, tmp_path):
    rows = awkward_rows()
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] and len(r[1].split()) > 20 for r in rows)
    assert all(len((r[1] or "").split()) < 3000 or zlib.crc32(str(r[0]).encode()) % 10 for r in rows)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(r[0], r[1]) for r in rows), key=str)


def test_operator_gives_runs_and_text(spark):
    rows = [(1, "x y z " * 5 + "end", 0, "", ""), (2, None, 0, "", "")]
    got = {r["doc_id"]: r for r in periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 15, 3)] and got[1]["collapsed"] == "x y z end"
    assert got[2]["runs"] == [] and got[2]["collapsed"] == ""
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collapse(np.arange(5), np.array([[0, 4, 1]])).tolist() == [0, 4]
    assert repeated_tail(None, 5) is None
