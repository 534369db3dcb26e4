"""Source divergence against a dense double loop over all kept terms."""

import random
import re
from collections import Counter

from kinetable.llm.divergence import audit_sources, pieces

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, value double, rank int, p string, own int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def dense(rows, least=3, scale=10**9, top=200):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, k in seen.items() if k >= least]
        sources = sorted({d[1] for d in docs if d[0] == lang})
        counts = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if seen[t] >= least) for s in sources}
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + scale * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            peers = [(-sum(f(p(counts[s], t), p(counts[o], t)) for t in kept), o) for o in sources if o != s]
            terms = [(-f(p(counts[s], t), p(whole, t)), t) for t in kept if counts[s][t] and p(counts[s], t) > p(whole, t)]
            for part, items, most in (("pair", peers, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, -v, r) for r, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, *r, 1, "x", 2.0, 3, "y", 4) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in audit_sources(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def rows_of(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("Haus", "été", "rock", "日本", "ÄÖ", "zé") for b in ("", "s", "a", "b", "cd", "e", "fg")]
    rows = []
    for _ in range(n):
        k = rng.choice([0, 1, 5, 40])
        text = "".join(rng.choice(vocabulary[: rng.choice([4, 20, 42])]) + rng.choice([" ", "-", "\n", "1", "_", "@[`{\x7f"]) for _ in range(k))
        rows.append((text, rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "ä", "z", None])))
    return rows + [(None, "en", "a"), (None, "xx", "alone"), ("word", "yy", "one"), ("word", "yy", "two"), ("", "yy", None)] + rows[:9]


def test_equals_the_dense_sum(spark):
    rows = rows_of(1)
    assert got(spark, rows) == dense(rows)


def test_shards_blocks_and_a_small_top_change_nothing_else(spark):
    rows = rows_of(2)
    assert got(spark, rows, shard=7, block=2, top=3, documents_least=2, scale=1000) == dense(rows, 2, 1000, 3)


def test_no_terms_and_no_rows(spark):
    assert got(spark, []) == []
    rows = [("", "en", "a"), (None, "en", "b"), ("1 2", None, None)]
    assert got(spark, rows) == dense(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_long_texts_are_cut_between_terms():
    text = ("word élan " * 500 + "x" * 3000 + " y").encode()
    parts = list(pieces(text, 100))
    assert b"".join(parts) == text and len(parts) > 30
    pattern = re.compile(rb"[a-z\x80-\xff]+")
    assert [t for p in parts for t in pattern.findall(p)] == pattern.findall(text)
