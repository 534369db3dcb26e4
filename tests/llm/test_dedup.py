"""Exact and near duplicates and repeated phrases against direct computations."""

import hashlib
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinetable.llm import jaccard
from kinetable.llm.components import components
from kinetable.llm.exact_dedup import drop_copies, exact_groups
from kinetable.llm.jaccard import keep_first, near_duplicates
from kinetable.llm.phrases import remove_repeats

from .conftest import awkward_rows

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(i):
    return (i is not None, i or 0)


def exact_reference():
    rows = [(r[0], (r[1] or "").translate(LOWER)) for r in awkward_rows()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    return Counter((i, max(groups[t], key=low), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), groups


def test_exact_groups(awkward):
    want, groups = exact_reference()
    got = exact_groups(awkward).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = drop_copies(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(groups)


def test_exact_groups_with_colliding_digests(awkward):
    weak = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)
    want, groups = exact_reference()
    got = exact_groups(awkward, digest=weak).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter({k[:3]: 0 for k in want}) + Counter(k[:3] for k in want.elements())
    assert sum(r.kept for r in got) == len(groups)


def test_exact_groups_over_several_batches(awkward):
    want, _ = exact_reference()
    got = exact_groups(awkward, files_per_batch=1).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got) == want


def test_exact_groups_of_nothing(nothing):
    assert exact_groups(nothing).count() == 0


def near_reference(rows, k, percent):
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOWER))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((m for m in ids if m is not None), default=None) for g, ids in members.items()}
    return Counter((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def test_near_duplicates(awkward, nothing):
    for k, percent, leaf in ((4, 85, 256), (2, 60, 3)):
        got = near_duplicates(awkward, k=k, percent=percent, leaf_rows=leaf).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_reference(awkward_rows(), k, percent)
    assert near_duplicates(nothing).count() == 0


def test_keep_first(awkward):
    want = {r[2] for r in near_reference(awkward_rows(), 5, 80)}
    kept = keep_first(awkward, k=5, percent=80)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} == want | {None}


def test_chained_near_copies_in_one_tree(spark):
    """A chain in which only neighbours link, all sharing most shingles, with leaves far smaller than the group."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[: 3 * i] and [f"x{j}" for j in range(3 * i)] + words[3 * i :] or words)) for i in range(40)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf_rows=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_reference(rows, 4, 85)
    assert len({r.component_id for r in got}) < 40


def test_large_group_of_near_copies(spark, monkeypatch):
    """A text and copies with edits of their own: the copies mostly miss each other, and rounds of drawn centres tie them by the text."""
    rng, words = random.Random(3), [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(words))]
    for i in range(1, 300):
        own = list(words)
        for j in rng.sample(range(120), rng.randrange(1, 3)):
            own[j] = f"e{i}_{j}"
        rows.append((i, " ".join(own)))
    seen = []
    verified = jaccard._Sets.verified

    def named(self, pairs, name):
        seen.append(name)
        return verified(self, pairs, name)

    monkeypatch.setattr(jaccard._Sets, "verified", named)
    got = near_duplicates(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_reference(rows, 4, 85)
    assert {r.component_id for r in got} == {0} and "star1" in seen


def test_similarity_without_common_resolution_is_refused(nothing):
    with pytest.raises(ValueError):
        near_duplicates(nothing, percent=50)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (8, 7), (3, 10), (2, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 7: 7, 8: 7, 9: 7}


def repeats_reference(rows, length):
    words = [WORD.findall(r[1] or "") for r in rows]
    count = Counter(tuple(w[j : j + length]) for w in words for j in range(len(w) - length + 1))
    out = []
    for r, w in zip(rows, words):
        gone = set()
        for j in range(len(w) - length + 1):
            if count[tuple(w[j : j + length])] > 1:
                gone |= set(range(j, j + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return Counter(out)


def test_remove_repeats(awkward, nothing):
    for length, anchor, shard in ((35, 8, 4 << 20), (5, 2, 2000)):
        got = remove_repeats(awkward, length=length, anchor=anchor, shard_bytes=shard, with_text=True).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == repeats_reference(awkward_rows(), length)
    assert remove_repeats(nothing).count() == 0


def test_only_possible_copies_are_shuffled_with_their_texts(spark):
    from kinetable.llm.exact_dedup import maybe_among

    ids = spark.range(0, 40000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), (F.col("id") % 100 == 7).alias("hit"))
    n = {(r.hit, r.maybe): r["count"] for r in maybe_among(ids, "digest", ids.where("hit").select("digest")).groupBy("hit", "maybe").count().collect()}
    assert n[True, True] == 400 and (True, False) not in n and n[False, False] > 0.9 * 39600
    none = maybe_among(ids, "digest", ids.where("false").select("digest"))
    assert none.where("maybe").count() == 0 and none.columns == ["digest", "hit", "maybe"]
    docs = spark.createDataFrame([(1, "One"), (2, "one"), (None, "one"), (None, "Two"), (3, "three"), (3, "three"), (3, "four")], "doc_id long, text string")
    kept = drop_copies(docs)
    assert Counter(map(tuple, kept.collect())) == Counter([(2, "one"), (None, "Two"), (3, "three"), (3, "four")])
