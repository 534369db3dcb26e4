"""Archives, leaks, shards."""

import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinetable.llm.decontaminate import Index, align, drop_leaks, find_leaks, normal
from kinetable.llm.sharding import Shard, assign_shards, even_tree, grow, shard_of
from kinetable.llm.warc import archive_pages, read_records, record

PAGES = [
    (1, "http://a/ b\n", "<p>small</p>", "x"), (2, None, None, "x"), (3, "http://b", "same " * 300, "x"), (4, "http://c", "same " * 300, "y"), (7, "http://d", "same " * 300, None),
    (5, "u", "é" * 499, "z"), (6, "u", "é" * 499, "z"), (8, "u", "é" * 500, "z"), (9, "u", "é" * 500, "z"), (9, "u", "é" * 500, "z"), (10, "u", "long" * 90_000, "z"), (11, "", "", "z"),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, record_type string").repartition(2)
    got = archive_pages(pages).collect()
    keep = {}
    for i, _, h, _ in PAGES:
        if len((h or "").encode()) >= 1000:
            keep[h] = max(keep.get(h, i), i)
    want = Counter()
    for i, _, h, _ in PAGES:
        raw = (h or "").encode()
        again = h in keep and keep[h] != i
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", keep[h] if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.digest_ok for r in got if r.record_type == "response")
    assert archive_pages(pages.limit(0)).count() == 0


def test_reader_frames_and_checks(tmp_path):
    date = "2000-01-01T00:00:00Z"
    good = [record(1, "http://x/a b", b"payload", "response", None, date), record(2, None, b"\r\n\r\n" * 40_000, "response", None, date), record(3, None, b"payload", "revisit", 1, date)]
    whole = tmp_path / "a.warc.gz"
    whole.write_bytes(b"".join(good))
    got = list(read_records(f"file://{whole}", keep_payload=True))
    assert [r["payload"] for r in got] == [b"payload", b"\r\n\r\n" * 40_000, b""] and [r["at"] for r in got] == [0, len(good[0]), len(good[0]) + len(good[1])]
    assert [r["digest_ok"] for r in got] == [True, True, None] and got[0]["target_uri"] == "http://x/a%20b" and got[2]["refers_to"] == "urn:record:1"
    plain = gzip.decompress(good[0])
    for name, data, error in (
        ("cut", good[0][:-20], True), ("length", gzip.compress(plain.replace(b"payload\r\n", b"paylo\r\n")), True), ("digest", gzip.compress(plain.replace(b"payload\r\n", b"PAYLOAD\r\n")), False),
    ):
        (tmp_path / name).write_bytes(data)
        if error:
            with pytest.raises(ValueError):
                list(read_records(f"file://{tmp_path}/{name}"))
        else:
            assert [r["digest_ok"] for r in read_records(f"file://{tmp_path}/{name}")] == [False]


def edits(p, t):
    """Least edits of p against any stretch of t."""
    row = [0] * (len(t) + 1)
    for c in p:
        new = [row[0] + 1]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_is_exact():
    rng = random.Random(3)
    for _ in range(300):
        p = bytes(rng.choice(b"abc ") for _ in range(rng.randrange(4, 40)))
        t = bytearray(p)
        for _ in range(rng.randrange(7)):
            j = rng.randrange(len(t) + 1)
            t[j : j + rng.randrange(2)] = rng.choice([b"x", b""])
        t = bytes(rng.choice(b"abc ") for _ in range(rng.randrange(12))) + bytes(t) + bytes(rng.choice(b"abc ") for _ in range(rng.randrange(12)))
        got, want = align(p, t, 4), edits(p, t)
        assert (got[0] if got else None) == (want if want <= 4 else None)
        assert not got or edits(p, t[got[1] : got[2]]) == got[0]


def test_leaks_against_full_alignment(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    items = [(i, text(rng.randrange(8, 40)), "x") for i in range(12)] + [(50, "tiny", "x"), (51, None, "x"), (52, "", "x"), (None, text(20), "x")]
    docs = [(900, None, 1), (901, "", 1), (902, "a TINY   thing", 1)]
    for i in range(60):
        body, own = text(rng.randrange(0, 60)), bytearray(items[rng.randrange(12)][1], "ascii")
        for _ in range(rng.randrange(0, 30)):
            j = rng.randrange(len(own))
            own[j : j + rng.randrange(2)] = rng.choice([b"x", b"", b"\n"])
        docs.append((i, body + " " + (own.decode().upper() if i % 2 else text(5)) + "\t " + text(9), 1))
    docs.append(docs[10])
    table, bench = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(3), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = find_leaks(table, bench, block_chars=600).collect()
    want, index = Counter(), Index([(i, normal(t)) for i, t, _ in items], 8, 10, 100)
    for d, t, _ in docs:
        found = {index.item[i] for i, p in enumerate(index.parts) if (edits(p, normal(t)) if index.budget[i] else 0 if p in normal(t) else 1) <= index.budget[i]}
        want.update((d, item) for item in found)
    assert Counter((r.doc_id, r.item_id) for r in got) == want and want
    kept = drop_leaks(table, bench)
    assert kept.columns == table.columns and Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _, _ in docs if d not in {k[0] for k in want})
    assert find_leaks(table, bench.limit(0)).count() == 0 and find_leaks(table.limit(0), bench).count() == 0


def test_excerpts_are_found_from_any_offset():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    item = normal("x" + text(350) + "x")
    index = Index([(7, item), (8, normal(text(90)))], 8, 10, 100)
    texts, cuts = [], []
    for size in (100, 109, 120, 138):
        for a in range(len(item) - size + 1):
            own = bytearray(item[a : a + size])
            if size >= 109:  # holds a whole part: edits apart from one another, at most 10
                for j in range(3, size, 15):
                    own[j] = ord("%")
            cuts.append((a, size))
            texts.append(normal(text(60) + "# ") + bytes(own) + normal(" #" + text(60)))
    found = {d for d, i, *_ in index.matches(texts) if index.item[i] == 7}
    assert [cuts[d] for d in range(len(texts)) if d not in found] == []
    assert not list(index.matches([normal(text(60)) + item[a : a + 60] + normal(text(60)) for a in range(250)]))


def test_shards(spark, awkward, nothing):
    got = assign_shards(awkward, shards=5).toPandas()
    assert len(got) == awkward.count() and ((got["grown_shard"] == got["shard"]) | (got["grown_shard"] == 5)).all()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    again = assign_shards(awkward, shards=5, rows_per_run=2).toPandas()
    key = ["doc_id", "size", "text_crc32", "shard"]
    assert Counter(map(tuple, got[[*key, "slot"]].fillna(-1).values.tolist())) == Counter(map(tuple, again[[*key, "slot"]].fillna(-1).values.tolist()))
    assert assign_shards(nothing).count() == 0


def test_movement_stays_in_changed_subtrees(spark):
    tree = even_tree(12, per_rack=2, per_region=4)
    heavier = [s if s.shard != 5 else Shard(s.region, s.rack, 5, 3.0) for s in tree]
    rows = shard_of(spark.range(20_000), F.col("id"), tree, "a")
    rows = shard_of(shard_of(rows, F.col("id"), heavier, "b"), F.col("id"), grow(tree, 2.0), "c").toPandas()
    region = {s.shard: s.region for s in tree}
    moved = rows[rows.a != rows.b]
    assert len(moved) and all(region[b] == region[5] for b in moved.b)  # rows only arrive in the changed region
    assert set(rows[rows.a != rows.c].c) == {12}
    assert abs((rows.c == 12).mean() - 2 / 14) < 0.01 and abs((rows.b == 5).mean() - 3 / 14) < 0.015
    assert (rows.groupby("a").size() / len(rows) - 1 / 12).abs().max() < 0.01
