"""Packing and token files: ids equal the tokenizer's, every id is in one place, blocks of any size agree."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetable.llm.packing import best_fit, pack, pieces
from kinetable.llm.token_files import scan_tokens, token_counts
from kinetable.llm.tokens import encoder

from .conftest import awkward_rows


def test_words_encode_like_whole_texts(tokenizer):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    texts = [r[1] for r in awkward_rows()] + ["don't!!'s a'b'll 12'34", "x́é ÉTÉ İß ﬁ", "<|endoftext|> a<|startoftext|>b", "a≠b Σς 日本語 ӑ|ñ"]
    ids, bounds = encoder(tokenizer).encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == whole.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_takes_the_tightest_window(lengths):
    window, offset = best_fit(np.array(lengths, "i8"), 64)
    free, at = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [f for f in free if f >= lengths[i]]
        got = 64 - offset[i]
        assert got == (min(fits) if fits else 64)
        if fits:
            free.remove(min(fits))
        free.append(got - lengths[i])
        at.setdefault(window[i], []).append((offset[i], lengths[i]))
    for parts in at.values():
        place = 0
        for o, n in sorted(parts):
            assert o == place
            place += n


def test_pack(awkward, nothing, tokenizer):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    got = pack(awkward, tokenizer, size=256, group_rows=16, with_ids=True).toPandas()
    want = Counter((r[0], tuple([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in awkward_rows())
    for r in got.itertuples():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"] == seq["length"].cumsum() - seq["length"]).all() and seq["length"].sum() <= 256
    ids = Counter()
    for (doc, n), count in Counter((d, len(t)) for d, t in want.elements()).items():
        own = got[(got.doc_id.isna() if doc is None else got.doc_id == doc) & (got.doc_tokens == n)]
        assert own["length"].sum() == n * count
        ids[doc, n] = count
    single = got[got.doc_id == 24].sort_values("start")
    text = dict((r[0], r[1]) for r in awkward_rows())[24]
    assert np.frombuffer(b"".join(single["ids"]), "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]
    assert pack(nothing, tokenizer).count() == 0


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_token_files(awkward, tokenizer, block):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    whole.encode_special_tokens = True
    got = token_counts(awkward, tokenizer, 49407, block_tokens=block).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], len(whole.encode(r[1] or "", add_special_tokens=False).ids)) for r in awkward_rows())


def test_scan_of_hand_written_files(spark, nothing, tokenizer, tmp_path):
    files = {"a": [5, 9, 9, 1, 2, 3], "b": [9], "c": [4, 4, 4, 4, 4, 4, 9], "d": [], "e": [7, 7]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    table = spark.createDataFrame([(f"file://{tmp_path}/{n}", 2 * len(i)) for n, i in files.items()], "path string, bytes long")
    for block in (1, 2, 3, 100):
        got = {(r.path[-1], r.ordinal, r.start, r.n_tokens, r.closed) for r in scan_tokens(table, 9, block).collect()}
        assert got == {("a", 0, 0, 1, True), ("a", 1, 2, 0, True), ("a", 2, 3, 3, False), ("b", 0, 0, 0, True), ("c", 0, 0, 6, True), ("e", 0, 0, 2, False)}
    assert token_counts(nothing, tokenizer, 49407).count() == 0


def test_pieces_pass_without_a_frame_of_all_texts(spark, tokenizer):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word ', id) AS text").coalesce(1)
    rows = pieces(docs, tokenizer, 256, 1, "doc_id", "text", False)
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
    assert "MapInPandas" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sum(r["n"] for r in sizes.collect()) == 3000


def test_counts_are_not_named_by_broadcast(awkward, tokenizer):
    plan = token_counts(awkward, tokenizer, 49407)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
