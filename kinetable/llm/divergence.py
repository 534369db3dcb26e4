"""Audit of how the sources of a language differ in their terms, by row accumulation over a term-major index.

Terms are runs of ASCII letters (lower-cased) and characters beyond ASCII.  A language keeps the V terms found in at least
``documents`` of its documents.  With N occurrences of kept terms, a group (lang, source) or a whole language gives a term of
count c the share p = 1 + floor(scale (c + 1) / (N + V)), and two shares differ by f = floor((p - q)^2 / q).

The sum of f over all kept terms is wanted for every ordered pair of sources.  The index holds, for each term, its sources with
their counts.  A group runs through its own terms; each term's index row is scattered into one accumulator with a
cell for every peer, so no pair of postings is ever written or shuffled.  Such rows cover only terms that both
sources hold, so a term adds there f(p, q) less what the zero baselines p0, q0 account for:

    sum f = sum over own terms f(p, q0) + sum over the peer's terms f(p0, q) + (V - own - peer's) f(p0, q0)
          + sum over common terms (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))

The first three follow from how often each count occurs in a group.  Index rows are dealt to shards by hash of the term, groups of a
language to blocks; all arithmetic is on integers.

Defined cases: null text, lang and source are empty strings.  Every group that occurs is reported, also without terms; in a language
without kept terms all pairs have value 0.  Repeated rows are documents of their own.  A source alone in its language has no pairs.  An
empty table gives an empty result.  Columns other than the three named are not read and may have any name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
PIECE = 1 << 22


def pieces(text: bytes, most: int = PIECE) -> Iterator[bytes]:
    """The text in slices of about ``most`` bytes that tear no term."""
    at = 0
    while len(text) - at > most:
        end = TERM.match(text, at + most)
        stop = end.end() if end else at + most
        yield text[at:stop]
        at = stop
    yield text[at:] if at else text


def count_terms(batches: Iterator[pa.RecordBatch], bound: int = 400_000) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the rows seen since the last time ``bound`` entries were held."""
    n: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in n.items():
            terms, seen = list(own), docs[lang, source]
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                k = len(part)
                cols = [pa.array([lang] * k, "string"), pa.array([source] * k, "string"), pa.array(part, "binary"), pa.array([own[t] for t in part], "int64"), pa.array([seen[t] for t in part], "int64")]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
        n.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
            group = lang.as_py(), source.as_py()
            own, distinct = n[group], None
            before = len(own)
            for piece in pieces(text.as_py()):
                terms = TERM.findall(piece.lower())
                own.update(terms)
                distinct = set(terms) if distinct is None else distinct.union(terms)
            docs[group].update(distinct)
            held += len(own) - before
            if held > bound:
                yield from flush()
                held = 0
    yield from flush()


def share(count: Column, total: Column, kept: Column, scale: int) -> Column:
    """1 + floor(scale (count + 1) / (total + kept)), exactly: decimals hold any product of two longs."""
    wide = (count + 1).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + kept).cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def term_index(documents: DataFrame, text: str, lang: str, source: str, least: int) -> DataFrame:
    """(lang, term, total, posts) for kept terms; posts: source and count of each source that has the term."""
    read = documents.select(*(F.coalesce(F.col(c), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"))), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    found = read.mapInArrow(count_terms, "lang string, source string, term binary, n long, docs long")
    by_source = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("posts"))
    return by_term.where(F.col("docs") >= least).select("lang", F.col("term").cast("string").alias("term"), "total", "posts")


def audit_sources(
    documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", documents_least: int = 3, scale: int = 1_000_000_000, top: int = 200, shard: int = 1 << 20, block: int = 1024
) -> DataFrame:
    """(lang, source, part, item, value, rank): peers by divergence (part ``pair``) and overused terms (part ``term``).

    shard: postings of a shard of the index, about; block: peers of a block, about.  Neither changes the result.
    """
    if not 0 < scale <= 1_000_000_000:
        raise ValueError("squares of shares must fit a long: scale is at most 10^9")
    scratch = Scratch(documents.sparkSession, "divergence")
    index = scratch.keep(term_index(documents, text, lang, source, documents_least), "index")
    occurring = documents.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    languages = index.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    posts = index.select("lang", "term", "total", F.explode("posts").alias("post")).select("lang", "term", "total", "post.source", "post.n")
    sums = posts.groupBy("lang", "source").agg(F.sum("n").alias("own_total"), F.count(F.lit(1)).alias("own"))
    groups = occurring.join(sums, ["lang", "source"], "left").join(languages, "lang", "left").na.fill(0)
    p0 = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("own_total"), F.col("kept"), scale)).otherwise(F.lit(1).cast("long"))
    groups = scratch.keep(groups.withColumn("p0", p0), "groups")
    postings = posts.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("own_total"), F.col("kept"), scale).alias("p"), share(F.col("total"), F.col("lang_total"), F.col("kept"), scale).alias("q"), "p0")
    postings = scratch.keep(postings, "postings")

    over = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = groups.agg(F.sum("own")).first()[0] or 0
    pairs = _common(postings, max(1, -(-total // shard))).unionByName(_baselines(postings, groups, block))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(names).unionByName(terms.select(names))


PAIR = "lang string, source string, item string, value long"


def _common(postings: DataFrame, shards: int, most: int = 1 << 20) -> DataFrame:
    """What common terms add to each ordered pair: one dense accumulator a group, row by row of the index."""

    def accumulate(rows: pa.Table) -> pa.Table:
        term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        named = rows["source"].combine_chunks().dictionary_encode()
        names, source = named.dictionary, named.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        term, source, p, p0 = term[order], source[order], rows["p"].to_numpy()[order], rows["p0"].to_numpy()[order]
        first = np.searchsorted(term, np.arange(term[-1] + 2))
        zero = np.empty(len(names), "i8")
        zero[source] = p0
        by_source = np.argsort(source, kind="stable")
        bounds = np.searchsorted(source[by_source], np.arange(len(names) + 1))
        cells = np.zeros((len(names), len(names)), "i8") if len(names) ** 2 <= most else None
        out = []
        for g in range(len(names)):
            acc = cells[g] if cells is not None else np.zeros(len(names), "i8")
            own = by_source[bounds[g] : bounds[g + 1]]
            sizes = np.diff(first)[term[own]]
            stops = np.cumsum(sizes)
            at = 0
            while at < len(own):
                stop = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + most, "right")))
                size, k = sizes[at:stop], own[at:stop]
                row = np.repeat(first[term[k]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                mine, h, q = np.repeat(p[k], size), source[row], p[row]
                np.add.at(acc, h, f(mine, q) - f(mine, zero[h]) - f(zero[g], q) + f(zero[g], zero[h]))
                at = stop
            acc[g] = 0
            peers = np.flatnonzero(acc)
            out.append((np.full(len(peers), g), peers, acc[peers]))
        g, h, value = (np.concatenate(c) for c in zip(*out))
        return pa.table([pa.array([rows["lang"][0].as_py()] * len(g), "string"), names.take(pa.array(g)), names.take(pa.array(h)), pa.array(value)], ["lang", "source", "item", "value"])

    lanes = postings.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)))
    return lanes.groupBy("lang", "shard").applyInArrow(accumulate, PAIR)


def _baselines(postings: DataFrame, groups: DataFrame, block: int, most: int = 1 << 20) -> DataFrame:
    """What terms of one side, and terms of neither, add to each ordered pair; zero for languages without kept terms."""
    shares = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "source").agg(F.collect_list("p").alias("p"), F.collect_list("n").alias("n"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    peers = groups.join(blocks, "lang").withColumn("b", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    peers = peers.groupBy("lang", "b").agg(*(F.collect_list(k).alias(f"peer_{k}") for k in ("source", "p0", "own")))
    rows = groups.select("lang", "source", "p0", "own", "kept").join(shares, ["lang", "source"], "left").join(blocks, "lang")
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").join(peers, ["lang", "b"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                lang, source, p0, own, kept, p, n, peer, q0, theirs = (batch.column(c)[r] for c in ("lang", "source", "p0", "own", "kept", "p", "n", "peer_source", "peer_p0", "peer_own"))
                names, q0, theirs = peer.values, q0.values.to_numpy(), theirs.values.to_numpy()
                p0, rest = p0.as_py(), kept.as_py() - own.as_py() - theirs
                here, there = rest * f(np.int64(p0), q0), np.zeros(len(q0), "i8")
                if p.is_valid:
                    p, n = p.values.to_numpy(), n.values.to_numpy()
                    step = max(1, most // len(q0))
                    for at in range(0, len(p), step):
                        mine, often = p[at : at + step, None], n[at : at + step, None]
                        here += (often * f(mine, q0)).sum(axis=0)
                        there += (often * f(q0, mine)).sum(axis=0)
                k = len(names)
                same, one = pa.array([lang.as_py()] * k, "string"), pa.array([source.as_py()] * k, "string")
                keep = pa.array(np.array(names.to_pylist(), object) != source.as_py())
                yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (same, one, names, pa.array(here))], ["lang", "source", "item", "value"])
                yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (same, names, one, pa.array(there))], ["lang", "source", "item", "value"])

    return rows.mapInArrow(spread, PAIR)
