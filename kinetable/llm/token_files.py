"""Flat token files, and documents counted in them by a separator scan.

A file is nothing but token ids as little-endian unsigned 16-bit numbers, one separator id after each document: no index,
no header.  The scan cuts files into blocks of fixed size that any task may read, finds separators in a block with one
vector comparison, and returns one row a block: how many separators, where the last one is, and the lengths between.
A prefix scan over the blocks of a file (number of separators before, last separator before) places documents that begin
in an earlier block.

Writing goes by manifest (see ``files``); its rows also say which document is the n-th of a file, so counts found by the
scan can be named.

Defined cases: null and empty texts are a separator alone (0 tokens).  Ids after the last separator of a file are one
document with ``closed`` false.  An empty file has no documents, an empty table writes no files.  Repeated rows are
documents of their own; null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import Parts, open_read
from .shared import Scratch
from .tokens import encoder, slices

WIDTH = 2


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, separator: int, doc_id: str = "doc_id", text: str = "text", most: int = 64 << 20) -> DataFrame:
    """Write all documents; the manifest as (path, ordinal, doc_id, stop), stop being the file's bytes so far."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, parts, ordinal, last = encoder(tokenizer, ordinary=True), Parts(folder, ".tokens", most), 0, None
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for a, b in slices(texts):
                tokens, bounds = enc.encode(texts[a:b])
                paths, ordinals, stops = [], [], []
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    data = np.append(tokens[lo:hi], np.uint32(separator)).astype("<u2").tobytes()
                    path, at = parts.write(data)
                    ordinal, last = (ordinal + 1 if path == last else 0), path
                    paths.append(path)
                    ordinals.append(ordinal)
                    stops.append(at + len(data))
                yield pa.RecordBatch.from_arrays([pa.array(paths, "string"), pa.array(ordinals, "int64"), ids[a:b], pa.array(stops, "int64")], ["path", "ordinal", "doc_id", "stop"])
        parts.close()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"path string, ordinal long, doc_id {kind}, stop long")


def scan_tokens(files: DataFrame, separator: int, block_tokens: int = 1 << 20) -> DataFrame:
    """Documents of the files (path, bytes): path, ordinal, start (in tokens), n_tokens, closed."""
    step = block_tokens * WIDTH
    blocks = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step))).alias("block"))
    blocks = blocks.repartition(F.col("path"), F.col("block"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, block in zip(*(batch.column(c).to_pylist() for c in range(3))):
                with open_read(path) as file:
                    ids = np.frombuffer(file.read_at(min(step, size - block * step), block * step), "<u2")
                at = np.flatnonzero(ids == separator) + block * block_tokens
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block]), pa.array([len(at)], "int64"), pa.array([int(at[-1]) if len(at) else None], "int64"), pa.array([block * block_tokens + len(ids)], "int64"), pa.array([at.tolist()], pa.list_(pa.int64()))],
                    ["path", "block", "n", "last", "stop", "at"],
                )

    found = blocks.mapInArrow(scan, "path string, block long, n long, last long, stop long, at array<long>")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    found = found.withColumns({
        "seen": F.coalesce(F.sum("n").over(before), F.lit(0)), "open": F.coalesce(F.max("last").over(before), F.lit(-1)) + 1,
        "end": F.max("stop").over(whole), "final": F.max("last").over(whole), "top": F.max("block").over(whole), "total": F.sum("n").over(whole),
    })
    starts = F.concat(F.array("open"), F.transform(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda x: x + 1))
    docs = found.where("n > 0").select("path", "seen", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("at").alias("stop"))).alias("i", "d"))
    docs = docs.select("path", (F.col("seen") + F.col("i")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = found.where("block = top").withColumn("start", F.coalesce(F.col("final") + 1, F.lit(0))).where("start < end")
    return docs.unionByName(rest.select("path", F.col("total").alias("ordinal"), "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")))


def token_counts(docs: DataFrame, tokenizer: str, separator: int, doc_id: str = "doc_id", text: str = "text", block_tokens: int = 1 << 20) -> DataFrame:
    """Write the documents as token files, count them by the scan, name the counts: doc_id, n_tokens, start, ordinal, path."""
    scratch = Scratch(docs.sparkSession, "token_files")
    manifest = scratch.keep(write_tokens(docs, scratch.path("files"), tokenizer, separator, doc_id, text), "manifest")
    files = manifest.groupBy("path").agg(F.max("stop").alias("bytes"))
    counts = scan_tokens(files, separator, block_tokens).where("closed")
    # files compress so well that the planner takes their rows for few; as a broadcast they would fill the driver
    return manifest.join(counts.hint("merge"), ["path", "ordinal"]).select("doc_id", "n_tokens", "start", "ordinal", "path")
