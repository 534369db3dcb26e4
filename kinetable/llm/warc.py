"""WARC archives: a writer with one gzip member per record, and a sequential reader.

Records with equal payloads of at least ``revisit_bytes`` bytes: the one with the largest id is the response, the others
are revisits that refer to it and carry no payload.  Equality is by SHA-256 of the payload; the digest written is SHA-1,
as archives have it.

The reader goes through a file once: it feeds compressed chunks to an incremental decompressor, frames the block by its
content length, hashes the payload as it passes and compares it with the digest in the header.  It holds one chunk, and
the payload only if asked.  Truncated members and wrong framing are errors; a wrong digest is reported in ``digest_ok``.

Defined cases: null payloads are empty; null urls leave the header out; control characters in urls are percent-encoded.  A
null id sorts below all others.  Rows equal in id and payload are each a response.  An empty table writes no file and reads
back as no record.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import Parts, open_stream
from .shared import Scratch

NAME = "urn:record:"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, digest_ok boolean, path string, at long"


def decide(pages: DataFrame, page_id: str, payload: str, revisit_bytes: int) -> DataFrame:
    """The rows with record_type and refers_to."""
    rows = pages.withColumn("_size", F.octet_length(payload))
    # a small payload's key is its row's own, so small ones neither meet nor crowd one partition
    rows = rows.withColumn("_same", F.when(F.col("_size") >= revisit_bytes, F.sha2(payload, 256)).otherwise(F.xxhash64(page_id, payload).cast("string")))
    first = rows.where(F.col("_size") >= revisit_bytes).groupBy("_same").agg(F.max(page_id).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = rows.join(first, "_same", "left")
    again = F.col("_n").isNotNull() & ~F.col(page_id).eqNullSafe(F.col("_first"))
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("_first"))).drop("_size", "_same", "_first", "_n")


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to, date: str) -> bytes:
    """One record as a gzip member."""
    block = HTTP + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{NAME}{page_id}>", f"WARC-Date: {date}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def write_archives(pages: DataFrame, folder: str, most: int = 32 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, payload, record_type, refers_to) rows; the files as (path, records, bytes).  Materialise this once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, files = Parts(folder, ".warc.gz", most), {}
        for batch in batches:
            for r in (row for at in range(0, batch.num_rows, 64) for row in batch.slice(at, 64).to_pylist()):
                data = record(r["page_id"], r["url"], r["payload"], r["record_type"], r["refers_to"], date)
                path, _ = parts.write(data)
                n, size = files.get(path, (0, 0))
                files[path] = n + 1, size + len(data)
        parts.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(files), "string"), pa.array([n for n, _ in files.values()], "int64"), pa.array([s for _, s in files.values()], "int64")], ["path", "records", "bytes"])

    return pages.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, "path string, records long, bytes long")


def members(path: str, chunk: int = 1 << 16) -> Iterator[tuple[int, Iterator[bytes]]]:
    """The gzip members of a file: offset and decompressed pieces.  Each member's pieces must be used up before the next."""
    with open_stream(path) as stream:
        state = {"raw": stream.read(chunk), "at": 0}

        def pieces() -> Iterator[bytes]:
            unpack = zlib.decompressobj(31)
            while not unpack.eof:
                if not state["raw"]:
                    state["raw"] = stream.read(chunk)
                before = len(state["raw"])
                out = unpack.decompress(state["raw"], 1 << 20)
                if not before and not out and not unpack.eof:
                    raise ValueError(f"{path}: member at {state['start']} is cut off")
                rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                state["at"] += before - len(rest)
                state["raw"] = rest
                if out:
                    yield out

        while state["raw"]:
            state["start"] = state["at"]
            yield state["start"], pieces()
            state["raw"] = state["raw"] or stream.read(chunk)


def read_records(path: str, keep_payload: bool = False) -> Iterator[dict]:
    """The records of one archive in order."""
    for at, pieces in members(path):
        buffer = b""
        while b"\r\n\r\n" not in buffer:
            more = next(pieces, None)
            if more is None:
                raise ValueError(f"{path}: no header at {at}")
            buffer += more
        head, _, buffer = buffer.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"{path}: not a record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        left, inside = int(fields["content-length"]), not fields.get("content-type", "").startswith("application/http")
        digest, size, kept, http = hashlib.sha1(), 0, [], b""

        def take(data: bytes) -> None:
            nonlocal inside, http, size
            if not inside:
                http += data
                if b"\r\n\r\n" not in http:
                    return
                data, inside = http.partition(b"\r\n\r\n")[2], True
            digest.update(data)
            size += len(data)
            if keep_payload:
                kept.append(data)

        tail = b""
        while True:
            own, tail_part = buffer[:left], buffer[left:]
            left -= len(own)
            take(own)
            tail += tail_part
            buffer = next(pieces, None)
            if buffer is None:
                break
        if left or tail != b"\r\n\r\n":
            raise ValueError(f"{path}: wrong length at {at}")
        named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        kind = fields["warc-type"]
        said = base64.b32decode(named).hex() if named else None
        yield {
            "record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
            "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
            "payload_bytes": size if kind != "revisit" else None, "payload_digest": digest.hexdigest() if kind != "revisit" else said,
            "digest_ok": None if kind == "revisit" or said is None else said == digest.hexdigest(), "path": path, "at": at,
            **({"payload": b"".join(kept)} if keep_payload else {}),
        }


def read_archives(files: DataFrame, keep_payload: bool = False, task_bytes: int = 32 << 20) -> DataFrame:
    """The records of the archives listed as (path, bytes); tasks take about ``task_bytes``, one archive at a time."""
    schema = RECORDS + (", payload binary" if keep_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"payload_bytes": pa.int64(), "digest_ok": pa.bool_(), "at": pa.int64(), "payload": pa.binary()}
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for r in read_records(path, keep_payload):
                    rows.append(r)
                    held += len(r.get("payload") or b"")
                    if len(rows) == 10_000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, kinds.get(c, pa.string())) for c in rows[0]]))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, kinds.get(c, pa.string())) for c in rows[0]]))

    size = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(size["n"], max(files.sparkSession.sparkContext.defaultParallelism, size["bytes"] // task_bytes)))
    return files.select("path").repartition(tasks).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 1000) -> DataFrame:
    """Write all pages as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok, path, at.

    A revisit's size is that of the response it refers to.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    files = scratch.keep(write_archives(decide(rows, "page_id", "payload", revisit_bytes), scratch.path("archives")), "files")
    records = scratch.keep(read_archives(files), "records")
    number = lambda c: F.substring(c, len(NAME) + 1, 40).try_cast("long")
    sizes = records.where("record_type = 'response'").select(number(F.col("record_id")).alias("_id"), "payload_digest", F.col("payload_bytes").alias("_size"))
    sizes = sizes.distinct()  # repeated rows write equal responses
    out = records.withColumn("_refers", number(F.col("refers_to")))
    plain = out.where("record_type = 'response'").withColumn("_size", F.col("payload_bytes"))
    again = out.where("record_type = 'revisit'").join(sizes.withColumnRenamed("payload_digest", "_digest"), F.col("_refers").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest"))).drop("_id", "_digest")
    return plain.unionByName(again).select(
        number(F.col("record_id")).alias("page_id"), F.col("_size").alias("payload_bytes"), "payload_digest", "record_type", F.col("_refers").alias("refers_to"), "digest_ok", "path", "at"
    )
