"""Exact deduplication as a stateful stream over disk-backed keyed state.

The stream carries narrow records: digest of the normalised text, document id, row number and content locator
(the file the row was read from).  A streaming aggregation keyed by digest keeps, in RocksDB and without expiry, the
record that stays and the number of rows seen.  Each micro-batch lands the groups it changed; the newest landing of a
digest is its state.  Rows of digests with more than one row (hits) are then grouped by their full normalised bytes;
a digest that covers different texts is split by those bytes, so a digest never decides alone.

Everything is DataFrame code.  Copies are combined before the state shuffle, so a text that makes up a third of
the rows costs one record per task there; the join back to rows has unique keys on its small side and can be split.

Defined cases: null text is the empty text.  Null doc_id sorts below every other id.  Among rows equal in text and
doc_id (repeated rows) one is kept.  An empty table gives an empty result.  Columns other than the two named are not
read, and may have any name.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, free_name

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

MAP_BITS, MAPS = 1 << 15, 1 << 12  # Spark's bitmaps hold 32768 bits


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes empty.  Pure ASCII takes the fast built-in."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stream_groups(keys: DataFrame, scratch: Scratch, source: str, files_per_batch: int) -> DataFrame:
    """Run the keyed stream over the records written at ``source``; the state as (digest, keep, group_size)."""
    spark = keys.sparkSession
    landed = scratch.path("landed")
    stream = spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", files_per_batch).parquet(scratch.path(source))
    state = stream.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row_no", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{landed}/batch={number}")

    with settings(spark, STATE):
        query = (
            state.writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", scratch.path("stream")).foreachBatch(land).start()
        )
        query.awaitTermination()
    rows = spark.read.schema(state.schema.add("batch", "long")).option("basePath", landed).parquet(f"{landed}/batch=*") if query.lastProgress else None
    if rows is None:
        return spark.createDataFrame([], state.schema)
    return rows.groupBy("digest").agg(F.max(F.struct("batch", "keep", "group_size")).alias("s")).select("digest", "s.keep", "s.group_size")


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 10_000,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (see the module text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact_dedup")
    norm = ascii_lower(F.col(text))
    records = docs.select(
        F.col(doc_id).alias("doc_id"), digest(norm).alias("digest"), F.monotonically_increasing_id().alias("row_no"),
        F.input_file_name().alias("locator"),
    )
    keys = scratch.keep(records, "records")
    groups = scratch.keep(stream_groups(keys, scratch, "records", files_per_batch), "groups")
    scratch.drop("landed", "stream")

    full = docs.select(digest(norm).alias("digest"), norm.alias("norm"))
    full = maybe_among(full, "digest", groups.where("group_size > 1").select("digest")).where("maybe")
    texts = full.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    mixed = scratch.keep(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "mixed")

    plain = keys.join(groups, "digest")
    out = plain.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("keep.row_no")).alias("kept"), "digest",
    )
    if mixed.isEmpty():
        return out
    return out.join(mixed, "digest", "left_anti").unionByName(_split_by_text(docs, doc_id, norm, digest, mixed))


def maybe_among(rows: DataFrame, column: str, values: DataFrame, flag: str = "maybe") -> DataFrame:
    """Rows with ``flag``: false only where ``column`` is surely none of the distinct ``values`` (one column of the same name or another).

    Hashes of the values set bits in bitmaps that are sent to every task: about 16 bits a value, 16 MB at most, beyond which
    more rows are flagged.  So rows without the flag need no shuffle, and those with it meet the values themselves.
    """
    many = max(1, min(MAPS, -(-16 * values.count() // MAP_BITS)))
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(many * MAP_BITS))
    own = spot(F.col(values.columns[0]))
    bits = values.groupBy(F.floor(own / MAP_BITS).alias(f"{flag}_map")).agg(F.bitmap_construct_agg(own % MAP_BITS).alias(f"{flag}_bits"))
    at = spot(F.col(column))
    byte = F.conv(F.hex(F.substring(F.col(f"{flag}_bits"), (F.floor(at % MAP_BITS / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    one = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8 + 1).cast("int"))
    met = rows.withColumn(f"{flag}_at", F.floor(at / MAP_BITS)).join(F.broadcast(bits), F.col(f"{flag}_at") == F.col(f"{flag}_map"), "left")
    return met.select(*rows.columns, F.coalesce(byte.bitwiseAND(one) != 0, F.lit(False)).alias(flag))


def _split_by_text(docs: DataFrame, doc_id: str, norm: Column, digest: Callable[[Column], Column], mixed: DataFrame) -> DataFrame:
    """Groups by full text for the digests that cover several texts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm"), digest(norm).alias("digest"), F.monotonically_increasing_id().alias("row_no"))
    rows = rows.join(mixed, "digest", "left_semi")
    rows = Scratch(docs.sparkSession, "exact_dedup_split").keep(rows, "rows")
    groups = rows.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "row_no")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["digest", "norm"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("keep.row_no")).alias("kept"), "digest",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the rows another equal text replaces; columns as given."""
    mark = free_name(docs, "_digest")
    scratch = Scratch(docs.sparkSession, "drop_copies")
    hits = scratch.keep(exact_groups(docs, doc_id, text).where("group_size > 1").select("doc_id", "digest", "kept"), "hits")
    gone = hits.groupBy("doc_id", "digest").agg(F.bool_or("kept").alias("kept")).where("NOT kept")
    gone = gone.select(F.col("doc_id").alias(f"{mark}_gone_id"), F.col("digest").alias(f"{mark}_gone"))
    # only rows that may be copies are shuffled with their texts
    marked = maybe_among(docs.withColumn(mark, sha256(ascii_lower(F.col(text)))), mark, hits.select("digest").distinct(), f"{mark}_maybe")
    alone, some = marked.where(~F.col(f"{mark}_maybe")), marked.where(f"{mark}_maybe")
    some = some.join(gone, F.col(doc_id).eqNullSafe(F.col(f"{mark}_gone_id")) & (F.col(mark) == F.col(f"{mark}_gone")), "left_anti")
    return alone.select(*docs.columns).unionByName(some.dropDuplicates([doc_id, mark]).select(*docs.columns))
