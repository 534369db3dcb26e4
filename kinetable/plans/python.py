"""Small helpers around Arrow-batched Python work."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, *keys) -> DataFrame:
    """Hash rows over the session's shuffle partitions before CPU-heavy Python.

    Python work costs far more per byte than a scan, so size-based partition
    merging would leave it on a few cores; a fixed count is not merged.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if keys else df.repartition(n)


def schema_of(df: DataFrame, columns: Sequence[str], *more: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([f"{c} {kinds[c]}" for c in columns] + list(more))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside; for rows that are large by themselves."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
