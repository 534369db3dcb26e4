"""Intermediate tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from kinetable.session import ensure_checkpoint_dir, ship_package


class Scratch:
    """A folder of its own under ``spark.checkpoint.dir`` for the tables of one operator call.

    ``keep`` writes a table and reads it back, so later steps neither recompute it nor depend on
    executors that may be lost.  ``drop`` removes a table nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        self.release()
        return self.read(name, df)

    def release(self) -> None:
        """Let the driver notice which shuffles nothing needs any more, so that executors may delete their files."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(docs: DataFrame, wish: str) -> str:
    """``wish``, with underscores before it until no column has the name (case apart)."""
    taken = {c.lower() for c in docs.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def file_uri(path: str) -> str:
    """``file:/a`` as Hadoop prints it, in the form that pyarrow reads."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path
