"""Window ids that are pure per-row projections, so they also run on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.operators.windows import time_block


def with_blocks(rows: DataFrame, fps: float, seconds: float, frame: str = "start_frame") -> DataFrame:
    """Add ``block``: the time block of each clip start."""
    return rows.withColumn("block", time_block(F.col(frame), fps, seconds))


def with_clips(rows: DataFrame, T: int, stride: int, frame: str = "frame") -> DataFrame:
    """Add start_frame and t for each clip that may hold the frame; whether a clip is full is known only at the end."""
    f = F.col(frame)
    first = F.greatest(F.floor((f - T + stride) / stride), F.lit(0))
    k = F.explode(F.sequence(first, F.floor(f / stride)))
    return rows.withColumn("_k", k).withColumn("start_frame", F.col("_k") * stride).withColumn("t", f - F.col("start_frame")).drop("_k")
