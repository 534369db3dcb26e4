"""Tables of a fixed size that tasks fill in part and Spark merges: counters and bit sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "slice int, task int, cells binary"


def merged(rows: DataFrame, fill: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], cells: int, kind: str, join: np.ufunc, slices: int = 64) -> np.ndarray:
    """One array of ``cells`` numbers: each task fills its own from its rows, slices of them meet in two levels.

    The array has a size fixed by the caller, not by the data, so it may be read at the driver and sent to all tasks.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = np.zeros(cells, kind)
        fill(batches, own)
        parts = [(i, p.tobytes()) for i, p in enumerate(np.split(own, slices)) if p.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in parts], "int32"), pa.array([TaskContext.get().partitionId()] * len(parts), "int32"), pa.array([p for _, p in parts], "binary")],
            ["slice", "task", "cells"],
        )

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(cells // slices, kind)
        for raw in frame["cells"]:
            join(total, np.frombuffer(raw, kind), out=total)
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "task": 0, "cells": [total.tobytes()]})

    parts = rows.mapInArrow(partial, SCHEMA)
    lanes = parts.groupBy("slice", F.pmod("task", F.lit(64)).alias("lane")).applyInPandas(meet, SCHEMA)
    out = np.zeros((slices, cells // slices), kind)
    for r in lanes.groupBy("slice").applyInPandas(meet, SCHEMA).toLocalIterator():
        out[r["slice"]] = np.frombuffer(r["cells"], kind)
    return out.ravel()
