"""Registered queries: a Spark callable and, where SQL can say it, the same answer in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, ints: str = "", doubles: str = "", texts: str = "", sql: str | None = None, digits: int = DIGITS):
    """Decorator.  The output columns are fixed as BIGINT / DOUBLE (rounded) / VARCHAR on both sides."""
    i, d, t = ints.split(), doubles.split(), texts.split()

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(
                *[F.col(c).cast("string").alias(c) for c in t],
                *[F.col(c).cast("long").alias(c) for c in i],
                *[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in d],
            )

        body = None
        if sql is not None:
            cols = [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in t]
            cols += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in i]
            cols += [f'round(CAST("{c}" AS DOUBLE), {digits}) + 0.0 AS "{c}"' for c in d]
            body = f"SELECT {', '.join(cols)} FROM ({sql}) AS q"
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, run, body)
        return fn

    return wrap
