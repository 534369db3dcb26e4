"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: spellings read as a missing number
MISSING_WORDS = ["", "nan", "na", "none", "null"]


def number_or_null(c: Column) -> Column:
    """Parse text to double; the missing spellings, unparseable text and non-finite values become NULL."""
    t = F.lower(F.trim(c))
    v = F.when(~t.isin(MISSING_WORDS), t).try_cast("double")
    return finite(v)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def seeded_uniform(seed: int, *keys) -> Column:
    """Uniform in [0,1) fixed by the seed and the row's keys, whatever the partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def wrap_angle(a: Column) -> Column:
    """Bring an angle difference into [-pi, pi)."""
    two_pi = F.lit(2.0) * F.pi()
    return F.pmod(a + F.pi(), two_pi) - F.pi()


def coalesce_chain(cols: Iterable[Column]) -> Column:
    return F.coalesce(*list(cols))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def log_sum_exp(values: Column) -> Column:
    """ln(sum(exp(v))) over an array, shifted by its maximum."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def entropy_term(p: Column) -> Column:
    return F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0))
