"""Power spectra of recordings by averaged, overlapping segments, and the spectral lines that clip borders leave.

A row goes to the (at most two) segments that hold it, a segment becomes one row and one transform, and only its
powers travel on.  A long recording is thus spread over as many tasks as it has segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.operators.windows import Geometry, seam_jump

TINY = 1e-12


def welch(rows: DataFrame, fs: float, size: Column, least: int, value: str = "z") -> DataFrame:
    """video, size, bin, frequency, power (mean over dimensions) of recordings of at least ``least`` rows.

    ``size`` gives a segment's length from the recording's length ``n``.  Segments overlap by half (rounded down), lose their
    mean, get a periodic Hann window; powers are one-sided densities, averaged over the recording's segments.
    """
    n = rows.groupBy("video").agg((F.max("m") + 1).alias("n")).where(F.col("n") >= least).withColumn("size", size.cast("long"))
    hop = F.col("size") - F.expr("size div 2")
    d = rows.select("video", "m", F.col(value).alias("v")).join(n, "video").withColumn("hop", hop)
    last = F.least(F.floor(F.col("m") / F.col("hop")), F.floor((F.col("n") - F.col("size")) / F.col("hop")))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("m") - F.col("size")) / F.col("hop")) + 1)
    d = d.where(first <= last).withColumn("segment", F.explode(F.sequence(first, last)))
    segments = d.groupBy("video", "size", "segment").agg(F.array_sort(F.collect_list(F.struct("m", "v"))).alias("rows"))
    kind = rows.schema["video"].dataType.simpleString()

    def transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            powers = []
            for part, k in zip(pdf["v"], pdf["size"]):
                x = np.stack(part).astype(float)
                w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(k) / k)
                p = np.abs(np.fft.rfft((x - x.mean(0)) * w[:, None], axis=0)) ** 2 / (fs * (w * w).sum())
                p[1 : len(p) - (k % 2 == 0)] *= 2
                powers.append(p.mean(1))
            yield pd.DataFrame({"video": pdf["video"], "size": pdf["size"], "powers": powers})

    found = segments.select("video", "size", F.col("rows.v").alias("v")).mapInPandas(transform, f"video {kind}, size long, powers array<double>")
    bins = found.select("video", "size", F.posexplode("powers").alias("bin", "power")).groupBy("video", "size", "bin").agg(F.avg("power").alias("power"))
    return bins.select("video", "size", "bin", (F.col("bin") * fs / F.col("size")).alias("frequency"), "power")


def _bin(h, size: Column, period: int) -> Column:
    """The bin nearest to the h-th harmonic of one cycle in ``period`` rows (the lower of two)."""
    return F.least(F.floor((2 * h * size + (period - 1)) / (2 * period)), F.floor(size / 2)).cast("int")


def line_height(powers: Column, size: Column, h, period: int) -> Column:
    """Power at a harmonic's bin over the median of the (at most six) bins around it that are no harmonic; NULL without such."""
    at = _bin(h, size, period)
    lines = F.array(*[_bin(F.lit(i), size, period) for i in range(1, 6) if 2 * i < period]).cast("array<int>")
    around = F.sequence(F.greatest(at - 3, F.lit(1)), F.greatest(F.least(at + 3, F.size(powers) - 1), F.greatest(at - 3, F.lit(1))))
    free = F.filter(around, lambda i: (i != at) & ~F.array_contains(lines, i) & (i < F.size(powers)))
    near = F.array_sort(F.transform(free, lambda i: F.get(powers, i)))
    k = F.size(near)
    median = (F.get(near, F.floor((k - 1) / 2).cast("int")) + F.get(near, F.floor(k / 2).cast("int"))) / 2
    return F.get(powers, at) / (median + TINY)


def _packed(bins: DataFrame, *keys: str) -> DataFrame:
    """One row of powers a key; a spectrum has as many bins as half a segment."""
    return bins.groupBy(*keys, "size").agg(F.array_sort(F.collect_list(F.struct("bin", "power")))["power"].alias("powers"))


def seam_lines(rows: DataFrame, geom: Geometry, value: str = "z") -> DataFrame:
    """video, ratio: how far each recording's spectrum stands out where clip borders recur (every ``step`` windows).

    Recordings of under two clips of windows are left out, as are those whose bin has no neighbour that is not a harmonic.
    """
    size = F.least(F.col("n"), F.lit(4 * geom.W))
    spectra = _packed(welch(rows, geom.f_win, size, 2 * geom.W, value), "video")
    return spectra.select("video", line_height(F.col("powers"), F.col("size"), F.lit(1), geom.step).alias("ratio")).where("ratio IS NOT NULL")


def seam_diagnostic(rows: DataFrame, geom: Geometry, tol: float = 3.0, value: str = "z") -> DataFrame:
    """One row: border frequency, largest ratio over recordings, number of them, and whether it is below ``tol`` (not so without any)."""
    out = seam_lines(rows, geom, value).agg(F.max("ratio").alias("max_ratio"), F.count("*").alias("recordings"))
    return out.select(F.lit(geom.f_win / geom.step).alias("f_seam"), "max_ratio", "recordings", F.coalesce(F.col("max_ratio") < tol, F.lit(False)).alias("passed"))


def seam_gate(rows: DataFrame, geom: Geometry, stream: str = "pose", jump_tol: float = 1.5, comb_tol: float = 3.0, least_lines: int = 2) -> DataFrame:
    """One row: border step over inner step, heights at the harmonics of one cycle a clip, lines above ``comb_tol``, and the verdict.

    The spectrum is the mean over recordings of at least four clips of windows.  It passes with a jump below ``jump_tol`` and
    fewer than ``least_lines`` lines.
    """
    size = 4 * geom.W
    spectra = welch(rows, geom.f_win, F.lit(size), size)
    mean = _packed(spectra.groupBy("size", "bin").agg(F.avg("power").alias("power")))
    heights = F.array(*[line_height(F.col("powers"), F.lit(size), F.lit(h), geom.W) for h in range(1, 6) if 2 * h < geom.W]).cast("array<double>")
    lines = mean.select(heights.alias("harmonics"))
    jump = seam_jump(rows, geom, stream).select(F.col("ratio").alias("jump"))  # one row, as are the lines
    both = jump.join(F.broadcast(lines), F.lit(True), "left")
    n = F.coalesce(F.size(F.filter("harmonics", lambda x: x > comb_tol)), F.lit(0))
    n = F.when(F.col("harmonics").isNull(), 0).otherwise(n)
    return both.select("jump", "harmonics", n.alias("n_lines"), ((F.col("jump") < jump_tol) & (n < least_lines)).alias("passed"))
