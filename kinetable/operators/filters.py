"""Zero-phase band-pass filtering and outlier-aware resampling of multichannel series.

A recursive filter is linear in its state, so a chunk needs only the state at
its entry.  Each chunk first reports the state it would leave from rest; the
chain of these small vectors fixes every entry state, and the chunk then
filters its own rows.  The backward pass does the same in reverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.plans.chunks import CHUNK, chunk_of, neighbours_known, spread_positions
from kinetable.plans.python import spread
from kinetable.plans.quantiles import exact_quantiles
from kinetable.session import cut_lineage, stored

VALUES = 1 << 20  # numbers that are filtered together


def butterworth_sections(order: int, low: float, high: float, fps: float) -> np.ndarray:
    """order x 6 second-order sections of a digital Butterworth band-pass."""
    if not 0 < low < high < fps / 2:
        raise ValueError(f"the band ({low}, {high}) must lie inside (0, {fps / 2})")
    k = np.arange(order)
    proto = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    w1, w2 = 4 * np.tan(np.pi * low / fps), 4 * np.tan(np.pi * high / fps)
    half, centre = proto * (w2 - w1) / 2, w1 * w2
    root = np.sqrt(half * half - centre + 0j)
    s = np.concatenate([half + root, half - root])
    gain = np.real((w2 - w1) ** order * 4.0**order / np.prod(4.0 - s))
    z = (4.0 + s) / (4.0 - s)
    upper = z[z.imag > 1e-12]
    real = np.sort(z[np.abs(z.imag) <= 1e-12].real)
    den = [[1.0, -2.0 * p.real, abs(p) ** 2] for p in upper] + [[1.0, -(a + b), a * b] for a, b in zip(real[0::2], real[1::2])]
    sos = np.array([[1.0, 0.0, -1.0, *d] for d in den])
    sos[0, :3] *= gain
    return sos


def pad_length(sos: np.ndarray) -> int:
    return 3 * (2 * len(sos) + 1)


def _rest_state(sos: np.ndarray) -> np.ndarray:
    """Section states that hold a constant input of 1 steady."""
    out, level = np.zeros((len(sos), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        y = level * (b0 + b1 + b2) / (1 + a1 + a2)
        out[i, 1] = b2 * level - a2 * y
        out[i, 0] = b1 * level - a1 * y + out[i, 1]
        level = y
    return out


def _filter(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by channels through the cascade from ``state`` (sections x 2 x channels)."""
    y, z = x.copy(), state.copy()
    _filter_many(sos, y, z, np.full(y.shape[1], len(y)))
    return y, z


def _filter_many(sos: np.ndarray, y: np.ndarray, z: np.ndarray, length: np.ndarray) -> None:
    """Time by columns through the cascade, in place; column j ends after ``length[j]`` steps and no column is longer than the one before."""
    live = np.searchsorted(-length, -np.arange(len(y)), side="left")
    for (b0, b1, b2, _, a1, a2), (s0, s1) in zip(sos, z):
        for v, many in zip(y, live.tolist()):
            v, p, q = v[:many], s0[:many], s1[:many]
            o = b0 * v + p
            p[:] = b1 * v - a1 * o + q
            q[:] = b2 * v - a2 * o
            v[:] = o


def _together(n: np.ndarray, width: np.ndarray, values: int = VALUES) -> Iterator[np.ndarray]:
    """Chunks of n rows by width channels to filter together, longest first, in groups of about ``values`` numbers."""
    order = np.argsort(-n, kind="stable")
    at = 0
    while at < len(order):
        most = max(1, int(n[order[at]]))
        upto = at + max(1, int(np.searchsorted(np.cumsum(width[order[at:]]), values // most, side="right")))
        yield order[at:upto]
        at = upto


def _filtered(sos: np.ndarray, chunks: pa.Array, states: list[np.ndarray | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, rows by channels, end state) of every chunk (a list of rows); no state means at rest on the first row."""
    k = len(sos)
    rows = chunks.flatten()
    first = np.concatenate(([0], np.cumsum(chunks.value_lengths().to_numpy(zero_copy_only=False)))).astype("i8")
    cells = np.concatenate(([0], np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False)))).astype("i8")
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(float)
    n = np.diff(first)
    width = (cells[first[1:]] - cells[first[:-1]]) // n
    rest = _rest_state(sos)[:, :, None]
    for group in _together(n, width):
        edge = np.concatenate(([0], np.cumsum(width[group]))).tolist()
        y, z = np.zeros((n[group[0]], edge[-1])), np.empty((k, 2, edge[-1]))
        for i, a, b in zip(group.tolist(), edge, edge[1:]):
            y[: n[i], a:b] = flat[cells[first[i]] : cells[first[i + 1]]].reshape(n[i], -1)
            z[:, :, a:b] = rest * y[0, a:b] if states[i] is None else states[i].reshape(k, 2, -1)
        _filter_many(sos, y, z, np.repeat(n[group], width[group]))
        for i, a, b in zip(group.tolist(), edge, edge[1:]):
            yield i, y[: n[i], a:b], z[:, :, a:b]


def _one_way(rows: DataFrame, sos: np.ndarray, size: int) -> DataFrame:
    """video, m, z, n filtered in the order of m (0, 1, ..., n - 1), started at rest on the first value.

    Recordings of one chunk start at rest; only chunks of longer ones report states and wait for theirs.
    """
    k = len(sos)
    kind = rows.schema["video"].dataType.simpleString()

    def chunks(own: DataFrame) -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct("m", "z")))
        g = own.groupBy("video", chunk_of("m", size).alias("chunk")).agg(packed.alias("p"), F.max("n").alias("n"))
        return spread(g.select("video", "chunk", "n", F.transform("p", lambda e: e["z"]).alias("x")), "video", "chunk")

    alone, tied = chunks(rows.where(F.col("n") <= size)), chunks(rows.where(F.col("n") > size))

    def leave(batches):
        for batch in batches:
            video, chunk, _, x = batch.columns
            lengths, starts = x.value_lengths().to_pylist(), [np.array(v[0].as_py(), float) for v in x]
            ends: list = [None] * len(x)
            for i, _, z in _filtered(sos, x, [np.zeros(2 * k * len(v)) for v in starts]):
                ends[i] = z.ravel()
            columns = [video, chunk, pa.array(lengths, "int64"), pa.array(starts, pa.list_(pa.float64())), pa.array(ends, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["video", "chunk", "len", "x0", "end"])

    s = tied.mapInArrow(leave, f"video {kind}, chunk long, len long, x0 array<double>, end array<double>")
    chains = spread(s.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("chunk", "len", "x0", "end"))).alias("c")))

    def enter(batches):
        carries: dict[int, np.ndarray] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x0 = np.asarray(r.c[0]["x0"], float)
                state = _rest_state(sos)[:, :, None] * x0
                states = []
                for e in r.c:
                    states.append(list(state.ravel()))
                    n = int(e["len"])
                    if n not in carries:
                        carries[n] = _filter(sos, np.zeros((n, 2 * k)), np.eye(2 * k).reshape(k, 2, 2 * k))[1].reshape(2 * k, 2 * k)
                    state = (carries[n] @ state.reshape(2 * k, -1)).reshape(state.shape) + np.asarray(e["end"]).reshape(state.shape)
                yield pd.DataFrame({"video": [r.video] * len(r.c), "chunk": [e["chunk"] for e in r.c], "state": states})

    st = chains.mapInPandas(enter, f"video {kind}, chunk long, state array<double>")

    def run(batches):
        for batch in batches:
            video, chunk, n, x, state = (batch.column(batch.schema.get_field_index(c)) for c in ("video", "chunk", "n", "x", "state"))
            from_row = chunk.to_numpy() * size
            for part in _parts(_filtered(sos, x, [None if v is None else np.array(v, float) for v in state.to_pylist()])):
                at = np.array([i for i, _, _ in part])
                many = [len(y) for _, y, _ in part]
                own = pa.array(np.repeat(at, many))
                m = np.concatenate([np.arange(len(y)) + from_row[i] for i, y, _ in part])
                offsets = np.concatenate(([0], np.cumsum(np.concatenate([np.full(len(y), y.shape[1]) for _, y, _ in part])))).astype("i4")
                z = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([y.ravel() for _, y, _ in part])))
                yield pa.RecordBatch.from_arrays([video.take(own), pa.array(m), z, n.take(own)], ["video", "m", "z", "n"])

    alone = alone.withColumn("state", F.lit(None).cast("array<double>"))
    return alone.unionByName(tied.join(st.hint("merge"), ["video", "chunk"])).mapInArrow(run, f"video {kind}, m long, z array<double>, n long")


def _parts(found: Iterator[tuple], values: int = VALUES) -> Iterator[list[tuple]]:
    """Filtered chunks in lists of about ``values`` numbers."""
    part, held = [], 0
    for one in found:
        part.append(one)
        held += one[1].size
        if held >= values:
            yield part
            part, held = [], 0
    if part:
        yield part


def bandpass(rows: DataFrame, fps: float, low: float, high: float, order: int = 4, size: int = CHUNK) -> DataFrame:
    """video, m, z: zero-phase band-pass of vector rows with m = 0, 1, ...; series of at most the padding length pass as they are.

    Ends are extended by point reflection.  Chunks of many recordings are filtered together, a step of time at once for all of them.
    """
    sos = butterworth_sections(order, low, high, fps)
    pad = pad_length(sos)
    rows = rows.select("video", "m", F.col("z").cast("array<double>").alias("z"))
    n = rows.groupBy("video").agg((F.max("m") + 1).cast("long").alias("n"), F.min_by("z", "m").alias("_a"), F.max_by("z", "m").alias("_b"))
    d = rows.join(n.hint("merge"), "video")
    # one pass: a row's own place, and the places of its reflections about the ends; a short series keeps its own
    m, last, whole = F.col("m"), F.col("n") - 1, F.col("n") > pad
    reflect = lambda end: F.zip_with(end, "z", lambda e, v: 2.0 * e - v)
    places = F.array(
        F.struct((m + F.when(whole, pad).otherwise(0)).alias("m"), F.col("z").alias("z")),
        F.when(whole & (m >= 1) & (m <= pad), F.struct((pad - m).alias("m"), reflect("_a").alias("z"))),
        F.when(whole & (m < last) & (m >= last - pad), F.struct((2 * last - m + pad).alias("m"), reflect("_b").alias("z"))),
    )
    ext = stored(d.select("video", (F.col("n") + F.when(whole, 2 * pad).otherwise(0)).alias("n"), whole.alias("whole"), F.explode(F.filter(places, lambda e: e.isNotNull())).alias("e"))
                      .select("video", "e.m", "e.z", "n", "whole"))
    turn = lambda df: df.select("video", (F.col("n") - 1 - F.col("m")).alias("m"), "z", "n")
    fwd = stored(_one_way(ext.where("whole").drop("whole"), sos, size))
    back = turn(_one_way(turn(fwd), sos, size))
    out = back.where((F.col("m") >= pad) & (F.col("m") < F.col("n") - pad)).select("video", (F.col("m") - pad).alias("m"), "z")
    return out.unionByName(ext.where(~F.col("whole")).select("video", "m", "z"))


def outlier_flags(rows: DataFrame) -> DataFrame:
    """video, dim, m, v, outlier: more than 3 * 1.4826 * MAD + 1e-9 from the channel's median."""
    long = rows.select("video", "m", F.posexplode("z").alias("dim", "v"))
    med = exact_quantiles(long, ["video", "dim"], "v", {"med": 0.5})
    dev = long.join(med, ["video", "dim"]).withColumn("dev", F.abs(F.col("v") - F.col("med")))
    mad = exact_quantiles(dev, ["video", "dim"], "dev", {"mad": 0.5})
    return dev.join(mad, ["video", "dim"]).select("video", "dim", "m", "v", (F.col("dev") > 3 * F.col("mad") * 1.4826 + 1e-9).alias("outlier"))


def filter_walk(rows: DataFrame, src_fps: float, dst_fps: float = 15.0, high_pass: float = 0.01, do_filter: bool = True, size: int = CHUNK) -> DataFrame:
    """video, m, z at the new rate: band-pass, then linear resampling over the rows that are no outliers, flat beyond the kept ones.

    round(F dst / src) rows, at least 2.  Channels with fewer than 2 kept rows
    keep all.  At an unchanged rate the outliers stay.
    """
    if do_filter:
        low = min(dst_fps / 2 - 1e-6, src_fps / 2 - 1e-6)
        rows = cut_lineage(bandpass(rows, src_fps, high_pass, low, size=size))
    if abs(src_fps - dst_fps) < 1e-9:
        return rows
    flags = outlier_flags(rows)
    kept = flags.groupBy("video", "dim").agg(F.count_if(~F.col("outlier")).alias("_kept"), (F.max("m") + 1).alias("n"))
    known = flags.join(kept, ["video", "dim"]).select("video", "dim", "m", F.when(~F.col("outlier") | (F.col("_kept") < 2), F.col("v")).alias("v"))
    near = neighbours_known(known, ["video", "dim"], "m", ["v"], size)
    # value on every source frame, then one target per new frame between two source frames
    p, q = F.col("_prev_v"), F.col("_next_v")
    at = F.coalesce(F.col("v"), p["v"] + (q["v"] - p["v"]) * (F.col("m") - p["p"]) / (q["p"] - p["p"]), p["v"], q["v"])
    full = near.select("video", "dim", "m", at.alias("v"))
    ln = kept.groupBy("video").agg(F.max("n").alias("n"))
    n2 = F.greatest(F.bround(F.col("n") * dst_fps / src_fps).cast("long"), F.lit(2))
    tgt = spread_positions(ln.select("video", "n", F.lit(0).alias("_a"), (n2 - 1).alias("_z")), ["video"], "_a", "_z", "i", size)
    pos = F.col("i") * (F.col("n") - 1) / F.col("_z")
    tgt = tgt.withColumns({"_f": pos - F.floor(pos), "_lo": F.floor(pos), "_hi": F.least(F.floor(pos) + 1, F.col("n") - 1)})
    a = tgt.join(full.select("video", F.col("m").alias("_lo"), "dim", F.col("v").alias("va")), ["video", "_lo"])
    b = a.join(full.select("video", F.col("m").alias("_hi"), "dim", F.col("v").alias("vb")), ["video", "_hi", "dim"])
    v = b.select("video", F.col("i").alias("m"), "dim", (F.col("va") + (F.col("vb") - F.col("va")) * F.col("_f")).alias("v"))
    packed = F.array_sort(F.collect_list(F.struct("dim", "v")))
    return v.groupBy("video", "m").agg(F.transform(packed, lambda e: e["v"]).alias("z"))
