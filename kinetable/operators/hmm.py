"""Hidden state models fitted by distributed EM: Gaussian, autoregressive and categorical emissions.

A sequence row holds one bounded chunk of one recording.  A long recording is
handled exactly: each chunk first returns its K x K transfer matrix, the chain
of these small matrices gives every chunk its incoming and outgoing message,
and the chunk then computes its own expected counts.  All candidate models
(K, held-out fold, restart) run in the same job; each partition returns one sum
per model, and the M-step works on those sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetable.functions.assignment import assign
from kinetable.functions.scalar import seeded_uniform
from kinetable.plans.chunks import CHUNK, with_halo
from kinetable.plans.python import spread
from kinetable.session import cut_lineage

FLOOR = 1e-3
ROWS = 1 << 16  # rows of chunks that advance together
BESIDE = 16  # models worked through side by side
COVARIANCES = ("full", "tied", "diag", "spherical")


@dataclass
class Model:
    """One candidate: settings and current parameters."""

    k: int
    kind: str = "gaussian"  # gaussian / ar / categorical
    covariance: str = "full"
    lags: int = 0
    fold: int | None = None
    seed: int = 0
    n_symbols: int = 0
    pi: np.ndarray | None = None
    a: np.ndarray | None = None
    mean: np.ndarray | None = None
    cov: np.ndarray | None = None
    w: np.ndarray | None = None  # autoregressive weights, K x (L d + 1) x d
    emit: np.ndarray | None = None
    loglik: float = -math.inf
    n_train: int = 0
    history: list = field(default_factory=list)
    done: bool = False
    floor: float | None = None  # added to covariances; None takes the fit's

    def n_params(self, d: int) -> int:
        k = self.k
        if self.kind == "categorical":
            return k * k + k * self.n_symbols + k
        if self.kind == "ar":
            return (k - 1) + k * (k - 1) + k * (self.lags * d + 1) * d + k * d * (d + 1) // 2 + k * d
        cov = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[self.covariance]
        return (k - 1) + k * (k - 1) + k * d + cov


def sequence_chunks(rows: DataFrame, value: str = "z", lags: int = 0, folds: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """video, chunk, fold, context (rows before the chunk that autoregression needs), x: written once and read each iteration."""
    d = rows.select("video", "m", F.col(value).alias("v"))
    h = with_halo(d, "m", before=lags, after=0, size=size)
    packed = F.array_sort(F.collect_list(F.struct("_home", "m", "v")))
    g = h.groupBy("video", F.col("_chunk").alias("chunk")).agg(packed.alias("p")).where(F.exists("p", lambda e: e["_home"]))
    pick = lambda flag: F.transform(F.filter("p", lambda e: e["_home"] == flag), lambda e: e["v"])
    g = g.select("video", "chunk", pick(False).alias("context"), pick(True).alias("x"))
    g = g.join(folds, "video") if folds is not None else g.withColumn("fold", F.lit(-1))
    return cut_lineage(spread(g, "video", "chunk"))


def _gauss_log(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Row log densities; ``mean`` is one vector or one per row."""
    low = np.linalg.cholesky(cov)
    y = np.linalg.solve(low, (x - mean).T)
    return -0.5 * ((y * y).sum(0) + x.shape[1] * math.log(2 * math.pi)) - np.log(np.diag(low)).sum()


def _design(x: np.ndarray, ctx: np.ndarray, lags: int) -> np.ndarray:
    """[x_{t-1} ... x_{t-L}, 1] per row; rows without a full past hold NaN."""
    full = np.vstack([ctx, x]) if len(ctx) else x
    off = len(full) - len(x)
    cols = []
    for j in range(1, lags + 1):
        s = np.full_like(x, np.nan)
        first = max(0, j - off)
        s[first:] = full[off + first - j: len(full) - j]
        cols.append(s)
    return np.hstack([*cols, np.ones((len(x), 1))])


def _designs(x: np.ndarray, ctx: list[np.ndarray], first: np.ndarray, lags: int) -> np.ndarray:
    """The same for chunks that lie one after the other in ``x``."""
    return np.vstack([_design(x[a:b], c, lags) for a, b, c in zip(first[:-1], first[1:], ctx)])


def _emission(m: Model, x: np.ndarray, ctx: np.ndarray, z: np.ndarray | None = None) -> np.ndarray:
    """Rows by states; ``z`` may bring the design of autoregression."""
    if m.kind == "categorical":
        return np.log(np.maximum(m.emit[:, x.astype(int).ravel()].T, 1e-300))
    if m.kind == "ar":
        z = _design(x, ctx, m.lags) if z is None else z
        ok = np.isfinite(z).all(1)
        out = np.stack([_gauss_log(x, m.mean[k], m.cov[k]) for k in range(m.k)], 1)
        for k in range(m.k):
            if ok.any():
                out[ok, k] = _gauss_log(x[ok], z[ok] @ m.w[k], m.cov[k])
        return out
    return np.stack([_gauss_log(x, m.mean[k], m.cov[k]) for k in range(m.k)], 1)


def _arrays(row) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([np.atleast_1d(v) for v in row.x], float)
    c = np.array([np.atleast_1d(v) for v in row.context], float) if len(row.context) else np.zeros((0, x.shape[1]))
    return x, c


def _nested(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all chunks, and the row at which each chunk begins (and the end); a row is a number or a list of them."""
    first = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype("i8")
    rows = column.flatten()
    if pa.types.is_list(rows.type) or pa.types.is_large_list(rows.type):
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        return flat.astype(float).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0)), first
    return rows.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), 1), first


def _slices(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Chunks in slices of about ``rows`` rows, one chunk at least."""
    size = np.cumsum(batch.column(batch.schema.get_field_index("x")).value_lengths().to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + rows, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


@dataclass
class Chunks:
    """Chunks one after the other: their rows, where each begins (and the end), the rows before them, number and fold."""

    x: np.ndarray
    first: np.ndarray
    ctx: list[np.ndarray]
    chunk: np.ndarray
    fold: np.ndarray
    designs: dict[int, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def read(batch: pa.RecordBatch) -> Chunks:
        col = lambda name: batch.column(batch.schema.get_field_index(name))
        x, first = _nested(col("x"))
        before, at = _nested(col("context"))
        ctx = [before[a:b] if b > a else np.zeros((0, x.shape[1])) for a, b in zip(at[:-1], at[1:])]
        return Chunks(x, first, ctx, col("chunk").to_numpy(), col("fold").to_numpy())

    def some(self, keep: np.ndarray) -> Chunks:
        """The chunks that ``keep`` marks."""
        if keep.all():
            return self
        n = np.diff(self.first)
        rows = np.repeat(keep, n)
        first = np.concatenate(([0], np.cumsum(n[keep])))
        designs = {lags: z[rows] for lags, z in self.designs.items()}
        return Chunks(self.x[rows], first, [c for c, k in zip(self.ctx, keep) if k], self.chunk[keep], self.fold[keep], designs)

    def design(self, m: Model) -> np.ndarray | None:
        if m.kind != "ar":
            return None
        if m.lags not in self.designs:
            self.designs[m.lags] = _designs(self.x, self.ctx, self.first, m.lags)
        return self.designs[m.lags]


def _transfers(models: list[Model], logb: np.ndarray, first: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """models x chunks x K x K: for each chunk the product of (transition, emission) over its rows, scaled to a maximum of 1.

    ``logb`` is models x rows x K; the models have one K.  A chunk that opens a recording starts by the emission of its first
    row.  All chunks of all models advance together, as in ``_forward_backward``.
    """
    n, k = np.diff(first), models[0].k
    order = np.argsort(-n, kind="stable")
    start, n, opening = first[:-1][order], n[order], begins[order]
    live = np.searchsorted(-n, -np.arange(n[0]), side="left")
    b, a = np.exp(logb - logb.max(2, keepdims=True)), np.stack([m.a for m in models])
    out = np.empty((len(models), len(n), k, k))
    out[:] = a[:, None]
    out[:, opening] = np.eye(k)
    for t, many in enumerate(live.tolist()):
        o = out[:, :many] if t == 0 else np.matmul(out[:, :many], a[:, None])
        o = o * b[:, start[:many] + t][:, :, None, :]
        out[:, :many] = o / o.max((2, 3), keepdims=True)
    back = np.empty_like(out)
    back[:, order] = out
    return back


def _messages(seqs: DataFrame, models: list[Model]) -> DataFrame | None:
    """video, chunk, msgs: incoming and outgoing message of every model; None if each recording is one chunk."""
    if seqs.agg(F.max("chunk")).first()[0] == 0:
        return None
    b = seqs.sparkSession.sparkContext.broadcast(models)

    def transfer(batches):
        for batch in batches:
            for part in _slices(batch):
                d = Chunks.read(part)
                mats: list[np.ndarray | None] = [None] * len(b.value)
                for own in _together(b.value):
                    same = [b.value[i] for i in own]
                    logb = np.stack([_emission(m, d.x, None, d.design(m)) for m in same])
                    for i, mat in zip(own, _transfers(same, logb, d.first, d.chunk == 0)):
                        mats[i] = mat.reshape(len(part), -1)
                rows = [[mat[j].tolist() for mat in mats] for j in range(len(part))]
                names = [part.column(part.schema.get_field_index(c)) for c in ("video", "chunk")]
                yield pa.RecordBatch.from_arrays([*names, pa.array(rows, pa.list_(pa.list_(pa.float64())))], ["video", "chunk", "mats"])

    kind = seqs.schema["video"].dataType.simpleString()
    t = seqs.mapInArrow(transfer, f"video {kind}, chunk long, mats array<array<double>>")
    chains = spread(t.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("chunk", "mats"))).alias("c")))

    def pass_on(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                chunks = [e["chunk"] for e in r.c]
                ins, outs = [[] for _ in chunks], [[] for _ in chunks]
                for i, m in enumerate(b.value):
                    mats = [np.asarray(e["mats"][i]).reshape(m.k, m.k) for e in r.c]
                    v = m.pi
                    for j, mat in enumerate(mats):
                        ins[j].append(list(v))
                        v = v @ mat
                        v = v / v.sum()
                    u = np.ones(m.k)
                    for j in range(len(mats) - 1, -1, -1):
                        outs[j].append(list(u))
                        u = mats[j] @ u
                        u = u / u.max()
                yield pd.DataFrame({"video": [r.video] * len(chunks), "chunk": chunks, "ins": ins, "outs": outs})

    return chains.mapInPandas(pass_on, f"video {kind}, chunk long, ins array<array<double>>, outs array<array<double>>")


def _forward_backward(m: Model, logb: np.ndarray, first: np.ndarray, begins: np.ndarray, vin: np.ndarray, vout: np.ndarray):
    """State weights per row, summed transition weights and each chunk's log-likelihood increment.

    Chunks lie one after the other and begin at the rows ``first`` (and the end); ``begins`` marks those that open a recording.
    """
    g, w, ll = _forward_backwards([m], logb[None], first, begins, vin[None], vout[None])
    return g[0], w[0].sum(0), ll[0]


def _forward_backwards(models: list[Model], logb: np.ndarray, first: np.ndarray, begins: np.ndarray, vin: np.ndarray, vout: np.ndarray):
    """The same for models of one K side by side, with the transition weights of each row that follows another.

    All chunks of all models advance together, a step of time at once, the longest first, so that those still running are the
    leading ones.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, n = first[:-1][order], n[order]
    live = np.searchsorted(-n, -np.arange(n[0]), side="left")
    a = np.stack([m.a for m in models])
    back = np.ascontiguousarray(a.transpose(0, 2, 1))
    top = logb.max(2)
    b = np.exp(logb - top[:, :, None])
    alpha, c, came = np.empty_like(b), np.empty(b.shape[:2]), np.empty_like(b)
    prev, opening = vin[:, order], begins[order]
    for t, many in enumerate(live.tolist()):
        at = start[:many] + t
        came[:, at] = prev[:, :many]
        into = prev[:, :many] @ a
        if t == 0:
            into[:, opening] = prev[:, opening]
        v = into * b[:, at]
        c[:, at] = s = v.sum(2)
        alpha[:, at] = prev = v / s[:, :, None]
    beta = np.empty_like(b)
    beta[:, start + n - 1] = vout[:, order]
    for t in range(n[0] - 2, -1, -1):
        at = start[: live[t + 1]] + t
        beta[:, at] = (b[:, at + 1] * beta[:, at + 1]) @ back / c[:, at + 1, None]
    g = alpha * beta
    g /= g.sum(2, keepdims=True)
    moved = _moved(first, begins)
    w = came[:, moved][:, :, :, None] * a[:, None] * (b * beta)[:, moved][:, :, None, :]
    return g, w / w.sum((2, 3), keepdims=True), np.add.reduceat(np.log(c) + top, first[:-1], axis=1)


def _moved(first: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The rows that follow a row of their recording."""
    moved = np.ones(first[-1], bool)
    moved[first[:-1][begins]] = False
    return moved


def _seconds(g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each state the weighted sum of products of the coordinates of x and y."""
    return np.stack([(x.T * w) @ y for w in np.ascontiguousarray(g.T)])


def _counts(m: Model, d: Chunks, g: np.ndarray, xi: np.ndarray) -> dict[str, np.ndarray]:
    x = d.x
    s = {"xi": xi, "g": g.sum(0), "g0": g[d.first[:-1][d.chunk == 0]].sum(0)}
    if m.kind == "categorical":
        s["sym"] = g.T @ np.eye(m.n_symbols)[x.astype(int).ravel()]
        return s
    s["x"] = g.T @ x
    s["xx"] = _seconds(g, x, x)
    if m.kind == "ar":
        z = d.design(m)
        ok = np.isfinite(z).all(1)
        zz, gg, xo = z[ok], g[ok], x[ok]
        s.update(gr=gg.sum(0), zz=_seconds(gg, zz, zz), zx=_seconds(gg, zz, xo), rxx=_seconds(gg, xo, xo))
        s.update(h=g[~ok].sum(0), hx=g[~ok].T @ x[~ok], hxx=_seconds(g[~ok], x[~ok], x[~ok]))
    return s


def _together(models: list[Model]) -> Iterator[list[int]]:
    """Models of one K, at most ``BESIDE`` at once."""
    for k in sorted({m.k for m in models}):
        own = [i for i, m in enumerate(models) if m.k == k]
        yield from (own[s:s + BESIDE] for s in range(0, len(own), BESIDE))


def _trained(models: list[Model], d: Chunks, ins: list | None, outs: list | None) -> Iterator[tuple[int, dict]]:
    """Statistics of each model over the chunks outside its fold; the chunks inside are worked through with them and left out."""
    rows = np.diff(d.first)
    begins = d.chunk == 0
    for own in _together(models):
        same = [models[i] for i in own]
        vin = np.array([np.tile(m.pi, (len(rows), 1)) if ins is None else [m.pi if new else e[i] for new, e in zip(begins, ins)] for i, m in zip(own, same)], float)
        vout = np.ones_like(vin) if outs is None else np.array([[e[i] for e in outs] for i in own], float)
        logb = np.stack([_emission(m, d.x, None, d.design(m)) for m in same])
        g, w, ll = _forward_backwards(same, logb, d.first, begins, vin, vout)
        for i, m, gm, wm, lm in zip(own, same, g, w, ll):
            keep = np.ones(len(rows), bool) if m.fold is None else d.fold != m.fold
            if keep.any():
                kept, some = np.repeat(keep, rows), d.some(keep)
                xi = wm[kept[_moved(d.first, begins)]].sum(0)
                yield i, {"ll": np.array([lm[keep].sum()]), "n": np.array([float(len(some.x))])} | _counts(m, some, gm[kept], xi)


def _held_out(models: list[Model], chunks: Chunks, ins: list | None, outs: list | None) -> Iterator[tuple[int, dict]]:
    """Log-likelihood and rows of each model over the chunks of its fold."""
    for i, m in enumerate(models):
        keep = np.full(len(chunks.chunk), False) if m.fold is None else chunks.fold == m.fold
        if keep.any():
            d, own = chunks.some(keep), np.flatnonzero(keep)
            vin = np.tile(m.pi, (len(own), 1)) if ins is None else np.array([m.pi if chunks.chunk[j] == 0 else ins[j][i] for j in own])
            vout = np.ones((len(own), m.k)) if outs is None else np.array([outs[j][i] for j in own])
            _, _, ll = _forward_backward(m, _emission(m, d.x, None, d.design(m)), d.first, d.chunk == 0, vin, vout)
            yield i, {"ll": np.array([ll.sum()]), "n": np.array([float(len(d.x))])}


def expected_counts(seqs: DataFrame, models: list[Model], score_held_out: bool = False) -> list[dict]:
    """One dict of summed statistics per model, with loglik and row count over its training (or held-out) recordings."""
    msgs = _messages(seqs, models)
    d = seqs if msgs is None else seqs.join(msgs, ["video", "chunk"])
    whole = msgs is None
    b = seqs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        total: list[dict | None] = [None] * len(b.value)
        for batch in batches:
            for part in _slices(batch):
                chunks = Chunks.read(part)
                ins, outs = (None, None) if whole else (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("ins", "outs"))
                for i, s in (_held_out if score_held_out else _trained)(b.value, chunks, ins, outs):
                    total[i] = s if total[i] is None else {k: total[i][k] + s[k] for k in s}
        found = [(i, k, np.ravel(v).tolist()) for i, t in enumerate(total) if t is not None for k, v in t.items()]
        if found:
            yield pa.RecordBatch.from_pydict(dict(zip(("model", "stat", "v"), map(list, zip(*found)))), pa.schema([("model", pa.int32()), ("stat", pa.string()), ("v", pa.list_(pa.float64()))]))

    got = d.mapInArrow(run, "model int, stat string, v array<double>")
    # partitions bring one row per model and statistic; sums of K, K x K and K x d x d numbers reach the driver
    flat = got.select("model", "stat", F.posexplode("v").alias("i", "x")).groupBy("model", "stat", "i").agg(F.sum("x").alias("x")).toPandas()
    out: list[dict] = [{} for _ in models]
    for (i, stat), part in flat.groupby(["model", "stat"]):
        out[i][stat] = part.sort_values("i")["x"].to_numpy()
    return out


def _update(m: Model, s: dict, d: int, floor: float) -> Model:
    k = m.k
    g = np.maximum(s["g"], 1e-12)
    pi = s["g0"] / max(s["g0"].sum(), 1e-300)
    a = s["xi"].reshape(k, k) + 1e-6
    a /= a.sum(1, keepdims=True)
    if m.kind == "categorical":
        e = s["sym"].reshape(k, -1) + 1e-9
        return replace(m, pi=pi, a=a, emit=e / e.sum(1, keepdims=True))
    mean = s["x"].reshape(k, d) / g[:, None]
    if m.kind == "ar":
        p = m.lags * d + 1
        zz, zx, rxx = s["zz"].reshape(k, p, p), s["zx"].reshape(k, p, d), s["rxx"].reshape(k, d, d)
        w = np.stack([np.linalg.solve(zz[j] + 1e-3 * np.eye(p), zx[j]) for j in range(k)])
        res = np.stack([rxx[j] - w[j].T @ zx[j] - zx[j].T @ w[j] + w[j].T @ zz[j] @ w[j] for j in range(k)])
        cov = res / np.maximum(s["gr"], 1e-12)[:, None, None] + floor * np.eye(d)
        h = s["h"]
        start = np.where(h[:, None] > 1e-8, s["hx"].reshape(k, d) / np.maximum(h, 1e-8)[:, None], mean)
        return replace(m, pi=pi, a=a, w=w, cov=(cov + cov.transpose(0, 2, 1)) / 2, mean=start)
    cov = s["xx"].reshape(k, d, d) / g[:, None, None] - np.einsum("ki,kj->kij", mean, mean)
    if m.covariance == "tied":
        cov = np.repeat((cov * g[:, None, None]).sum(0, keepdims=True) / g.sum(), k, axis=0)
    elif m.covariance == "diag":
        cov = cov * np.eye(d)
    elif m.covariance == "spherical":
        cov = np.einsum("kii->k", cov)[:, None, None] / d * np.eye(d)
    return replace(m, pi=pi, a=a, mean=mean, cov=(cov + cov.transpose(0, 2, 1)) / 2 + floor * np.eye(d))


def _start(m: Model, centres: np.ndarray | None, spread_: np.ndarray | None, floor: float) -> Model:
    """Emissions from k-means centres and the covariance of all rows; a sticky chain."""
    rng = np.random.default_rng([m.seed, m.k])
    k = m.k
    a = np.full((k, k), 0.1 / max(k - 1, 1)) if k > 1 else np.ones((1, 1))
    np.fill_diagonal(a, 0.9 if k > 1 else 1.0)
    pi = np.full(k, 1.0 / k)
    if m.kind == "categorical":
        return replace(m, pi=pi, a=a, emit=rng.dirichlet(np.ones(m.n_symbols), k))
    d = centres.shape[1]
    cov = np.repeat((spread_ + floor * np.eye(d))[None], k, axis=0)
    w = np.zeros((k, m.lags * d + 1, d))
    w[:, -1, :] = centres
    return replace(m, pi=pi, a=a, mean=centres, cov=cov, w=w if m.kind == "ar" else None)


def _centres(seqs: DataFrame, wanted: set[tuple[int, int]], rounds: int = 10) -> tuple[dict[tuple[int, int], np.ndarray], np.ndarray]:
    """k-means centres for each (k, seed) over all rows, every candidate in one pass a round, and the covariance of all rows.

    Starts are k rows picked by a hash of their place (recording, chunk, row), not of their value.
    """
    rows = seqs.select("video", "chunk", F.posexplode("x").alias("at", "v"))
    keys = sorted(wanted)
    now = {}
    for k, seed in keys:
        got = rows.orderBy(seeded_uniform(seed, "video", "chunk", "at"), "video", "chunk", "at").limit(k).collect()
        c = np.array([np.atleast_1d(r["v"]) for r in got], float)
        now[k, seed] = c[np.arange(k) % len(c)]
    d = next(iter(now.values())).shape[1]

    def sums(batches, now=now):
        n = {key: np.zeros((key[0], d + 1)) for key in keys}
        total = np.zeros((1 + d, 1 + d))
        for batch in batches:
            for part in _slices(batch):
                x = _nested(part.column(0))[0]
                one = np.column_stack([np.ones(len(x)), x])
                total += one.T @ one
                for key, c in now.items():
                    near = np.stack([((x - v) ** 2).sum(1) for v in c]).argmin(0)
                    n[key] += np.column_stack([np.bincount(near, v, key[0]) for v in one.T])
        found = [*(n[key].ravel() for key in keys), total.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(keys)), -1], "int32"), pa.array(found, pa.list_(pa.float64()))], ["key", "s"])

    cov = None
    for _ in range(rounds):
        parts = seqs.select("x").mapInArrow(lambda b, f=sums, c=now: f(b, c), "key int, s array<double>")
        got = parts.select("key", F.posexplode("s").alias("i", "v")).groupBy("key", "i").agg(F.sum("v").alias("v")).toPandas()
        by = {key: g.sort_values("i")["v"].to_numpy() for key, g in got.groupby("key")}
        total = by[-1].reshape(1 + d, 1 + d) / by[-1][0]
        cov = total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:])
        new = {}
        for i, key in enumerate(keys):
            s = by[i].reshape(key[0], d + 1)
            new[key] = np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1), now[key])
        same = all(np.allclose(new[key], now[key], atol=1e-9) for key in keys)
        now = new
        if same:
            break
    return now, cov


def fit(seqs: DataFrame, models: Sequence[Model], n_iter: int = 50, tol: float = 1e-4, floor: float = FLOOR) -> list[Model]:
    """EM for every candidate at once.

    The log-likelihood belongs to the parameters that were scored, so these are
    the ones returned; a model stops when its gain falls under tol * |previous|.
    """
    fresh = {(m.k, m.seed) for m in models if m.a is None and m.kind != "categorical"}
    centres, spread_ = _centres(seqs, fresh) if fresh else ({}, None)
    d = spread_.shape[0] if spread_ is not None else next((m.mean.shape[1] for m in models if m.mean is not None), 1)
    own = lambda m: floor if m.floor is None else m.floor
    models = [m if m.a is not None else _start(m, centres.get((m.k, m.seed)), spread_, own(m)) for m in models]
    for it in range(n_iter):
        live = [i for i, m in enumerate(models) if not m.done]
        if not live:
            break
        stats = expected_counts(seqs, [models[i] for i in live])
        for i, s in zip(live, stats):
            m = models[i]
            ll = float(s["ll"][0])
            gain = ll - m.loglik
            m = replace(m, loglik=ll, n_train=int(s["n"][0]), history=[*m.history, ll])
            if (it >= 2 and gain < tol * abs(ll - gain)) or it == n_iter - 1:
                models[i] = replace(m, done=True)
            else:
                models[i] = _update(m, s, d, own(m))
    return list(models)


@dataclass
class Guarded:
    """A fitted model with the settings tried on the way: one dict an attempt."""

    model: Model
    attempts: list[dict]


def allowed_states(seqs: DataFrame, ks: Sequence[int]) -> list[int]:
    """The K that data can carry: at most one a recording, and at least five rows a state."""
    videos, rows = seqs.agg(F.count_distinct("video"), F.sum(F.size("x"))).first()
    most = max(2, min(videos, (rows or 0) // 5))
    out = [k for k in ks if 2 <= k <= most]
    if not out:
        raise ValueError(f"{rows} rows in {videos} recordings allow no number of states in {list(ks)}")
    return out


def leave_one_out(rows: DataFrame) -> DataFrame:
    """video, fold: every recording is a fold of its own."""
    videos = rows.select("video").distinct()
    return videos.select("video", (F.row_number().over(W.orderBy("video")) - 1).alias("fold"))  # one row a recording


def state_conditions(m: Model) -> np.ndarray:
    """Largest over smallest eigenvalue of each state's covariance."""
    e = np.linalg.eigvalsh(m.cov)
    return e.max(1) / np.maximum(e.min(1), 1e-30)


def _occupancy(seqs: DataFrame, m: Model) -> np.ndarray:
    """Rows of each state on the most likely paths."""
    n = np.zeros(m.k)
    for r in viterbi(seqs, m).groupBy("state").agg(F.count("*").alias("n")).collect():
        n[r["state"]] = r["n"]
    return n


def fit_guarded(
    seqs: DataFrame, ks: Sequence[int], restarts: int = 5, covariance: str = "full", floor: float = FLOOR, n_iter: int = 200, tol: float = 1e-4,
    most_condition: float = 1e8, rows_per_parameter: float = 10.0, tries: int = 3, starts: Sequence[Model] = (),
) -> dict[int, Guarded]:
    """Gaussian models for each K, refitted with other settings while a state is degenerate; at most ``tries`` fits a K.

    After a fit the best restart is decoded.  A condition number above ``most_condition`` raises the covariance floor
    tenfold (up to 0.1).  Otherwise a state with fewer rows than ``rows_per_parameter`` times its covariance parameters
    turns full covariances to one tied matrix, with the first floor.  All K still in work, with all their restarts,
    share each fit.  ``starts`` gives K its first parameters in place of the seeded ones.
    """
    d = len(seqs.select(F.col("x")[0].alias("v")).first()["v"])
    given = {m.k: m for m in starts}
    state = {k: (covariance, floor) for k in allowed_states(seqs, ks)}
    out = {k: Guarded(Model(k), []) for k in state}
    for attempt in range(tries):
        if not state:
            break
        fresh = [replace(given[k], covariance=c, floor=f) if k in given else Model(k, covariance=c, floor=f, seed=s) for k, (c, f) in state.items() for s in range(1 if k in given else restarts)]
        fitted = fit(seqs, fresh, n_iter, tol)
        for k, (c, f) in list(state.items()):
            best = max((m for m in fitted if m.k == k), key=lambda m: m.loglik if math.isfinite(m.loglik) else -math.inf)
            note = {"attempt": attempt, "covariance": c, "floor": f, "loglik": best.loglik, "condition": math.nan, "least_rows": math.nan, "verdict": "kept"}
            out[k].model = best
            out[k].attempts.append(note)
            if not math.isfinite(best.loglik):
                state[k], note["verdict"] = (c, f * 10), "no finite likelihood: floor x 10"
                continue
            rows = _occupancy(seqs, best)
            note["condition"], note["least_rows"] = float(state_conditions(best).max()), float(rows.min())
            need = rows_per_parameter * {"full": d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": d, "spherical": 1}[covariance]
            flat, thin = note["condition"] > most_condition, note["least_rows"] < need
            if flat and f < 0.1:
                state[k], note["verdict"] = (c, f * 10), "ill-conditioned: floor x 10"
            elif thin and c == "full":
                state[k], note["verdict"] = ("tied", floor), "thin state: tied"
            else:
                note["verdict"] = "kept, still degenerate" if flat or thin else "kept"
                del state[k]
    return out


def attempts(spark, fits: dict[int, Guarded]) -> DataFrame:
    """k, attempt, covariance, floor, loglik, condition, least_rows, verdict."""
    rows = [(k, *a.values()) for k, g in fits.items() for a in g.attempts]
    return spark.createDataFrame(rows, "k int, attempt int, covariance string, floor double, loglik double, condition double, least_rows double, verdict string")


def select(seqs: DataFrame, ks: Sequence[int], folds: int = 0, restarts: int = 1, criterion: str = "cv", kind: str = "gaussian", covariance: str = "full",
           lags: Sequence[int] = (0,), n_symbols: int = 0, n_iter: int = 50, floor: float = FLOOR) -> tuple[Model, pd.DataFrame]:
    """Pick K (and lags) by held-out log-likelihood per window over recording folds, or by BIC; returns the refitted winner and the scores.

    Criteria: ``cv`` over ``folds`` folds, ``loo`` over as many folds as recordings (see leave_one_out), ``bic``.
    """
    if criterion == "loo":
        folds, criterion = seqs.agg(F.max("fold")).first()[0] + 1, "cv"
    held = list(range(folds)) if criterion == "cv" else [None]
    cand = [Model(k, kind, covariance, L, f, s, n_symbols) for k in ks for L in lags for f in held for s in range(restarts)]
    fitted = fit(seqs, cand, n_iter, floor=floor)
    best: dict = {}
    for m in fitted:
        key = (m.k, m.lags, m.fold)
        if key not in best or m.loglik > best[key].loglik:
            best[key] = m
    keep = list(best.values())
    if criterion == "cv":
        for m, s in zip(keep, expected_counts(seqs, keep, score_held_out=True)):
            m.history = [float(s["ll"][0]) / float(s["n"][0])] if s else [float("nan")]
        rows = [(m.k, m.lags, m.history[0]) for m in keep]
        score = pd.DataFrame(rows, columns=["k", "lags", "score"]).groupby(["k", "lags"], as_index=False)["score"].mean()
        k, L = score.sort_values(["score", "k"], ascending=[False, True]).iloc[0][["k", "lags"]].astype(int)
        final = fit(seqs, [Model(k, kind, covariance, L, None, s, n_symbols) for s in range(restarts)], n_iter, floor=floor)
        return max(final, key=lambda m: m.loglik), score
    d = 1 if kind == "categorical" else len(keep[0].mean[0])
    score = pd.DataFrame([(m.k, m.lags, m.loglik, -2 * m.loglik + m.n_params(d) * math.log(m.n_train), -2 * m.loglik + 2 * m.n_params(d)) for m in keep],
                         columns=["k", "lags", "loglik", "bic", "aic"])
    i = int(score["bic"].idxmin())
    return keep[i], score


def viterbi(seqs: DataFrame, m: Model) -> DataFrame:
    """video, chunk, t, state: the most likely path of each recording.

    Chunks return best-score matrices between their ends; the chain of these
    fixes the states at every border, and each chunk then fills in its own part.
    """
    b = seqs.sparkSession.sparkContext.broadcast(m)
    kind = seqs.schema["video"].dataType.simpleString()

    def best_between(model, logb, la):
        s = np.where(np.eye(model.k) > 0, 0.0, -np.inf)
        for lb in logb:
            s = (s[:, :, None] + la[None]).max(1) + lb[None, :]
        return s

    def ends(batches):
        model = b.value
        la = np.log(np.maximum(model.a, 1e-300))
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                lb = _emission(model, *_arrays(r))
                mat = best_between(model, lb, la) if r.chunk else lb[0][:, None] + best_between(model, lb[1:], la)
                yield pd.DataFrame({"video": [r.video], "chunk": [r.chunk], "mat": [list(mat.ravel())]})

    t = seqs.mapInPandas(ends, f"video {kind}, chunk long, mat array<double>")
    chains = spread(t.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("chunk", "mat"))).alias("c")))

    def borders(batches):
        model = b.value
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                v, back = np.log(np.maximum(model.pi, 1e-300)), []
                for e in r.c:
                    cand = v[:, None] + np.asarray(e["mat"]).reshape(model.k, model.k)
                    back.append(cand.argmax(0))
                    v = cand.max(0)
                last = [int(v.argmax())]
                for p in reversed(back):
                    last.append(int(p[last[-1]]))
                last.reverse()
                n = len(r.c)
                yield pd.DataFrame({"video": [r.video] * n, "chunk": [e["chunk"] for e in r.c], "enter": last[:n], "leave": last[1:]})

    fixed = chains.mapInPandas(borders, f"video {kind}, chunk long, enter int, leave int")

    def fill(batches):
        model = b.value
        la = np.log(np.maximum(model.a, 1e-300))
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                lb = _emission(model, *_arrays(r))
                v = (np.where(np.arange(model.k) == r.enter, 0.0, -np.inf) if r.chunk == 0 else la[r.enter]) + lb[0]
                back = []
                for row in lb[1:]:
                    cand = v[:, None] + la
                    back.append(cand.argmax(0))
                    v = cand.max(0) + row
                path = [int(r.leave)]
                for p in reversed(back):
                    path.append(int(p[path[-1]]))
                path.reverse()
                yield pd.DataFrame({"video": r.video, "chunk": r.chunk, "t": np.arange(len(path)), "state": path})

    return seqs.join(fixed, ["video", "chunk"]).mapInPandas(fill, f"video {kind}, chunk long, t int, state int")


def decode(seqs: DataFrame, m: Model, size: int = CHUNK) -> DataFrame:
    """video, m, state."""
    return viterbi(seqs, m).select("video", (F.col("chunk") * size + F.col("t")).alias("m"), "state")


def sequence_loglik(seqs: DataFrame, m: Model) -> DataFrame:
    """video, loglik, n of each recording under the model."""
    msgs = _messages(seqs, [m])
    d = seqs if msgs is None else seqs.join(msgs, ["video", "chunk"])
    whole = msgs is None
    b = seqs.sparkSession.sparkContext.broadcast(m)
    kind = seqs.schema["video"].dataType.simpleString()

    def run(batches):
        model = b.value
        for batch in batches:
            for part in _slices(batch):
                c = Chunks.read(part)
                begins = c.chunk == 0
                ins = None if whole else part.column(part.schema.get_field_index("ins")).to_pylist()
                vin = np.array([model.pi if own else ins[j][0] for j, own in enumerate(begins)])
                ll = _forward_backward(model, _emission(model, c.x, None, c.design(model)), c.first, begins, vin, np.ones((len(vin), model.k)))[2]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("video")), pa.array(ll), pa.array(np.diff(c.first))], ["video", "loglik", "n"])

    return d.mapInArrow(run, f"video {kind}, loglik double, n long").groupBy("video").agg(F.sum("loglik").alias("loglik"), F.sum("n").alias("n"))


def align(models: Sequence[Model]) -> Model:
    """Match every model's states to the first one's at least total distance of emission means and average the parameters."""
    ref = models[0]
    orders = [assign(np.sqrt(((ref.mean[:, None] - m.mean[None]) ** 2).sum(-1))) for m in models]
    avg = lambda f: np.mean([f(m, p) for m, p in zip(models, orders)], axis=0)
    pi, a = avg(lambda m, p: m.pi[p]), avg(lambda m, p: m.a[np.ix_(p, p)])
    w = avg(lambda m, p: m.w[p]) if ref.w is not None else None
    return replace(ref, pi=pi / pi.sum(), a=a / a.sum(1, keepdims=True), mean=avg(lambda m, p: m.mean[p]), cov=avg(lambda m, p: m.cov[p]), w=w)


def parameters(spark, m: Model) -> DataFrame:
    """state, pi, transitions, mean, cov as a table."""
    rows = [(k, float(m.pi[k]), m.a[k].tolist(), [] if m.mean is None else m.mean[k].tolist(), [] if m.cov is None else m.cov[k].ravel().tolist()) for k in range(m.k)]
    return spark.createDataFrame(rows, "state int, pi double, transitions array<double>, mean array<double>, cov array<double>")
