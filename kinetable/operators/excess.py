"""Excess similarity of visit sequences over no-repeat reorderings of the same visits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinetable.operators.states import transition_lookup, visit_sequence
from kinetable.plans.python import spread
from kinetable.session import cut_lineage


def small_table(similarity: DataFrame) -> DataFrame:
    """The K x K similarity as a literal table, so its own plan is not run again in every use."""
    return similarity.sparkSession.createDataFrame(similarity.collect(), similarity.schema)


def _visits(path: DataFrame) -> DataFrame:
    return visit_sequence(path).select("video", F.col("visit").alias("m"), "state", "dwell")


def observed_similarity(path: DataFrame, similarity: DataFrame, lag: int = 1) -> DataFrame:
    """video, observed: mean similarity over visit pairs at the lag."""
    return transition_lookup(_visits(path).drop("dwell"), similarity, lag).groupBy("video").agg(F.avg("s").alias("observed"))


def uniform_null(path: DataFrame, similarity: DataFrame) -> DataFrame:
    """video, null_uniform, repeat_rate: expectation under unrestricted shuffles, in closed form from visit counts."""
    n = _visits(path).groupBy("video", "state").agg(F.count("*").alias("c"))
    tot = n.groupBy("video").agg(F.sum("c").alias("n"))
    other = n.select("video", F.col("state").alias("next_state"), F.col("c").alias("c2"))
    pairs = n.join(other, "video").join(tot, "video").where("n > 1")  # K x K rows per recording
    same = F.col("state") == F.col("next_state")
    share = F.col("c") * F.when(same, F.col("c") - 1).otherwise(F.col("c2")) / (F.col("n") * (F.col("n") - 1))
    j = pairs.withColumn("_w", share).join(F.broadcast(similarity), ["state", "next_state"])
    return j.groupBy("video").agg(F.sum(F.col("_w") * F.col("s")).alias("null_uniform"), F.sum(F.when(same, F.col("_w")).otherwise(0.0)).alias("repeat_rate"))


STACK, STRETCH = 1 << 15, 1 << 21  # letters looked at in one step, random numbers held


def _draw_words(counts: np.ndarray, s: np.ndarray, draws: int, lag: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Statistic and log importance weight of ``draws`` words of one recording, see _draw_stack."""
    return next(_draw_stack([counts], s, draws, lag, [rng]))


def _draw_stack(many: Sequence[np.ndarray], s: np.ndarray, draws: int, lag: int, rngs: Sequence) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Statistic and log importance weight of ``draws`` words without adjacent repeats for each of some counts, drawn letter by letter.

    With r letters left to place, a letter of which more than ceil(r / 2) are left cannot be laid out any more.  So
    after a letter is taken no count may pass that bound, and the letter just taken may not pass floor(r / 2).  Among the
    letters that keep the word possible one is drawn in proportion to its count; -inf marks a dead end.
    All words advance in lock step; each recording draws from its own generator, whatever it is stacked with.
    """
    k = len(many[0])
    size = np.array([int(c.sum()) for c in many])
    order = np.argsort(-size, kind="stable")  # the longest first, so that those still open come first
    n, places = size[order], int(size.max())
    left = np.repeat(np.stack([many[i] for i in order], 1)[:, :, None], draws, 2).astype(np.int64)  # letter, recording, draw
    letters = np.arange(k)[:, None, None]
    word = np.full((places, len(many), draws), -1, np.int16)
    logw = np.zeros((len(many), draws))
    with np.errstate(divide="ignore"):
        logs = np.log(np.arange(left.max() + 1))
    step = max(1, STRETCH // left.size)
    for place in range(places):
        on = int((n > place).sum())
        if place % step == 0:
            noise = np.zeros((min(step, places - place), k, on, draws))
            for j in range(on):
                m = min(step, int(n[j]) - place)
                noise[:m, :, j] = rngs[order[j]].gumbel(size=(m, draws, k)).transpose(0, 2, 1)
        now = left[:, :on]
        rest = (n[:on] - place - 1)[:, None]
        over = now > (rest + 1) // 2
        fits = (now > 0) & (over.sum(0) - over == 0) & (now - 1 <= rest // 2)
        if place:
            fits &= letters != word[place - 1, :on]
        take = np.where(fits, logs[np.maximum(now, 0)] + noise[place % step, :, :on], -np.inf).argmax(0)  # the largest is a draw by count
        taken = np.take_along_axis(now, take[None], 0)[0]
        open_ = np.where(fits, now, 0).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            logw[:on] += np.where(open_ > 0, np.log(open_) - logs[np.maximum(taken, 0)], -np.inf)
        word[place, :on] = take
        left[:, :on] = now - (letters == take)
    for j in np.argsort(order, kind="stable"):
        w = word[: n[j], j]
        yield s[w[:-lag], w[lag:]].mean(0), logw[j]


def _chain_words(counts: np.ndarray, s: np.ndarray, draws: int, lag: int, rng) -> np.ndarray:
    """Statistics of ``draws`` independent chains over words without adjacent repeats, all advanced in lock step.

    A chain starts from the letters laid out on even, then odd places, most frequent first.  Its moves are the exchange of
    two places and, once every n moves, the reversal of a stretch; both are their own inverse, so the law is uniform.
    """
    n = int(counts.sum())
    letters = np.repeat(np.argsort(-counts, kind="stable"), np.sort(counts)[::-1])
    first = np.empty(n, np.int64)
    first[[*range(0, n, 2), *range(1, n, 2)]] = letters
    word = np.full((draws, n + 2), -1)  # walls that equal no letter
    word[:, 1:-1] = first
    ids = np.arange(draws)
    for move in range(max(2000, 10 * n)):
        a, b = rng.integers(1, n + 1, (2, draws))
        if move % n:
            x, y = word[ids, a], word[ids, b]
            word[ids, a], word[ids, b] = y, x
            clash = np.zeros(draws, bool)
            for at in (a, b):
                clash |= (word[ids, at] == word[ids, at - 1]) | (word[ids, at] == word[ids, at + 1])
            word[ids[clash], a[clash]], word[ids[clash], b[clash]] = x[clash], y[clash]
        else:
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            good = (word[ids, hi] != word[ids, lo - 1]) & (word[ids, lo] != word[ids, hi + 1])
            at = np.arange(n + 2)[None, :]
            inside = (at >= lo[:, None]) & (at <= hi[:, None]) & good[:, None]
            word = np.take_along_axis(word, np.where(inside, lo[:, None] + hi[:, None] - at, at), 1)
    inner = word[:, 1:-1]
    return s[inner[:, :-lag], inner[:, lag:]].mean(1)


def no_repeat_null(path: DataFrame, similarity: DataFrame, k: int, draws: int = 2000, lag: int = 1, batches: int = 16, seed: int = 0) -> DataFrame:
    """video, null_mean, p, ess, method over uniform reorderings without adjacent repeats.

    Only the K visit counts of a recording matter, so each (recording, batch) is
    one small row.  Importance weights come back as shifted sums; the fewest
    batches whose effective size reaches ``draws`` are used, and recordings that
    never reach it are drawn by a chain.
    """
    v = _visits(path)
    obs = observed_similarity(path, similarity, lag)
    counts = v.groupBy("video").agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("state") == s) for s in range(k)]).alias("counts"))
    base = cut_lineage(counts.join(obs, "video").where(F.col("n") > lag + 1))
    smat = np.zeros((k, k))
    for r in similarity.collect():  # K x K rows
        smat[r["state"], r["next_state"]] = r["s"]
    kind = base.schema["video"].dataType.simpleString()

    width = max(1, STACK // (draws * k))

    def draw(batch_rows):
        for pdf in batch_rows:
            out = []
            for i in range(0, len(pdf), width):
                rows = list(pdf.iloc[i : i + width].itertuples(index=False))
                rngs = [np.random.default_rng([seed, int(r.batch), abs(int(r.h))]) for r in rows]
                for r, (st, lw) in zip(rows, _draw_stack([np.asarray(r.counts) for r in rows], smat, draws, lag, rngs)):
                    st, lw = st[np.isfinite(lw)], lw[np.isfinite(lw)]
                    if not len(lw):
                        continue
                    w = np.exp(lw - lw.max())
                    out.append((r.video, r.batch, lw.max(), w.sum(), (w * w).sum(), (w * st).sum(), w[st >= r.observed - 1e-12].sum()))
            if out:
                yield pd.DataFrame(out, columns=["video", "batch", "top", "w", "w2", "ws", "wt"])

    schema = f"video {kind}, batch int, top double, w double, w2 double, ws double, wt double"

    def run(rows: DataFrame, first: int, last: int) -> DataFrame:
        e = rows.withColumn("batch", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("h", F.xxhash64("video"))
        return spread(e, "video", "batch").mapInPandas(draw, schema)

    def prefixes(b: DataFrame) -> DataFrame:
        shift = F.exp(F.col("top") - F.max("top").over(W.partitionBy("video")))
        b = b.withColumns({"w": F.col("w") * shift, "w2": F.col("w2") * shift * shift, "ws": F.col("ws") * shift, "wt": F.col("wt") * shift})
        cum = W.partitionBy("video").orderBy("batch").rowsBetween(W.unboundedPreceding, 0)  # at most 16 rows
        c = b.select("video", "batch", *[F.sum(x).over(cum).alias(x) for x in ("w", "w2", "ws", "wt")])
        return c.withColumn("ess", F.col("w") * F.col("w") / F.col("w2"))

    # few recordings need all batches, so the later ones are drawn only for recordings that the earlier ones leave short
    drawn, rest, reached, last = None, base, [], 0
    while last < batches:
        first, last = last + 1, min(max(2, 2 * last), batches)
        new = run(rest, first, last)
        drawn = cut_lineage(new if drawn is None else drawn.join(rest.select("video"), "video", "left_semi").unionByName(new))
        sums = cut_lineage(prefixes(drawn))
        enough = sums.where(F.col("ess") >= draws * (1 - 1e-9)).groupBy("video").agg(F.min("batch").alias("batch"))
        reached.append(sums.join(enough, ["video", "batch"]))
        rest = cut_lineage(rest.join(enough.select("video"), "video", "left_anti"))
    done = reduce(DataFrame.unionByName, reached)
    sis = done.select("video", (F.col("ws") / F.col("w")).alias("null_mean"), (F.col("wt") / F.col("w")).alias("p"), "ess", F.lit("sis").alias("method"))
    low = rest.join(sums.groupBy("video").agg(F.max("ess").alias("ess")), "video", "left")
    pieces = 8

    def chain(batch_rows):
        for pdf in batch_rows:
            out = []
            for r in pdf.itertuples(index=False):
                st = _chain_words(np.asarray(r.counts), smat, -(-draws // pieces), lag, np.random.default_rng([seed, 1000 + int(r.piece), abs(int(r.h))]))
                out.append((r.video, r.ess, len(st), st.sum(), int((st >= r.observed - 1e-12).sum())))
            yield pd.DataFrame(out, columns=["video", "ess", "n", "s", "t"])

    lows = low.withColumn("piece", F.explode(F.sequence(F.lit(1), F.lit(pieces)))).withColumn("h", F.xxhash64("video"))
    ch = spread(lows, "video", "piece").mapInPandas(chain, f"video {kind}, ess double, n long, s double, t long").groupBy("video").agg(
        (F.sum("s") / F.sum("n")).alias("null_mean"), ((1 + F.sum("t")) / (1 + F.sum("n"))).alias("p"), F.max("ess").alias("ess")
    ).withColumn("method", F.lit("chain"))
    return sis.unionByName(ch)


def portion(path: DataFrame, max_windows: int | None = None, part: str = "all") -> DataFrame:
    """The first windows of each recording and/or its first or second half, renumbered from 0."""
    p = path if max_windows is None else path.where(F.col("m") < max_windows)
    if part == "all":
        return p
    n = p.groupBy("video").agg(F.floor((F.max("m") + 1) / 2).alias("_h"))
    p = p.join(n, "video")
    if part == "first":
        return p.where(F.col("m") < F.col("_h")).drop("_h")
    if part == "second":
        return p.where(F.col("m") >= F.col("_h")).withColumn("m", F.col("m") - F.col("_h")).drop("_h")
    raise ValueError(f"unknown part {part!r}")


def excess_similarity(path: DataFrame, similarity: DataFrame, k: int, draws: int = 2000, lag: int = 1, seed: int = 0,
                      max_windows: int | None = None, part: str = "all") -> DataFrame:
    """video, n_visits, observed, null_mean, excess, p, ess, method, null_uniform, excess_uniform, repeat_rate."""
    similarity = small_table(similarity)
    p = cut_lineage(portion(path, max_windows, part))
    n = visit_sequence(p).groupBy("video").agg(F.count("*").alias("n_visits"))
    null = no_repeat_null(p, similarity, k, draws, lag, seed=seed)
    out = n.join(observed_similarity(p, similarity, lag), "video", "left").join(null, "video", "left").join(uniform_null(p, similarity), "video", "left")
    scored = F.col("n_visits") > lag + 1
    out = out.withColumns({c: F.when(scored, F.col(c)) for c in ("observed", "null_uniform", "repeat_rate")})
    return out.withColumns({"excess": F.col("observed") - F.col("null_mean"), "excess_uniform": F.col("observed") - F.col("null_uniform")})


DWELL_EDGES = [1, 2, 3, 5, 9]


def dwell_stratified(path: DataFrame, similarity: DataFrame, null: DataFrame, min_count: int = 5) -> DataFrame:
    """video, dwell_bin, n, excess: transitions by the dwell of their source visit (1, 2, 3-4, 5-8, 9+) against the null mean."""
    v = _visits(path)
    n = v.groupBy("video").agg(F.count("*").alias("_n")).where("_n >= 3")
    t = transition_lookup(v, similarity)
    b = F.lit(0)
    for i, e in enumerate(DWELL_EDGES[1:], 1):
        b = F.when(F.col("dwell") >= e, i).otherwise(b)
    g = t.join(n, "video", "left_semi").groupBy("video", b.alias("dwell_bin")).agg(F.count("*").alias("n"), F.avg("s").alias("m"))
    return g.where(F.col("n") >= min_count).join(null.select("video", "null_mean"), "video").select("video", "dwell_bin", "n", (F.col("m") - F.col("null_mean")).alias("excess"))


def channel_split(path: DataFrame, channels: dict[str, DataFrame], k: int, draws: int = 2000, seed: int = 0) -> DataFrame:
    """excess_similarity under each similarity channel (combined, magnitude, shape)."""
    path = cut_lineage(path)
    out = None
    for name, s in channels.items():
        e = excess_similarity(path, s, k, draws, seed=seed).withColumn("channel", F.lit(name))
        out = e if out is None else out.unionByName(e)
    return out
