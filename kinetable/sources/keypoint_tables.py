"""Readers for long keypoint tables, walk archives, labels, state bundles and run histories; writers."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.functions.scalar import finite, number_or_null
from kinetable.plans.quantiles import exact_quantiles

_PAIRS = T.ArrayType(T.StructType([T.StructField("s", T.DoubleType()), T.StructField("e", T.DoubleType())]))
# fixed values: logical fields of a long keypoint table and the release's file pattern
LOGICAL = ("video", "frame", "part_idx", "x", "y", "fps")
WORLD_GLOB = "h36m_3d_world_*"
# fixed values: alias lists per label, first present wins
ALIASES = {
    "updrs_gait": ["UPDRS_GAIT", "updrs_gait", "updrs", "gait_score"],
    "med": ["medication", "med", "med_state", "on_off"],
    "freezer": ["freezer", "FoG", "fog", "is_freezer"],
    "fps": ["fps", "frame_rate", "framerate"],
    "sex": ["sex", "gender"],
}
# fixed values: spellings of the two-way labels
NULL_WORDS = ["", "nan", "none", "na"]
FREEZER_YES = ["freezer", "fog", "yes", "y", "true", "1", "1.0"]
FREEZER_NO = ["non-freezer", "nonfreezer", "non_freezer", "no", "n", "false", "0", "0.0"]
MED_ON = ["on", "1", "1.0", "true"]
MED_OFF = ["off", "0", "0.0", "false"]
INTERVAL_KEYS = ["fog_intervals", "FoG_intervals", "freezing_intervals", "fog", "FoG", "freezing"]


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text plus ``_ord``, the order of rows in the files."""
    return spark.read.csv(path, header=True, inferSchema=False).withColumn(
        "_ord", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"))
    )


def rename_columns(raw: DataFrame, columns: Mapping[str, str] | None = None, needed: Sequence[str] = LOGICAL) -> DataFrame:
    """Physical to logical names; a missing column is an error."""
    where = {n: n for n in needed} | dict(columns or {})
    missing = [f"{k} ({v})" for k, v in where.items() if v not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; found {raw.columns}")
    return raw.select(*[F.col(v).alias(k) for k, v in where.items()], *[c for c in raw.columns if c == "_ord"])


def parse_keypoints(raw: DataFrame, columns: Mapping[str, str] | None = None, joint_cap: int | None = None) -> DataFrame:
    """video, frame, joint, x, y, ord from text rows.

    Indices are truncated; rows whose index does not parse or is negative go.
    The last row of a repeated (video, frame, joint) cell wins.
    """
    r = rename_columns(raw, columns)
    idx = lambda c: F.when(finite(F.col(c).try_cast("double")).isNotNull(), F.col(c).try_cast("double").cast("int"))
    d = r.select(
        F.col("video"), idx("frame").alias("frame"), idx("part_idx").alias("joint"), number_or_null(F.col("x")).alias("x"),
        number_or_null(F.col("y")).alias("y"), F.col("_ord"),
    ).where("frame >= 0 AND joint >= 0")
    if joint_cap is not None:
        d = d.where(F.col("joint") < joint_cap)
    last = d.groupBy("video", "frame", "joint").agg(F.max_by(F.struct("x", "y"), "_ord").alias("v"), F.min("_ord").alias("ord"))
    return last.select("video", "frame", "joint", "v.x", "v.y", "ord")


def video_fps(raw: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """video, fps: median of the finite values, 0 if there are none."""
    r = rename_columns(raw, columns).select("video", number_or_null(F.col("fps")).alias("fps"))
    med = exact_quantiles(r, ["video"], "fps", {"fps": 0.5})
    return r.select("video").distinct().join(med, "video", "left").select("video", F.coalesce("fps", F.lit(0.0)).alias("fps"))


def limit_videos(kp: DataFrame, min_frames: int = 1, max_videos: int | None = None) -> DataFrame:
    """Drop videos shorter than ``min_frames`` (last - first + 1); keep the first N left, by first appearance."""
    v = kp.groupBy("video").agg((F.max("frame") - F.min("frame") + 1).alias("_len"), F.min("ord").alias("_first"))
    v = v.where(F.col("_len") >= min_frames).select("video", "_first")
    if max_videos is not None:
        v = v.orderBy("_first").limit(max_videos)
    return kp.join(v.select("video"), "video", "left_semi")


def check_joint_names(seen: DataFrame, required: Sequence[str], column: str = "bp") -> DataFrame:
    """name, problem (missing / unexpected): the symmetric difference with the required set."""
    need = seen.sparkSession.createDataFrame([(n,) for n in required], "name string")
    have = seen.select(F.col(column).alias("name")).distinct()
    return need.join(have, "name", "left_anti").withColumn("problem", F.lit("missing")).unionByName(
        have.join(need, "name", "left_anti").withColumn("problem", F.lit("unexpected"))
    )


def parse_keypoints_strict(raw: DataFrame, names: Sequence[str]) -> DataFrame:
    """Named joints to numbers; any other joint set is an error.  Frames keep their numbers."""
    bad = check_joint_names(raw, names).limit(50).collect()
    if bad:
        raise ValueError(f"joint names differ: {[(r['name'], r['problem']) for r in bad]}")
    pos = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("bp")) - 1
    return raw.select("video", F.col("frame").cast("int").alias("frame"), pos.cast("int").alias("joint"),
                      number_or_null(F.col("x").cast("string")).alias("x"), number_or_null(F.col("y").cast("string")).alias("y"))


def split_walk_key(key: Column) -> tuple[Column, Column]:
    """subject and walk of ``subject__walk``, split once; without a separator the key is both."""
    parts = F.split(key, "__", 2)
    return parts[0], F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0])


def read_walk_archives(spark: SparkSession, path: str, pattern: str = WORLD_GLOB) -> DataFrame:
    """cohort, subject, walk_id, frame, joint, x, y, z from ``cohort/*.npz`` files of numeric arrays.

    Members are (F, J, 3) or (F, 3J); object members are not unpacked.  Files
    are read in parallel and walks leave the decoder one at a time.
    """
    import numpy as np

    def decode(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                cohort = p.rstrip("/").split("/")[-2]
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for key in z.files:
                        a = np.asarray(z[key], float)
                        if a.ndim == 2 and a.shape[1] % 3 == 0:
                            a = a.reshape(len(a), -1, 3)
                        if a.ndim != 3 or a.shape[2] != 3:
                            continue
                        f, j = np.indices(a.shape[:2])
                        flat = a.reshape(-1, 3)
                        yield pd.DataFrame({"cohort": cohort, "key": key, "frame": f.ravel(), "joint": j.ravel(), "x": flat[:, 0], "y": flat[:, 1], "z": flat[:, 2]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = files.repartition(F.col("path")).mapInPandas(decode, "cohort string, key string, frame int, joint int, x double, y double, z double")
    subject, walk = split_walk_key(F.col("key"))
    return rows.select("cohort", subject.alias("subject"), walk.alias("walk_id"), "frame", "joint", *[finite(F.col(c)).alias(c) for c in "xyz"])


def label_from_json(js: Column, field: str, nested: bool = True) -> Column:
    """First present alias of a label in a JSON record, then under ``other``."""
    paths = [f"$.{a}" for a in ALIASES[field]] + ([f"$.other.{a}" for a in ALIASES[field]] if nested else [])
    return F.coalesce(*[F.get_json_object(js, p) for p in paths])


def extract_labels(records: DataFrame, js: str = "record") -> DataFrame:
    """Alias columns beside the record's other scalar fields as a map."""
    return records.withColumns({
        "updrs_gait": label_from_json(F.col(js), "updrs_gait", False), "med": label_from_json(F.col(js), "med", False),
        "freezer": label_from_json(F.col(js), "freezer"), "sex": label_from_json(F.col(js), "sex"),
        "labels": F.from_json(js, "map<string,string>"),
    })


def norm_updrs(c: Column) -> Column:
    """Round to an ordinal level (half to even); anything else is NULL."""
    return F.bround(finite(F.trim(c.cast("string")).try_cast("double"))).cast("int")


def _two_way(c: Column, yes, no, words, fold) -> Column:
    t = F.lower(F.trim(c))
    return F.when(c.isNull() | t.isin(NULL_WORDS), F.lit(None)).when(t.isin(yes), words[0]).when(t.isin(no), words[1]).otherwise(fold(F.trim(c)))


def norm_freezer(c: Column) -> Column:
    return _two_way(c, FREEZER_YES, FREEZER_NO, ("freezer", "non-freezer"), F.lower)


def norm_med(c: Column) -> Column:
    return _two_way(c, MED_ON, MED_OFF, ("ON", "OFF"), F.upper)


def norm_flag(v: Column, words: tuple[str, str]) -> Column:
    """Numeric flag: above one half is the first word."""
    return F.when(finite(v.cast("double")).isNull(), None).when(v > 0.5, words[0]).otherwise(words[1])


@F.pandas_udf(_PAIRS)
def _interval_pairs(src: pd.Series) -> pd.Series:
    """The annotation's own shapes to (s, e) pairs; anything else is NULL."""

    def one(text):
        try:
            v = json.loads(text)
            if isinstance(v, dict):
                v = list(zip(v.get("start", v.get("onset")), v.get("end", v.get("offset"))))
            elif v and not isinstance(v[0], list):
                if len(v) % 2:
                    return None
                v = list(zip(v[0::2], v[1::2]))
            return [{"s": float(a), "e": float(b)} for a, b in v] or None
        except (TypeError, ValueError):
            return None

    return src.map(one, na_action="ignore")


def parse_event_intervals(records: DataFrame, js: str, fps: Column, n_frames: Column, units: str = "auto") -> DataFrame:
    """Add ``intervals``: sorted array of (start_s, end_s) clipped to the recording.

    Reads a list of pairs, a flat even list, or an object with start/onset and
    end/offset lists, under the first known key, also inside ``other``.
    """
    c = F.col(js)
    found = F.coalesce(*[F.get_json_object(c, f"$.{p}{k}") for k in INTERVAL_KEYS for p in ("other.", "")])
    d = records.withColumns({"_src": found, "_fps": fps.cast("double"), "_nf": n_frames.cast("double")})
    d = d.withColumn("_raw", _interval_pairs("_src"))
    d = d.withColumns({"_dur": F.greatest(F.col("_nf") / F.col("_fps"), F.lit(1e-6)), "_hi": F.array_max(F.transform("_raw", lambda p: p["e"]))})
    frames = F.lit(units == "frames") if units != "auto" else (F.col("_hi") > F.col("_dur") * 1.5) & (F.col("_hi") <= F.col("_nf") * 1.5)
    d = d.withColumn("_scale", F.when(frames, 1.0 / F.col("_fps")).otherwise(1.0))
    clip = lambda v: F.greatest(F.lit(0.0), F.least(v * F.col("_scale"), F.col("_dur")))
    d = d.withColumn("_cut", F.transform("_raw", lambda p: F.struct(clip(F.least(p["s"], p["e"])).alias("start_s"), clip(F.greatest(p["s"], p["e"])).alias("end_s"))))
    kept = F.array_sort(F.filter("_cut", lambda p: p["end_s"] > p["start_s"]))
    none = F.array().cast("array<struct<start_s:double,end_s:double>>")
    return d.withColumn("intervals", F.coalesce(kept, none)).select(*records.columns, "intervals")


def hooked_intervals(
    recordings: DataFrame, extractor: Callable[[dict, float, int], Iterable], labels: str = "labels", fps: str = "fps", n_frames: str = "n_frames", keep: Sequence[str] = ("video",)
) -> DataFrame:
    """Event intervals from the caller's own ``extractor(labels, fps, n_frames) -> [(start_s, end_s)]``: keep columns, start_s, end_s.

    The extractor runs as a table function, once a recording row.  What it returns is held to the rules of the built-in
    parser: ends are put in order and clipped to the recording, pairs that are empty then are dropped.  None gives no
    interval.  Anything that is not a sequence of pairs of finite numbers is an error that names the recording.
    """

    class Hook:
        def eval(self, key: str, given, rate: float, frames: int):
            pairs = extractor(dict(given) if given is not None else {}, rate, frames)
            length = max(frames / rate, 1e-6)
            for pair in pairs if pairs is not None else ():
                try:
                    a, b = (float(x) for x in pair)
                except (TypeError, ValueError) as error:
                    raise ValueError(f"recording {key}: {pair!r} is not a pair of numbers") from error
                if a - a != 0 or b - b != 0:
                    raise ValueError(f"recording {key}: {pair!r} is not finite")
                a, b = (min(max(x, 0.0), length) for x in (min(a, b), max(a, b)))
                if b > a:
                    yield a, b

    call = F.udtf(Hook, returnType="start_s double, end_s double")
    named = recordings.select(*keep, F.to_json(F.struct(*keep)).alias("_key"), F.col(labels).alias("_given"), F.col(fps).cast("double").alias("_rate"), F.col(n_frames).cast("long").alias("_frames"))
    out = named.lateralJoin(call(F.col("_key").outer(), F.col("_given").outer(), F.col("_rate").outer(), F.col("_frames").outer()))
    return out.select(*keep, "start_s", "end_s")


def labels_from_names(names: DataFrame, positive: Sequence[int | str], column: str = "video") -> DataFrame:
    """label 1 if any digit run of the name, zero-filled to 4, is a positive id."""
    ids = [str(p).zfill(4) for p in positive]
    runs = F.transform(F.regexp_extract_all(F.col(column).cast("string"), F.lit(r"(\d+)"), 1), lambda s: F.when(F.length(s) >= 4, s).otherwise(F.lpad(s, 4, "0")))
    return names.withColumn("digits", runs).withColumn("label", F.arrays_overlap("digits", F.array(*[F.lit(i) for i in ids])).cast("int"))


def missing_positive_ids(labelled: DataFrame, positive: Sequence[int | str]) -> DataFrame:
    want = labelled.sparkSession.createDataFrame([(str(p).zfill(4),) for p in positive], "id string")
    return want.join(labelled.select(F.explode("digits").alias("id")).distinct(), "id", "left_anti")


def label_conflicts(labels: DataFrame, positive: DataFrame) -> DataFrame:
    """Recordings whose label differs from the documented positive list, on either side."""
    j = labels.join(positive.withColumn("documented", F.lit(1)), "video", "full_outer")
    return j.where(F.coalesce("label", F.lit(-1)) != F.coalesce("documented", F.lit(0))).select("video", "label", F.coalesce("documented", F.lit(0)).alias("documented"))


def check_group_labels(labels: DataFrame, positive: DataFrame) -> DataFrame:
    bad = [r["video"] for r in label_conflicts(labels, positive).limit(20).collect()]
    if bad:
        raise ValueError(f"labels disagree with the documented positives: {bad}")
    return labels


def attach_labels(walks: DataFrame, labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join on ``subject__walk``, else on the walk id alone (first seen wins).

    ``labels`` has key, ord and the label columns; they override existing ones.
    """
    one = labels.groupBy("key").agg(*[F.min_by(c, "ord").alias(f"_{c}") for c in columns])
    full = walks.withColumn("_key", F.concat_ws("__", "subject", "walk_id"))
    a = full.join(one.select(F.col("key").alias("_key"), F.lit(1).alias("_hit"), *[F.col(f"_{c}").alias(f"_a{c}") for c in columns]), "_key", "left")
    b = a.join(one.select(F.col("key").alias("walk_id"), *[F.col(f"_{c}").alias(f"_b{c}") for c in columns]), "walk_id", "left")
    pick = {c: F.when(F.col("_hit") == 1, F.col(f"_a{c}")).otherwise(F.col(f"_b{c}")) for c in columns}
    pick = {c: (F.coalesce(v, F.col(c)) if c in walks.columns else v) for c, v in pick.items()}
    return b.withColumns(pick).drop("_key", "_hit", *[f"_{s}{c}" for s in "ab" for c in columns])


def check_state_paths(path: DataFrame, lengths: DataFrame, transitions: DataFrame | None = None) -> DataFrame:
    """One row of K; raises if lengths and rows disagree or the transition matrix is not K x K."""
    n = path.groupBy("video").agg(F.count("*").alias("_n")).join(lengths, "video", "full_outer")
    bad = n.where(F.coalesce("_n", F.lit(-1)) != F.coalesce("length", F.lit(-1))).limit(5).collect()
    if bad:
        raise ValueError(f"lengths do not match the path: {bad}")
    k = path.agg((F.max("state") + 1).alias("k"))
    if transitions is not None:
        kk = k.first()["k"]
        shape = transitions.agg(F.count("*"), F.max("state"), F.max("next_state")).first()
        if tuple(shape) != (kk * kk, kk - 1, kk - 1):
            raise ValueError(f"transition matrix is not {kk} x {kk}")
    return k


def expand_lengths(lengths: DataFrame, order: str = "video") -> DataFrame:
    """video, m rebuilt by repeating each recording ``length`` times."""
    return lengths.where("length > 0").withColumn("m", F.explode(F.sequence(F.lit(0), F.col("length") - 1))).drop("length")


def summarize_runs(history: DataFrame, rank_by: str = "val_rec_min") -> DataFrame:
    """Per run: best, its first epoch and final values of validation loss and reconstruction, ranked ascending.

    ``history`` is run, train and val as arrays of (loss, rec_full).
    """
    best = lambda f: F.array_min(F.transform("val", lambda e, i: F.struct(e[f].alias("v"), i.alias("i"))))
    r = history.where(F.size("val") > 0).select(
        "run", F.size("val").alias("n_epochs"), best("loss")["v"].alias("val_loss_min"), best("loss")["i"].alias("val_loss_min_epoch"),
        best("rec_full")["v"].alias("val_rec_min"), best("rec_full")["i"].alias("val_rec_min_epoch"),
        F.element_at("val", -1)["loss"].alias("val_loss_final"), F.element_at("val", -1)["rec_full"].alias("val_rec_final"),
        F.when(F.size("train") > 0, F.try_element_at("train", F.lit(-1))["rec_full"]).alias("train_rec_final"),
    )
    if rank_by not in r.columns[2:]:
        raise ValueError(f"rank_by must be one of {r.columns[2:]}")
    return r.orderBy(rank_by, "run")


def read_run_history(spark: SparkSession, path: str) -> DataFrame:
    """One row per run folder from its ``history.json``."""
    e = "array<struct<loss:double,rec_full:double>>"
    h = spark.read.schema(f"train {e}, val {e}").option("multiLine", "true").option("pathGlobFilter", "history.json").option("recursiveFileLookup", "true").json(path)
    return h.withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))


def rank_runs(runs: DataFrame, metric: str) -> DataFrame:
    """Add ``rank``: finished runs by ascending metric, failed or unscored ones last.  One row per run."""
    from pyspark.sql.window import Window as W

    ok = (F.col("status") == "ok") & F.col(metric).isNotNull()
    w = W.partitionBy(F.lit(0)).orderBy(F.when(ok, 0).otherwise(1), F.when(ok, F.col(metric)).asc_nulls_last(), "run")
    return runs.withColumn("rank", F.row_number().over(w))


def best_runs(runs: DataFrame, metric: str, by: str) -> DataFrame:
    """Best finished run per architecture."""
    ok = runs.where((F.col("status") == "ok") & F.col(metric).isNotNull())
    m = ok.groupBy(by).agg(F.min(F.struct(F.col(metric), F.col("run"))).alias("_b"))
    return m.select(by, F.col("_b.run").alias("run"), F.col(f"_b.{metric}").alias(metric))


# fixed values: headline name -> path in a nested result
HEADLINE = {
    "d_z": "information.d_z", "n_active": "information.n_active", "total_correlation": "information.total_correlation",
    "intrinsic_dim": "posterior_geometry.intrinsic_dim", "cluster_k": "posterior_geometry.cluster_k", "mmd_p_value": "posterior_geometry.mmd_p_value",
    "c2st_auc": "two_sample.c2st_auc", "feature_r2_mean": "features.r2_mean", "mig": "disentanglement.mig", "sap": "disentanglement.sap",
    "dci_disentanglement": "disentanglement.disentanglement", "decoder_mean_condition": "decoder_geometry.mean_condition",
    "encoder_n_live": "encoder_geometry.n_live_units", "asymmetry_mean": "symmetry.asymmetry_score_mean",
    "bone_plausibility": "generation.bone_plausibility_ratio_mean", "interp_curvature": "generation.interpolation_curvature",
    "mask_jitter_ratio": "masking.mask_jitter_ratio", "split_mpjpe_visible": "masking.split_mpjpe.mpjpe_visible",
    "split_mpjpe_inpainted": "masking.split_mpjpe.mpjpe_inpainted", "hmm_k": "dynamics.hmm_k", "n_segments": "dynamics.n_segments",
}


def headline_table(results: DataFrame, js: str = "result") -> DataFrame:
    """Flatten nested results to the headline metrics; a missing section gives NULL."""
    at = lambda p: F.get_json_object(js, f"$.{p}").try_cast("double")
    cols = {n: at(p) for n, p in HEADLINE.items()}
    cols["d_z"] = F.coalesce(at("information.d_z"), at("encoder_geometry.d_z"))
    cols["total_correlation"] = F.coalesce(at("information.total_correlation.total_correlation"), at("information.total_correlation"))
    out = results.withColumns(cols)
    return out.withColumn("active_frac", F.when(F.col("d_z") != 0, F.col("n_active") / F.col("d_z")))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    """Write a result; JSON and CSV for reports, Parquet otherwise."""
    w = df.write.mode("overwrite")
    if by:
        w = w.partitionBy(*by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
