"""The supplied parquet tables read as movement tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.plans.chunks import ordered_index

# fixed values: event type -> state / joint number, in alphabetical order
EVENT_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_code(col: str = "event_type"):
    e = F.col(col)
    out = F.when(F.lit(False), F.lit(0))
    for word, code in EVENT_CODES.items():
        out = out.when(e == word, F.lit(code))
    return out


def state_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, m, state: each user's events in time order."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video"), "ts", "event_id", event_code().alias("state")
    )
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long")
    return ordered_index(e, ["video"], day, ["ts", "event_id"], "m").select("video", "m", "state")


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, frame, joint, x, y: one frame a day, with gaps where a user has no event of a kind."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(
        F.col("user_id").alias("video"),
        (F.dayofmonth("ts") - 1).cast("long").alias("frame"),
        event_code().alias("joint"),
    ).agg(F.avg("value").alias("x"), F.avg(F.get_json_object("props", "$.k").cast("double")).alias("y"))


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, video, start_frame, mu, logvar; the posterior width is a fixed function of mu."""
    e = table(spark, sf_dir, "embeddings")
    mu = F.col("embedding").cast("array<double>")
    return e.select(
        F.col("vec_id").alias("clip_id"),
        F.col("label").cast("long").alias("video"),
        F.col("vec_id").alias("start_frame"),
        mu.alias("mu"),
        F.transform(mu, lambda v: F.lit(0.5) * v - F.lit(1.0)).alias("logvar"),
    )


def subject_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric table per customer: entity, cohort, region, label, metric, value."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").cast("double").alias("n_orders"),
        F.sum("o_totalprice").alias("total_price"),
        F.avg("o_totalprice").alias("mean_price"),
        F.max("o_totalprice").alias("max_price"),
    )
    wide = c.join(o, "c_custkey", "left").select(
        F.col("c_custkey").alias("entity"),
        F.col("c_nationkey").cast("long").alias("cohort"),
        F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("label"),
        F.col("c_acctbal").alias("acctbal"), "n_orders", "total_price", "mean_price", "max_price",
    )
    return wide.unpivot(
        ["entity", "cohort", "label"], ["acctbal", "n_orders", "total_price", "mean_price", "max_price"],
        "metric", "value",
    )
