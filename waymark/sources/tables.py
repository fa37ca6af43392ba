"""Tracks and lookups derived from the supplied tables, which have no coordinates of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tracks: a user's events in order of time, placed by value and time; also event_type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = e.select(F.col("user_id").alias("track_id"), seq.alias("seq"), (47.0 + F.col("value") / 10000.0).alias("lat"), (-122.0 + (seconds - 1704067200.0) / 5184000.0).alias("lng"), F.when(F.col("event_type") == "error", None).otherwise(F.col("value")).alias("ele"), "event_type")
    return e


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).drop("event_type")


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lookup service would say of each point of tracks()."""
    t = tracks(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", "ZERO_RESULTS").otherwise("OK")
    return t.select("track_id", "seq", status.alias("status"), F.floor(F.col("lng") * 500).cast("string").alias("pano_id"), F.round("lat", 3).alias("pano_lat"), F.round("lng", 3).alias("pano_lng"))
