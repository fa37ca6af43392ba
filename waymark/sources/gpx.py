"""Track files: GPX in, rows of points out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Name of a track without one, bytes a point counts for.
NO_NAME, POINT_BYTES = "Unnamed GPX File", 32

SCHEMA = "metadata struct<name string>, trk array<struct<trkseg: array<struct<trkpt: array<struct<_lat: double, _lon: double, ele: double>>>>>>"


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "gpx").schema(SCHEMA).load(path if isinstance(path, str) else ",".join(path)).withColumn("track_id", F.input_file_name())


def read_points(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Points of GPX files in document order: track_id (the file), seq, trk, seg, lat, lng, ele.

    Tracks and segments of a file follow one another; trk and seg say where a
    point comes from.  Waypoints and routes are left out.
    """
    df = _files(spark, path).select("track_id", F.posexplode("trk").alias("trk", "t"))
    df = df.select("track_id", "trk", F.posexplode("t.trkseg").alias("seg", "s"))
    df = df.select("track_id", "trk", "seg", F.posexplode("s.trkpt").alias("pos", "p"))
    seq = F.row_number().over(Window.partitionBy("track_id").orderBy("trk", "seg", "pos")).cast("long") - 1
    return df.select("track_id", seq.alias("seq"), "trk", "seg", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lng"), F.col("p.ele").alias("ele"))


def read_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row for each file: track_id, name (of its metadata), points, fileSizeBytes (an estimate)."""
    n = F.aggregate(F.coalesce(F.flatten(F.transform("trk", lambda t: t["trkseg"])), F.array()), F.lit(0).cast("long"), lambda a, s: a + F.greatest(F.lit(0), F.coalesce(F.size(s["trkpt"]), F.lit(0))))
    df = _files(spark, path).select("track_id", F.coalesce("metadata.name", F.lit(NO_NAME)).alias("name"), n.alias("points"))
    return df.withColumn("fileSizeBytes", F.col("points") * POINT_BYTES)
