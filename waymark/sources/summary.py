"""Summary files: one JSON object for each track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["distance", "frames", "gpsPoints", "originalPoints", "averageError", "name", "fileSizeBytes"]
SCHEMA = """distance double, frames bigint, gpsPoints array<struct<lat: double, lng: double, bearing: double, ele: double>>,
originalPoints array<struct<lat: double, lng: double, ele: double>>, averageError double, name string, fileSizeBytes bigint"""


def to_json(summary: DataFrame) -> DataFrame:
    """track_id, value: the summary as JSON with its fixed keys; missing elevations are null, not left out."""
    return summary.select("track_id", F.to_json(F.struct(*KEYS), {"ignoreNullFields": "false"}).alias("value"))


def to_text(summary: DataFrame) -> DataFrame:
    """track_id, value: the summary for people."""
    counts = F.format_string("distance: %.3f, frames: %d, averageError: %.3f, name: %s, fileSizeBytes: %d, gpsPoints: %d, originalPoints: %d", "distance", "frames", "averageError", "name", "fileSizeBytes", F.size("gpsPoints"), F.size("originalPoints"))
    return summary.select("track_id", counts.alias("value"))


def write(summary: DataFrame, path: str) -> None:
    to_json(summary).select("value").write.text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Summaries from files of JSON objects, each over one or more lines; track_id is the file."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True, mode="FAILFAST").withColumn("track_id", F.input_file_name())


def points(summary: DataFrame, which: str = "gpsPoints") -> DataFrame:
    """The points of summaries as rows: track_id, seq, lat, lng, (bearing,) ele."""
    return summary.select("track_id", F.posexplode(which).alias("seq", "p")).select("track_id", F.col("seq").cast("long").alias("seq"), "p.*")
