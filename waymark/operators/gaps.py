"""Coverage gaps: where a track's frames jump."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.track import in_order, whole, with_steps

#: A gap is more than so many usual steps, and more than so many metres; frames a second.
MULTIPLE, FLOOR, FPS = 10.0, 50.0, 24.0


def with_threshold(points: DataFrame) -> DataFrame:
    """Points with their step and the track's usual step (the upper median) and threshold; null without steps."""
    df = with_steps(points)
    by_size = Window.partitionBy("track_id").orderBy(F.col("step").asc_nulls_last())
    df = df.withColumns({"__k": F.row_number().over(by_size) - 1, "__n": F.count("step").over(whole())})
    middle = F.when(F.col("step").isNotNull() & (F.col("__k") == F.floor(F.col("__n") / 2)), F.col("step"))
    df = df.withColumn("usual", F.max(middle).over(whole()))
    return df.withColumn("threshold", F.greatest(F.col("usual") * MULTIPLE, F.when(F.col("usual").isNotNull(), F.lit(FLOOR)))).drop("__k", "__n")


def gaps(points: DataFrame) -> DataFrame:
    """A row for each gap: track_id, frame (where it ends), metres, spans (adjacent jumps are one gap), from and to."""
    w = in_order()
    df = with_threshold(points).withColumns({"index": F.col("seq") - 1, "start": F.lag(F.struct("lat", "lng")).over(w), "end": F.struct("lat", "lng")})
    df = df.filter(F.col("step") > F.col("threshold"))
    df = df.withColumn("island", F.col("index") - F.row_number().over(w))
    out = df.groupBy("track_id", "island").agg((F.min("index") + 1).alias("frame"), F.sum("step").alias("metres"), F.count(F.lit(1)).alias("spans"), F.min_by("start", "index").alias("from"), F.max_by("end", "index").alias("to"))
    return out.drop("island")


def with_seconds(found: DataFrame, fps: float = FPS) -> DataFrame:
    return found.withColumn("seconds", F.col("frame") / fps)


def report(found: DataFrame, fps: float = FPS) -> DataFrame:
    """A line of text for each gap: when, how far, over how many frames, and where on a map."""
    over = F.when(F.col("spans") > 1, F.format_string(" over %d frames", "spans")).otherwise("")
    line = F.format_string("  %6.1fs  skips %5.0f m%s  https://www.google.com/maps/@%.6f,%.6f,17z", F.col("frame") / fps, "metres", over, "from.lat", "from.lng")
    return found.select("track_id", "frame", line.alias("line"))
