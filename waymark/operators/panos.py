"""Panoramas found for the points of a track: filter, consecutive runs, the best point of each, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators.track import in_order, resequenced, so_far

OK = "OK"


def zip_lookups(points: DataFrame, lookups: DataFrame) -> DataFrame:
    """Points with what was found for them, by position."""
    return points.join(lookups, ["track_id", "seq"])


def found(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status") == OK)


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce(F.col("status") != OK, F.lit(True)))


def with_runs(rows: DataFrame) -> DataFrame:
    """Number of the run of equal pano_id that a row belongs to, among the rows that are there."""
    w = in_order()
    new = F.lag("seq").over(w).isNotNull() & ~F.col("pano_id").eqNullSafe(F.lag("pano_id").over(w))
    return rows.withColumn("__new", new.cast("int")).withColumn("run", F.sum("__new").over(so_far())).drop("__new")


def best_of_runs(rows: DataFrame) -> DataFrame:
    """Of each run the point nearest to its panorama, the first on a tie; the asked-for point stays, not the panorama's."""
    rows = geo.with_distance(with_runs(found(rows)), "lat", "lng", "pano_lat", "pano_lng", "err")
    order = Window.partitionBy("track_id", "run").orderBy(F.col("err").asc_nulls_last(), "seq")
    return resequenced(rows.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank"))


def summary(best: DataFrame, original: DataFrame, distance: DataFrame, names: DataFrame) -> DataFrame:
    """A row for each track in the form of the summary file.

    distance (track_id, length) is the length that is reported, names (track_id, name,
    fileSizeBytes) come from the track file.
    """
    gps = best.groupBy("track_id").agg(F.count(F.lit(1)).alias("frames"), F.avg("err").alias("averageError"), F.array_sort(F.collect_list(F.struct("seq", "lat", "lng", "bearing", "ele"))).alias("g"))
    own = original.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng", "ele"))).alias("o"))
    out = gps.join(own, "track_id").join(distance.select("track_id", "length"), "track_id").join(names, "track_id")
    point = lambda *names: lambda p: F.struct(*(p[n].alias(n) for n in names))
    return out.select(
        "track_id",
        F.col("length").alias("distance"),
        "frames",
        F.transform("g", point("lat", "lng", "bearing", "ele")).alias("gpsPoints"),
        F.transform("o", point("lat", "lng", "ele")).alias("originalPoints"),
        "averageError",
        "name",
        "fileSizeBytes",
    )

