"""Operators on tracks: rows (track_id, seq, lat, lng, ele) with seq dense from 0.

All of them are windows over one partitioning and order, so that a chain of
them needs a single shuffle and sort.  Tracks of fewer than two points have no
steps and no bearings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo

#: Metres that count as a mile, frames a mile, what is taken off the number of samples.
MILE, FRAMES_PER_MILE, SAMPLE_SLACK = 1600.0, 100.0, 0.99


def in_order() -> Window:
    return Window.partitionBy("track_id").orderBy("seq")


def so_far() -> Window:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole() -> Window:
    return Window.partitionBy("track_id")


def resequenced(df: DataFrame, *order: str) -> DataFrame:
    """df with seq counted anew from 0 in the order of the columns."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy("track_id").orderBy(*(order or ["seq"]))).cast("long") - 1)


def with_steps(points: DataFrame, out: str = "step") -> DataFrame:
    """Metres from the previous point; null for the first."""
    w = in_order()
    df = points.withColumns({"__lat": F.lag("lat").over(w), "__lng": F.lag("lng").over(w)})
    return geo.with_distance(df, "__lat", "__lng", "lat", "lng", out).drop("__lat", "__lng")


def with_running(points: DataFrame, step: str = "step", out: str = "running") -> DataFrame:
    """Metres along the track up to each point."""
    return points.withColumn(out, F.sum(F.coalesce(step, F.lit(0.0))).over(so_far()))


def lengths(points: DataFrame, step: str = "step") -> DataFrame:
    """A row for each track: length in metres, points."""
    return points.groupBy("track_id").agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("length"), F.count(F.lit(1)).alias("points"))


def expected_frames(length: Column, per_mile: float = FRAMES_PER_MILE) -> Column:
    return (per_mile * length / MILE).cast("long")


def densify_factor(frames: Column, steps: Column, interp: int | None = None) -> Column:
    """How finely steps are cut: interp if given, else so that there are at least as many points as frames; null without steps."""
    return F.when(steps > 0, F.lit(interp) if interp is not None else F.floor(frames / F.nullif(steps, F.lit(0))) + 1).cast("int")


def densify(points: DataFrame, factor: str | int = "factor") -> DataFrame:
    """Points at factor - 1 even places inside each step; the tracks' own points only where factor is below 2 (or null).

    A step between equal positions has no points inside.  Elevation runs one
    place behind: the first inner point has the elevation of the step's start.
    """
    factor = F.lit(factor) if isinstance(factor, int) else F.col(factor)
    w = in_order()
    df = points.withColumns({"__f": F.coalesce(factor, F.lit(1)), "__lat": F.lead("lat").over(w), "__lng": F.lead("lng").over(w), "__ele": F.lead("ele").over(w)})
    inside = F.when((F.col("lat") != F.col("__lat")) | (F.col("lng") != F.col("__lng")), F.sequence(F.lit(1), F.col("__f") - 1))
    df = df.withColumn("__j", F.explode(F.when(F.col("__f") < 2, F.array(F.lit(0))).otherwise(inside)))
    share = F.col("__j") / F.col("__f")
    df = geo.with_between(df, "lat", "lng", "__lat", "__lng", share, "__at_lat", "__at_lng")
    own = F.col("__j") == 0
    df = df.withColumns({"lat": F.when(own, F.col("lat")).otherwise(F.col("__at_lat")), "lng": F.when(own, F.col("lng")).otherwise(F.col("__at_lng")), "ele": F.when(own, F.col("ele")).otherwise(F.col("ele") + (F.col("__ele") - F.col("ele")) * ((F.col("__j") - 1) / F.col("__f")))})
    return resequenced(df, "seq", "__j").select(points.columns)


def sample_even(points: DataFrame, n: str | int, step: str = "step") -> DataFrame:
    """Up to n points of each track, evenly by distance: a point is taken if it is as far along as the next sample is due.

    Going through the points, the k-th sample (from 0) is the first point at or
    beyond k * length / (n - 0.99), one sample for a point at most.  In closed form:
    with t(i) the samples due by point i, taken(i) = min(i + 1, min over j <= i
    of t(j) + i - j).
    """
    n = F.lit(n) if isinstance(n, int) else F.col(n)
    df = with_running(points, step, "__run").withColumn("__gap", F.sum(F.coalesce(step, F.lit(0.0))).over(whole()) / (n - SAMPLE_SLACK))
    m = F.floor(F.col("__run") / F.nullif("__gap", F.lit(0.0)))
    df = df.withColumn("__m", m)
    # the quotient may be off by a rounding; the product decides
    due = F.when(F.col("__gap") * (F.col("__m") + 1) <= F.col("__run"), F.col("__m") + 2).when(F.col("__gap") * F.col("__m") > F.col("__run"), F.col("__m")).otherwise(F.col("__m") + 1)
    df = df.withColumn("__late", F.coalesce(due, F.lit(1 << 60)) - F.col("seq"))
    df = df.withColumn("__taken", F.least(F.col("seq") + 1, F.col("seq") + F.min("__late").over(so_far())))
    before = F.coalesce(F.lag("__taken").over(in_order()), F.lit(0))
    df = df.withColumn("__new", (F.col("__taken") > before) & (F.col("__taken") <= n)).filter("__new")
    return resequenced(df).select(points.columns)


def with_bearings(points: DataFrame, out: str = "bearing") -> DataFrame:
    """Bearing to the next point; the last point keeps the one before; tracks of one point are dropped."""
    w = in_order()
    df = points.withColumns({"__lat": F.lead("lat").over(w), "__lng": F.lead("lng").over(w)})
    df = df.withColumn("__b", geo.bearing("lat", "lng", "__lat", "__lng"))
    df = df.withColumn(out, F.coalesce("__b", F.lag("__b").over(w)))
    return df.filter(F.col(out).isNotNull()).drop("__lat", "__lng", "__b")
