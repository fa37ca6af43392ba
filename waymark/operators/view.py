"""What a map shows: bounds, framing, clipping to a window, runs, thinning, polylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.text import downsample, polyline
from waymark.operators.track import in_order


def union_lines(track: DataFrame, panorama: DataFrame) -> DataFrame:
    return track.select("track_id", "lat", "lng").unionByName(panorama.select("track_id", "lat", "lng"))


def bounds(points: DataFrame) -> DataFrame:
    """A row for each track: north, south, east, west; no row without points."""
    return points.groupBy("track_id").agg(F.max("lat").alias("north"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.min("lng").alias("west"))


def framing(points: DataFrame, size: int) -> DataFrame:
    """bounds() with the center and zoom at which a map of `size` pixels shows them all."""
    box = bounds(points)
    return box.withColumns({"center_lat": (F.col("north") + F.col("south")) / 2, "center_lng": (F.col("east") + F.col("west")) / 2, "zoom": geo.fit_zoom("north", "south", "east", "west", size)})


def with_visible(points: DataFrame, center_lat, center_lng, zoom, size) -> DataFrame:
    """Points with visible (in the window) and kept (visible, or next to a visible one)."""
    x, y = geo.project("lat", "lng", center_lat, center_lng, zoom, size)
    w = in_order()
    df = points.withColumn("visible", geo.on_screen(x, y, size))
    near = F.col("visible") | F.coalesce(F.lag("visible").over(w), F.lit(False)) | F.coalesce(F.lead("visible").over(w), F.lit(False))
    return df.withColumn("kept", near)


def visible_runs(points: DataFrame, center_lat, center_lng, zoom, size) -> DataFrame:
    """The kept points of each track in runs without a break: track_id, run, points."""
    df = with_visible(points, center_lat, center_lng, zoom, size).filter("kept")
    df = df.withColumn("__island", F.col("seq") - F.row_number().over(in_order()))
    return _gathered(df, ["track_id"])


def _gathered(df: DataFrame, keys: list[str]) -> DataFrame:
    runs = df.groupBy(*keys, "__island").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng"))).alias("p"))
    order = Window.partitionBy(*keys).orderBy(F.get("p", F.lit(0))["seq"])
    runs = runs.withColumn("run", F.row_number().over(order) - 1)
    return runs.select(*keys, "run", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng"))).alias("points"))


def follow_runs(frames: DataFrame, line: DataFrame, zoom: int, size: int) -> DataFrame:
    """What each frame's window shows of a line: track_id, frame, run, points.

    frames: track_id, frame, lat, lng.  Instead of every frame with every point,
    the world is cut into tiles as large as the window; a frame meets only the
    points in its own and the eight tiles around.
    """
    scale = float(1 << zoom)
    tile = lambda w: F.floor(w * scale / size).cast("long")
    near = F.explode(F.array(*(F.struct((tile(geo.world_x("lng")) + i).alias("tx"), (tile(geo.world_y("lat")) + j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    f = frames.select("track_id", "frame", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"), near.alias("t")).select("track_id", "frame", "c_lat", "c_lng", "t.*")
    p = line.select("track_id", "seq", "lat", "lng", tile(geo.world_x("lng")).alias("tx"), tile(geo.world_y("lat")).alias("ty"))
    x, y = geo.project("lat", "lng", "c_lat", "c_lng", zoom, size)
    seen = f.join(p, ["track_id", "tx", "ty"]).filter(geo.on_screen(x, y, size)).select("track_id", "frame", "seq")
    kept = seen.select("track_id", "frame", F.explode(F.array(F.col("seq") - 1, F.col("seq"), F.col("seq") + 1)).alias("seq")).distinct()
    kept = kept.join(line.select("track_id", "seq", "lat", "lng"), ["track_id", "seq"])
    kept = kept.withColumn("__island", F.col("seq") - F.row_number().over(Window.partitionBy("track_id", "frame").orderBy("seq")))
    return _gathered(kept, ["track_id", "frame"])


def longest(runs: DataFrame, most: int, *keys: str) -> DataFrame:
    """The `most` longest runs of each track (or other keys), the earlier ones on a tie."""
    order = Window.partitionBy(*(keys or ["track_id"])).orderBy(F.size("points").desc(), "run")
    return runs.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= most).drop("__rank")


def lines(points: DataFrame) -> DataFrame:
    """Each track's points as one array."""
    g = points.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng"))).alias("p"))
    return g.select("track_id", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng"))).alias("points"))


def with_deltas(points: DataFrame) -> DataFrame:
    """Points with the differences a polyline is made of: d_lat, d_lng in 1e-5 degrees."""
    e5 = lambda c: F.round(F.col(c) * 100000.0).cast("long")
    w = in_order()
    df = points.withColumns({"e_lat": e5("lat"), "e_lng": e5("lng")})
    return df.withColumns({"d_lat": F.col("e_lat") - F.lag("e_lat", 1, 0).over(w), "d_lng": F.col("e_lng") - F.lag("e_lng", 1, 0).over(w)}).drop("e_lat", "e_lng")


def encoded(points: DataFrame, most: int = 0) -> DataFrame:
    """Each track as a polyline of at most `most` points (0: all)."""
    return lines(points).select("track_id", polyline(downsample(F.col("points"), most) if most else F.col("points")).alias("polyline"))


# what is drawn over the video


def plan_size(width: Column, height: Column, percent: Column) -> Column:
    """Side of the map in video pixels."""
    return F.greatest(F.lit(1), F.floor(F.least(width, height) * percent / 100)).cast("int")


def overlay_offsets(position: Column, width: Column, height: Column, size: Column, margin: Column) -> tuple[Column, Column]:
    """Top-left corner of the map in the video for a position tl, tr, bl or br."""
    far = lambda extent: F.greatest(F.lit(0), extent - size - margin)
    near = lambda extent: F.least(margin, far(extent))
    x = F.when(position.isin("tl", "bl"), near(width)).when(position.isin("tr", "br"), far(width))
    y = F.when(position.isin("tl", "tr"), near(height)).when(position.isin("bl", "br"), far(height))
    return x.cast("int"), y.cast("int")


def dot_ring(image_size: Column) -> Column:
    """Radius of the ring around the position dot, in image pixels."""
    r = F.greatest(F.lit(2.5), image_size / 34.0)
    return r + F.greatest(F.lit(1.0), r / 2.5)


def dot_pad(image_size: Column) -> Column:
    """Room around a map for a dot on its edge: whole video pixels."""
    return (F.ceil(F.ceil(dot_ring(image_size)) / geo.MAP_SCALE) * geo.MAP_SCALE).cast("int")


def overlay_geometry(position: Column, width: Column, height: Column, size: Column, margin: Column) -> tuple[Column, Column, Column]:
    """Corner and side of the padded map for the encoder; the corner may lie outside."""
    x, y = overlay_offsets(position, width, height, size, margin)
    pad = F.floor(dot_pad(size * geo.MAP_SCALE) / geo.MAP_SCALE).cast("int")
    return x - pad, y - pad, (size + pad * 2).cast("int")
