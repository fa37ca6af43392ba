"""Requests for map images, thinned to a length that the map service accepts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.view import follow_runs, framing, lines, union_lines
from waymark.session import ship

#: Longest URL, and the styles of the planned track and of the panoramas' line.
LONGEST = 8192
TRACK_STYLE, PANORAMA_STYLE = "color:0x1e88e5ff|weight:5", "color:0xff6d00ff|weight:2"
BASE = "https://maps.googleapis.com/maps/api/staticmap"


def plain(x: float) -> str:
    return np.format_float_positional(x, trim="-")


def encode(lat: np.ndarray, lng: np.ndarray) -> str:
    """Polyline of points, percent-encoded for a URL."""
    e5 = np.stack([lat, lng], axis=1) * 1e5
    e5 = (np.sign(e5) * np.floor(np.abs(e5) + 0.5)).astype(np.int64)  # halves away from zero
    d = np.diff(e5, axis=0, prepend=0).reshape(-1)
    z = np.where(d < 0, -2 * d - 1, 2 * d)
    parts = (z[:, None] >> (5 * np.arange(7))) & 31
    more = (z[:, None] >> (5 * np.arange(1, 8))) > 0
    used = np.concatenate([np.ones((len(z), 1), bool), more[:, :-1]], axis=1)
    codes = (parts + np.where(more, 32, 0) + 63)[used]
    return "".join(_QUOTED[codes].tolist())


def _quote(c: int) -> str:
    return chr(c) if chr(c).isalnum() or chr(c) in "-_.~" else f"%{c:02X}"


_QUOTED = np.array([_quote(c) for c in range(128)], object)


def _style(style: str) -> str:
    return "".join(_QUOTED[np.frombuffer(f"{style}|enc:".encode(), np.uint8)].tolist())


class Line:
    """Runs of one line, and how it is drawn."""

    def __init__(self, runs: list[np.ndarray], style: str):
        self.runs, self.head = runs, f"&path={_style(style)}"

    def points(self) -> int:
        return max(1, sum(map(len, self.runs)))

    def drawn(self, budget: int, most: int) -> str:
        """The `most` longest runs in their order, each with its share of the budget of points, two at least."""
        order = sorted(range(len(self.runs)), key=lambda i: -len(self.runs[i]))[:most]
        some = [self.runs[i] for i in sorted(order)]
        total = max(1, sum(map(len, some)))
        out = []
        for run in some:
            if len(run) < 2:
                continue
            share = max(2, budget * len(run) // total)
            if len(run) > share:
                at = np.arange(share) * ((len(run) - 1) / (share - 1))
                run = run[np.floor(at + 0.5).astype(np.int64)]
            out.append(self.head + encode(run[:, 0], run[:, 1]))
        return "".join(out)


def map_url(lat: float, lng: float, zoom: int, size: int, track: list[np.ndarray], panorama: list[np.ndarray], key: str) -> str:
    """The request for one map with both lines on it; runs are arrays of (lat, lng).

    As long as it is too long the budget of points is halved, down to two for a
    run; then the number of runs, down to one.  Beyond that it stays too long.
    """
    both = Line(track, TRACK_STYLE), Line(panorama, PANORAMA_STYLE)
    head = f"{BASE}?center={plain(lat)},{plain(lng)}&zoom={zoom}&size={size}x{size}&scale=2&maptype=roadmap"
    budget, most = max(x.points() for x in both), max(1, *(len(x.runs) for x in both))
    while True:
        url = head + "".join(x.drawn(budget, most) for x in both) + f"&key={key}"
        if len(url) <= LONGEST or (budget <= 2 and most <= 1):
            return url
        if budget > 2:
            budget //= 2
        else:
            most //= 2


def url_column(lat: Column, lng: Column, zoom: Column, size: Column, track: Column, panorama: Column, key: str) -> Column:
    """map_url() of each row; track and panorama are arrays of runs, these arrays of (lat, lng). An Arrow UDF: the thinning is a loop."""

    def runs(rows) -> list[np.ndarray]:
        return [np.array([(p["lat"], p["lng"]) for p in run], float).reshape(-1, 2) for run in rows or []]

    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if r["lat"] is None else map_url(r["lat"], r["lng"], r["zoom"], r["size"], runs(r["track"]), runs(r["panorama"]), key) for r in batch.to_pylist()], pa.string())

    ship()
    make.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(make, "string")(F.struct(lat.alias("lat"), lng.alias("lng"), zoom.cast("int").alias("zoom"), size.cast("int").alias("size"), track.alias("track"), panorama.alias("panorama")))


def overview_urls(track: DataFrame, panorama: DataFrame, size: int, key: str) -> DataFrame:
    """One request for each track, framed to show both lines."""
    frame = framing(union_lines(track, panorama), size).select("track_id", "center_lat", "center_lng", "zoom")
    whole = frame.join(lines(track).withColumnRenamed("points", "t"), "track_id", "left").join(lines(panorama).withColumnRenamed("points", "p"), "track_id", "left")
    one = lambda c: F.when(F.col(c).isNull(), F.array()).otherwise(F.array(c))
    return whole.select("track_id", F.lit(0).alias("frame"), url_column(F.col("center_lat"), F.col("center_lng"), F.col("zoom"), F.lit(size), one("t"), one("p"), key).alias("url"))


def _runs_of(frames: DataFrame, line: DataFrame, zoom: int, size: int, name: str) -> DataFrame:
    runs = follow_runs(frames, line, zoom, size)
    return runs.groupBy("track_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "points"))), lambda r: r["points"]).alias(name))


def follow_urls(track: DataFrame, panorama: DataFrame, zoom: int, size: int, key: str, frames: DataFrame | None = None) -> DataFrame:
    """A request for each frame (by default each point of panorama), centered on it, with what its window shows of both lines."""
    frames = panorama.select("track_id", F.col("seq").alias("frame"), "lat", "lng") if frames is None else frames
    df = frames.join(_runs_of(frames, track, zoom, size, "t"), ["track_id", "frame"], "left").join(_runs_of(frames, panorama, zoom, size, "p"), ["track_id", "frame"], "left")
    return df.select("track_id", "frame", url_column(F.col("lat"), F.col("lng"), F.lit(zoom), F.lit(size), F.col("t"), F.col("p"), key).alias("url"))


def probe_urls(mode: str, track: DataFrame, panorama: DataFrame, zoom: int, size: int, key: str) -> DataFrame:
    """The first request of each track, to see whether the service answers before anything is paid for."""
    if mode == "overview":
        return overview_urls(track, panorama, size, key)
    first = panorama.withColumn("__k", F.row_number().over(Window.partitionBy("track_id").orderBy("seq"))).filter("__k = 1")
    return follow_urls(track, panorama, zoom, size, key, first.select("track_id", F.col("seq").alias("frame"), "lat", "lng"))


def map_urls(mode: str, track: DataFrame, panorama: DataFrame, zoom: int, size: int, key: str) -> DataFrame:
    return overview_urls(track, panorama, size, key) if mode == "overview" else follow_urls(track, panorama, zoom, size, key)
