"""The whole way from track files to summaries, and on to rendered frames."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import text, vision
from waymark.operators import frames, gaps, maps, panos, render, track, view
from waymark.options import Options
from waymark.session import stored
from waymark.sources import fetch, gpx, summary


#: What a video is called unless --output says so.
VIDEO = "waymark.mp4"


@dataclass
class Planned:
    """Stages of a plan, each a table of many tracks."""

    points: DataFrame
    dense: DataFrame
    samples: DataFrame
    length: DataFrame


def sampled(points: DataFrame, per_mile: float = track.FRAMES_PER_MILE, interp: int | None = None) -> Planned:
    """Points cut finely enough, then one evenly spaced sample for each expected frame, with bearings."""
    stepped = track.with_steps(points)
    size = track.lengths(stepped).withColumn("wanted", track.expected_frames(F.col("length"), per_mile))
    size = size.withColumn("factor", track.densify_factor(F.col("wanted"), F.col("points") - 1, interp)).select("track_id", "wanted", "factor")
    dense = track.densify(points.join(size, "track_id"), "factor")
    dense = track.with_steps(dense)
    samples = track.with_bearings(track.sample_even(dense, "wanted"))
    return Planned(points, dense, samples.select("track_id", "seq", "lat", "lng", "ele", "bearing"), track.lengths(dense))


def looked_up(samples: DataFrame, fetcher: fetch.Fetcher, key: str, cache: str | None = None, concurrency: int = fetch.CONCURRENCY) -> DataFrame:
    """Samples with what the lookup service says about them."""
    asked = samples.select("track_id", "seq", text.lookup_url(F.col("lat"), F.col("lng"), key).alias("url"))
    answers = fetch.fetch_cached(asked, fetcher, cache, "metadata", concurrency=concurrency)
    return panos.zip_lookups(samples, fetch.parsed_lookups(answers))


def dry_run(spark: SparkSession, options: Options, fetcher: fetch.Fetcher, cache: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Summaries of all tracks, and the lines that report their gaps."""
    if options.use_metadata:
        out = summary.read(spark, options.input_path)
        return out, gaps.report(gaps.gaps(summary.points(out)))
    points = gpx.read_points(spark, options.input_path).select("track_id", "seq", "lat", "lng", "ele")
    plan = sampled(points, options.frames_per_mile, options.interp)
    # written down: requests, their answers and the panoramas are all made from them
    samples = stored(plan.samples, "samples")
    best = panos.best_of_runs(looked_up(samples, fetcher, options.api_key, None if options.no_cache else cache, options.network_concurrency))
    out = panos.summary(best, points, plan.length, gpx.read_headers(spark, options.input_path))
    return out, gaps.report(gaps.gaps(best))


def overlay(options: Options) -> render.Overlay | None:
    """Where the padded map lies in the video."""
    if options.minimap == "off":
        return None
    spark = SparkSession.getActiveSession()
    size = view.plan_size(F.lit(render.WIDTH), F.lit(render.HEIGHT), F.lit(options.minimap_size))
    x, y, s = view.overlay_geometry(F.lit(options.minimap_position), F.lit(render.WIDTH), F.lit(render.HEIGHT), size, F.lit(options.minimap_margin))
    row = spark.range(1).select(x.alias("x"), y.alias("y"), s.alias("size")).first()
    return render.Overlay(row["x"], row["y"], row["size"])


def map_size(options: Options) -> int:
    return max(1, min(render.WIDTH, render.HEIGHT) * options.minimap_size // 100)


#: What the choice of frames may be told, and how that is called here.
CHOICE = {"ratio_test": 0.75, "n_features": 360, "velocity_factor": 100.0}


def track_folder(folder: str) -> Column:
    """Each track's own folder below one."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.sha2(F.col("track_id").cast("string"), 256))


def chosen_frames(pictures: DataFrame, argument: str | None = None, decode: Callable | None = None) -> DataFrame:
    """track_id, kept: the frames on the cheapest path through pictures (track_id, seq, body); argument: JSON that overrides CHOICE."""
    told = CHOICE | (json.loads(argument) if argument else {})
    if unknown := set(told) - set(CHOICE):
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    cost = partial(vision.match_cost, count=int(told["n_features"]), ratio=float(told["ratio_test"]))
    edges = frames.image_costs(pictures, decode, cost, velocity=float(told["velocity_factor"]))
    return frames.chosen(pictures, edges).select("track_id", "kept")


def rendered(spark: SparkSession, options: Options, summaries: DataFrame, fetcher: fetch.Fetcher, folder: str, cache: str | None = None, decode: Callable | None = None) -> DataFrame:
    """Fetches images and maps of the summaries' frames and writes them to folder/<sha256 of the track>; returns track_id, folder and frames.

    Images are {n}.jpg, maps {n}.map.png; after a choice of frames the kept
    images are {n}.opt.jpg and maps are drawn for these alone.  The maps are asked for one
    by way of a probe first; if that fails, nothing else is fetched and a
    RuntimeError says why.  The folder must be one that all executors share.
    """
    cache = None if options.no_cache else cache
    # written down: both are read many times from here on
    own = stored(frames.offset_limit(summary.points(summaries), options.offset_frames, options.max_frames), "frames")
    original = stored(summary.points(summaries, "originalPoints"), "original")
    size = map_size(options)

    def answered(urls: DataFrame, kind: str) -> DataFrame:
        return fetch.fetch_cached(urls, fetcher, cache, kind, concurrency=options.network_concurrency)

    def maps_or_raise(urls: DataFrame) -> DataFrame:
        got = answered(urls.withColumnRenamed("frame", "seq"), "map").persist()
        bad = fetch.first_error(got).select(text.failure_message(F.col("status"), F.col("message")).alias("m")).first()
        if bad:
            raise RuntimeError(bad["m"])
        return got

    def saved(files: DataFrame, name: Column) -> None:
        fetch.save_files(files.withColumn("__name", F.concat(track_folder(""), F.lit("/"), name)), "__name", folder)

    if options.minimap != "off":
        maps_or_raise(maps.probe_urls(options.minimap, original, own, options.minimap_zoom, size, options.api_key))
    images = own.select("track_id", "seq", text.imagery_url(F.col("lat"), F.col("lng"), F.col("bearing"), options.api_key).alias("url"))
    images = answered(images, "streetview").select("track_id", "seq", "body")
    saved(images, F.concat(F.col("seq").cast("string"), F.lit(".jpg")))
    if options.optimizer:
        tracks = own.select("track_id").distinct().withColumn("folder", track_folder(folder))
        if options.optimizer == "path":
            kept = stored(chosen_frames(images, options.optimizer_arg, decode), "kept")
            render.rename_kept(kept.withColumn("folder", track_folder(folder)))
        else:
            kept = stored(render.optimized(tracks, options.optimizer, options.optimizer_arg), "kept")
        own = stored(frames.gather(own, kept), "frames")
    if options.minimap != "off":
        got = maps_or_raise(maps.map_urls(options.minimap, original, own, options.minimap_zoom, size, options.api_key))
        frame = view.framing(view.union_lines(original, own), size) if options.minimap == "overview" else None
        saved(render.overlay_frames(own, got, options.minimap, frame, size), F.col("name"))
    return own.groupBy("track_id").agg(F.count(F.lit(1)).alias("frames")).select("track_id", track_folder(folder).alias("folder"), "frames")


def filmed(options: Options, tracks: DataFrame, tell: Callable[[str], None] = lambda _: None, command: str = "ffmpeg") -> DataFrame:
    """track_id, video, bytes for what rendered() has returned.

    A single track's video is written to --output from here, with its progress;
    those of several tracks to their folders, side by side on the executors.
    """
    mode, over, optimized = render.motion(options.minterp), overlay(options), options.optimizer is not None
    out = options.output or VIDEO
    some = tracks.filter("frames > 0").limit(2).collect()
    if len(some) != 1:
        return render.videos(tracks, mode, over, os.path.basename(out), optimized, command)
    path = os.path.abspath(out)
    render.make_video(some[0]["folder"], some[0]["frames"], mode, over, path, optimized, tell, command)
    return tracks.sparkSession.createDataFrame([(some[0]["track_id"], path, os.path.getsize(path))], render.VIDEO_SCHEMA)
