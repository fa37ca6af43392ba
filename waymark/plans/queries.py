"""A query for each operator over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.operators import frames, gaps, maps, panos, render, track, view
from waymark.plans.route import sampled
from waymark.sources import fetch, summary
from waymark.sources.tables import lookups, points

SAMPLES, SIZE, ZOOM, KEY = 20, 192, 10, "SECRET"
#: The window that is clipped to.
CENTER = (47.005, -121.8)

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}


def query(f: Query) -> Query:
    _all[f.__name__] = f
    return f


def metres(c: Column | str) -> Column:
    return F.round(c, 3)


def degrees(c: Column | str) -> Column:
    return F.round(c, 6)


def cut(c: str, places: float) -> Column:
    """Rounded down: halves are not the same everywhere."""
    return F.floor(F.col(c) * places) / places


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.with_steps(points(spark, sf_dir))


@query
def track_step_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).filter("step is not null").select("track_id", "seq", metres("step").alias("step"))


@query
def track_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.lengths(steps(spark, sf_dir)).select("track_id", metres("length").alias("length"), "points")


@query
def track_running_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.with_running(steps(spark, sf_dir)).select("track_id", "seq", metres("running").alias("running"))


@query
def track_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.with_bearings(points(spark, sf_dir)).select("track_id", "seq", degrees("bearing").alias("bearing"))


@query
def track_sample_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = track.with_bearings(track.sample_even(steps(spark, sf_dir), SAMPLES))
    return out.select("track_id", "seq", degrees("lat").alias("lat"), degrees("lng").alias("lng"), "ele", degrees("bearing").alias("bearing"))


@query
def track_expected_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.lengths(steps(spark, sf_dir)).select("track_id", track.expected_frames(F.col("length")).alias("frames"))


@query
def track_densify_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = track.expected_frames(F.col("length"))
    return track.lengths(steps(spark, sf_dir)).select("track_id", track.densify_factor(n, F.col("points") - 1).alias("factor"), track.densify_factor(n, F.col("points") - 1, 3).alias("given"))


@query
def track_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.densify(points(spark, sf_dir), 3).select("track_id", "seq", degrees("lat").alias("lat"), degrees("lng").alias("lng"), degrees("ele").alias("ele"))


@query
def route_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front half of the plan at one frame a mile: length, factor, densify, length again, samples, bearings."""
    s = sampled(points(spark, sf_dir), 1.0)
    return s.samples.groupBy("track_id").agg(F.count(F.lit(1)).alias("frames")).join(s.length, "track_id").select("track_id", "frames", metres("length").alias("length"), "points")


def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panos.zip_lookups(points(spark, sf_dir), lookups(spark, sf_dir))


@query
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zipped(spark, sf_dir).select("track_id", "seq", "status", "pano_id")


@query
def pano_filter_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panos.found(zipped(spark, sf_dir)).select("track_id", "seq", "pano_id")


@query
def pano_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panos.rejected(zipped(spark, sf_dir)).select("track_id", "seq", "status")


@query
def pano_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panos.with_runs(panos.found(zipped(spark, sf_dir))).select("track_id", "seq", "run", "pano_id")


@query
def pano_run_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panos.best_of_runs(zipped(spark, sf_dir)).select("track_id", "seq", "run", "pano_id", degrees("lat").alias("lat"), degrees("lng").alias("lng"), metres("err").alias("err"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    best = panos.best_of_runs(panos.zip_lookups(track.with_bearings(own), lookups(spark, sf_dir)))
    length = track.lengths(steps(spark, sf_dir))
    names = length.select("track_id", F.concat(F.lit("track "), F.col("track_id").cast("string")).alias("name"), (F.col("points") * 32).alias("fileSizeBytes"))
    return panos.summary(best, own, length, names)


@query
def pano_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summaries(spark, sf_dir)
    return s.select("track_id", metres("distance").alias("distance"), "frames", F.size("gpsPoints").cast("long").alias("gps_points"), F.size("originalPoints").cast("long").alias("original_points"), metres("averageError").alias("average_error"), "name", F.col("fileSizeBytes").alias("file_size_bytes"))


@query
def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries as JSON and read back."""
    j = summary.to_json(summaries(spark, sf_dir))
    back = j.select("track_id", F.from_json("value", summary.SCHEMA).alias("s")).select("track_id", "s.*")
    return back.select("track_id", "frames", F.element_at("gpsPoints", -1)["ele"].alias("last_ele"), "name")


@query
def gap_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.with_threshold(points(spark, sf_dir)).filter("threshold is not null").select("track_id", metres("usual").alias("usual"), metres("threshold").alias("threshold")).distinct()


def found_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a thinned track, so that its usual step is small beside its jumps."""
    own = points(spark, sf_dir).withColumn("lat", F.when(F.col("seq") % 37 == 0, F.col("lat")).otherwise(47.0))
    return gaps.gaps(own.withColumn("lng", -122.0 + F.col("seq") / 1e5 + F.when(F.col("seq") % 37 < 2, F.col("lng") + 122.0).otherwise(0.0)))


@query
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_gaps(spark, sf_dir).select("track_id", "frame", metres("metres").alias("metres"), "spans", degrees("from.lat").alias("from_lat"), degrees("from.lng").alias("from_lng"), degrees("to.lat").alias("to_lat"), degrees("to.lng").alias("to_lng"))


@query
def gap_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.with_seconds(found_gaps(spark, sf_dir)).select("track_id", "frame", degrees("seconds").alias("seconds"))


@query
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.report(found_gaps(spark, sf_dir))


@query
def track_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.bounds(points(spark, sf_dir)).select("track_id", *(degrees(c).alias(c) for c in ("north", "south", "east", "west")))


@query
def track_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.framing(points(spark, sf_dir), SIZE).select("track_id", F.round("center_lat", 8).alias("center_lat"), F.round("center_lng", 8).alias("center_lng"), "zoom")


@query
def mercator_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("track_id", "seq", degrees(geo.world_x("lng")).alias("x"), degrees(geo.world_y("lat")).alias("y"))


@query
def image_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.image_pixel("lat", "lng", *CENTER, ZOOM, SIZE)
    return points(spark, sf_dir).select("track_id", "seq", metres(x).alias("x"), metres(y).alias("y"))


@query
def fit_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of twenty sizes at all points."""
    d = F.col("seq") % 20 / 7.0
    return points(spark, sf_dir).select("track_id", "seq", geo.fit_zoom(F.col("lat") + d, F.col("lat"), F.col("lng") + d * 1.5, F.col("lng"), SIZE).alias("zoom"))


@query
def clip_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.with_visible(points(spark, sf_dir), *CENTER, ZOOM, SIZE).select("track_id", "seq", "visible", "kept")


@query
def clip_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.visible_runs(points(spark, sf_dir), *CENTER, ZOOM, SIZE).select("track_id", "run", F.size("points").cast("long").alias("n"), degrees(F.col("points")[0]["lng"]).alias("first_lng"))


@query
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.longest(view.visible_runs(points(spark, sf_dir), *CENTER, ZOOM + 3, SIZE), 2).select("track_id", "run", F.size("points").cast("long").alias("n"))


@query
def follow_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the window around each point shows of the track."""
    own = points(spark, sf_dir)
    f = own.select("track_id", F.col("seq").alias("frame"), "lat", "lng")
    return view.follow_runs(f, own, ZOOM + 2, SIZE).groupBy("track_id", "frame").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.size("points")).alias("n"))


@query
def downsample_even_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view.lines(points(spark, sf_dir)).select("track_id", F.posexplode(text.downsample(F.col("points"), 10)).alias("i", "p"))
    return d.select("track_id", F.col("i").cast("long").alias("i"), degrees("p.lat").alias("lat"), degrees("p.lng").alias("lng"))


@query
def polyline_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.with_deltas(points(spark, sf_dir)).select("track_id", "seq", "d_lat", "d_lng")


@query
def polyline_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.encoded(points(spark, sf_dir))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    n = F.col("page_id").cast("string")
    return p.select("page_id", F.concat("url", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("?key=K"), n, F.lit("&a b=*~é"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("?q="), n, F.lit("&key=K"), n)).otherwise("")).alias("url"))


@query
def url_strip_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls(spark, sf_dir).select("page_id", text.without_key(F.col("url")).alias("url"))


@query
def url_redact_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls(spark, sf_dir).select("page_id", text.redact_key(F.concat(F.lit("error for url ("), "url", F.lit(") after 3 s"))).alias("message"))


@query
def url_percent_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls(spark, sf_dir).select("page_id", text.percent_encode(F.col("url")).alias("url"))


@query
def url_fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls(spark, sf_dir).select("page_id", text.digest(F.col("url")).alias("digest"))


@query
def cache_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "streetview").when(F.col("page_id") % 3 == 1, "map").otherwise("metadata")
    return urls(spark, sf_dir).select("page_id", text.cache_path("/cache", kind, text.digest(F.col("url"))).alias("path"))


@query
def request_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imagery and lookup requests, at positions that print alike everywhere."""
    lat, lng, b = cut("lat", 1e4), cut("lng", 1e4), cut("bearing", 10.0)
    return track.with_bearings(points(spark, sf_dir)).select("track_id", "seq", text.imagery_url(lat, lng, b, KEY).alias("image"), text.lookup_url(lat, lng, KEY).alias("lookup"))


@query
def map_failure_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(F.lit(401), F.lit(403), F.lit(500), F.lit(None).cast("int")), (F.col("page_id") % 4 + 1).cast("int"))
    return urls(spark, sf_dir).select("page_id", text.failure_message(status, F.concat(F.lit("refused "), "url")).alias("message"))


@query
def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which URLs a cache of every other page's would have answered."""
    own = urls(spark, sf_dir)
    have = own.filter("page_id % 2 = 0").select(text.digest(F.col("url")).alias("digest"), F.lit(b"x").alias("body"), F.lit("map").alias("kind"))
    hits, misses = fetch.hits_and_misses(own, have, "map")
    return hits.select("page_id", F.lit(True).alias("hit")).unionByName(misses.select("page_id", F.lit(False).alias("hit")))


@query
def lookup_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup answers through an injected fetcher: some lack fields."""

    def answer(url: str):
        import json
        from urllib.parse import parse_qs, urlsplit

        lat, lng = map(float, parse_qs(urlsplit(url).query)["location"][0].split(","))
        full = {"status": "OK", "pano_id": f"p{lat:.2f}", "location": {"lat": lat, "lng": lng}, "date": "2024-01", "copyright": "x"}
        return json.dumps(full if lat < 47.01 else {"status": "ZERO_RESULTS"}).encode(), 200, ""

    own = points(spark, sf_dir).select("track_id", "seq", text.lookup_url(cut("lat", 1e4), cut("lng", 1e4), KEY).alias("url"))
    return fetch.parsed_lookups(fetch.fetch(own, answer)).select("track_id", "seq", "status", "date", degrees("pano_lat").alias("pano_lat"), degrees("pano_lng").alias("pano_lng"))


@query
def frame_offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.offset_limit(points(spark, sf_dir), 5, 10).select("track_id", "seq", degrees("lat").alias("lat"))


@query
def frame_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    kept = own.groupBy("track_id").agg(F.array(F.max("seq"), F.lit(0), F.floor(F.max("seq") / 2)).alias("kept"))
    return frames.gather(own, kept).select("track_id", "seq", degrees("lat").alias("lat"))


@query
def frame_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.band_pairs(points(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up costs of pairs of frames, from their values."""
    own = points(spark, sf_dir)
    at = lambda k: own.select("track_id", F.col("seq").alias(k), F.floor(F.col("lat") * 1e6).alias(f"v_{k}"))
    e = frames.band_pairs(own).join(at("i"), ["track_id", "i"]).join(at("j"), ["track_id", "j"])
    c0, c_r = (F.abs(F.col("v_i") - F.col("v_j")) % 700).cast("double"), ((F.col("v_i") + F.col("v_j")) % 900).cast("double")
    match = frames.match_cost(c0, c_r, F.lit(800.0))
    return e.select("track_id", "i", "j", frames.edge_cost(match, F.col("i"), F.col("j")).alias("cost"))


@query
def frame_edge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@query
def frame_best_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.best_paths(edges(spark, sf_dir)).select("track_id", F.array_join("kept", ",").alias("kept"), "total")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up features: each point is six of a frame of its track, with descriptors from its place."""
    own = points(spark, sf_dir)
    return own.select("track_id", F.floor(F.col("seq") / 6).alias("seq"), (F.col("seq") % 6).alias("feature"), F.floor(F.col("lat") * 1e6 % 97).alias("response"), F.array(F.floor(F.col("lat") * 1e6) % 256, F.floor(F.col("lng") * -1e6) % 256).cast("array<double>").alias("descriptor"))


@query
def frame_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.top_features(features(spark, sf_dir), 3).select("track_id", "seq", "feature", "response")


@query
def frame_feature_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.feature_matches(features(spark, sf_dir))
    return out.select("track_id", "i", "j", "feature", "nearest", degrees("distance").alias("distance"))


@query
def frame_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls(spark, sf_dir).select("page_id", frames.frame_number(F.concat(F.lit("/out7/"), F.col("page_id").cast("string"), F.lit(".jpg"))).cast("long").alias("number"))


@query
def lines_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    return view.union_lines(own, own.filter("seq % 2 = 0")).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))


def settings(spark: SparkSession) -> DataFrame:
    """All corners with sizes and margins."""
    df = spark.range(1, 101).select(F.col("id").cast("int").alias("percent"), F.explode(F.array(*map(F.lit, ["tl", "tr", "bl", "br"]))).alias("position"))
    df = df.withColumn("margin", F.explode(F.array(F.lit(0), F.lit(12), F.lit(300))))
    return df.withColumn("size", view.plan_size(F.lit(render.WIDTH), F.lit(render.HEIGHT), F.col("percent")))


@query
def overlay_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = view.overlay_offsets(F.col("position"), F.lit(render.WIDTH), F.lit(render.HEIGHT), F.col("size"), F.col("margin"))
    return settings(spark).select("percent", "position", "margin", "size", x.alias("x"), y.alias("y"))


@query
def overlay_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, s = view.overlay_geometry(F.col("position"), F.lit(render.WIDTH), F.lit(render.HEIGHT), F.col("size"), F.col("margin"))
    return settings(spark).select("percent", "position", "margin", x.alias("x"), y.alias("y"), s.alias("padded"))


@query
def filter_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settings(spark).filter("margin = 12").withColumn("mode", render.motion_column(F.element_at(F.array(F.lit("skip"), F.lit("fast"), F.lit("best")), F.col("percent") % 3 + 1)))
    x, y, s = view.overlay_geometry(F.col("position"), F.lit(render.WIDTH), F.lit(render.HEIGHT), F.col("size"), F.col("margin"))
    s = F.when(F.col("percent") % 5 != 0, s)
    return df.select("percent", "position", render.filter_graph(F.col("mode"), x, y, s).alias("graph"), F.round(render.progress_percent(F.col("mode"), F.col("percent"), F.lit(100)), 6).alias("progress"))


def panorama(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of the panoramas that are kept."""
    return panos.best_of_runs(zipped(spark, sf_dir)).select("track_id", "seq", "lat", "lng")


@query
def map_url_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.overview_urls(points(spark, sf_dir), panorama(spark, sf_dir), SIZE, KEY)


@query
def map_url_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    frames_ = own.select("track_id", F.col("seq").alias("frame"), "lat", "lng")
    return maps.follow_urls(own, panorama(spark, sf_dir), ZOOM + 2, SIZE, KEY, frames_)


@query
def map_url_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir)
    return maps.probe_urls("follow", own, own, ZOOM + 2, SIZE, KEY)


def queries() -> dict[str, Query]:
    return dict(_all)
