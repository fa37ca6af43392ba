from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import images
from waymark.operators import frames, maps, render, view
from waymark.operators.render import Overlay
from waymark.options import parse
from waymark.plans import route
from waymark.progress import Progress
from waymark.sources import fetch, gpx, summary

TRACK = """<?xml version="1.0"?><gpx version="1.1"><metadata><name>Test &amp; Route</name></metadata><wpt lat="9" lon="9"/>
<trk><name>not this</name><trkseg><trkpt lat="1.5" lon="2.5"><ele>10</ele></trkpt><trkpt lat="1.6" lon="2.6"/></trkseg><trkseg><trkpt lat="1.7" lon="2.7"><ele>-3.5</ele></trkpt></trkseg></trk>
<trk><trkseg/><trkseg><trkpt lat="-1" lon="-2"><ele>0</ele></trkpt></trkseg></trk></gpx>"""
LINE = "<gpx><trk><trkseg>{}</trkseg></trk></gpx>"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.gpx").write_text(TRACK)
    (tmp_path / "b.gpx").write_text(LINE.format("".join(f'<trkpt lat="{47 + i / 500}" lon="8"><ele>{i}</ele></trkpt>' for i in range(30))))
    (tmp_path / "c.gpx").write_text("<gpx><metadata/></gpx>")
    return tmp_path


def test_gpx(spark, folder):
    out = gpx.read_points(spark, f"{folder}/a.gpx").orderBy("seq").collect()
    assert [(r["seq"], r["trk"], r["seg"], r["lat"], r["lng"], r["ele"]) for r in out] == [(0, 0, 0, 1.5, 2.5, 10.0), (1, 0, 0, 1.6, 2.6, None), (2, 0, 1, 1.7, 2.7, -3.5), (3, 1, 1, -1.0, -2.0, 0.0)]
    heads = {r["track_id"][-5:]: (r["name"], r["points"], r["fileSizeBytes"]) for r in gpx.read_headers(spark, f"{folder}/*.gpx").collect()}
    assert heads == {"a.gpx": ("Test & Route", 4, 128), "b.gpx": (gpx.NO_NAME, 30, 960), "c.gpx": (gpx.NO_NAME, 0, 0)}


class Recorder:
    """Answers lookups and images, counts what it is asked in a folder that workers share."""

    def __init__(self, folder, refuse=None):
        self.folder, self.refuse = str(folder), refuse

    def __call__(self, url):
        import os
        import uuid

        open(os.path.join(self.folder, uuid.uuid4().hex), "w").write(url)
        if self.refuse and self.refuse in url:
            return None, 403, f"refused {url}"
        if "/metadata?" in url:
            lat = float(url.split("location=")[1].split(",")[0])
            return json.dumps({"status": "OK", "pano_id": str(round(lat, 3)), "location": {"lat": lat, "lng": 8.0}}).encode(), 200, ""
        if "staticmap" in url:
            return images.to_png(np.full((384, 384, 4), 90, np.uint8)), 200, ""
        return b"jpeg", 200, ""

    def asked(self):
        import os

        return sorted(open(os.path.join(self.folder, f)).read() for f in os.listdir(self.folder))


def test_cached_fetch(spark, tmp_path):
    (tmp_path / "log").mkdir()
    r = Recorder(tmp_path / "log", "c=bad")
    cache = str(tmp_path / "cache")
    df = spark.createDataFrame([("t", 0, "http://x/?a=1&key=K"), ("t", 1, "http://x/?a=1&key=K"), ("t", 2, "http://x/?c=bad&key=K"), ("t", 3, None)], "track_id string, seq long, url string")
    first = {x["seq"]: x for x in fetch.fetch_cached(df, r, cache, "map").collect()}
    assert len(r.asked()) == 2 and bytes(first[0]["body"]) == bytes(first[1]["body"]) == b"jpeg"
    assert first[2]["status"] == 403 and "key=K" not in first[2]["message"] and 3 not in first
    again = fetch.fetch_cached(df.withColumn("url", F.replace("url", F.lit("key=K"), F.lit("key=L"))), r, cache, "map").collect()
    assert len(r.asked()) == 3 and sum(x["body"] is not None for x in again) == 2  # only the refused one is asked for again
    fetch.fetch_cached(df, r, cache, "metadata").count()
    assert len(r.asked()) == 5
    fetch.fetch_cached(df, r, None, "map").count()
    assert len(r.asked()) == 7
    bad = fetch.first_error(fetch.fetch(df, r)).first()
    assert (bad["seq"], bad["status"]) == (2, 403)


def test_broken_lookup_is_an_error(spark):
    df = spark.createDataFrame([("t", 0, b"{}"), ("t", 1, b'{"status": "OK", "extra": 1}')], "track_id string, seq long, body binary")
    assert [(r["status"], r["pano_id"], r["pano_lat"]) for r in fetch.parsed_lookups(df).orderBy("seq").collect()] == [("", "", 0.0), ("OK", "", 0.0)]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        fetch.parsed_lookups(df.withColumn("body", F.lit(b"{no"))).collect()


def options(*more):
    return parse([*more, "--api-key", "K"])


def test_plan_from_files_to_frames(spark, folder, tmp_path_factory):
    log, out, cache = (tmp_path_factory.mktemp(n) for n in ("log", "out", "cache"))
    r = Recorder(log)
    o = options(f"{folder}/b.gpx", "--frames-per-mile", "20", "--minimap", "follow", "--max-frames", "5", "--offset-frames", "1")
    found, jumps = route.dry_run(spark, o, r, str(cache / "c"))
    s = found.first()
    assert s["frames"] == len(s["gpsPoints"]) > 20 and len(s["originalPoints"]) == 30 and s["averageError"] < 1e-6 and s["name"] == gpx.NO_NAME
    assert abs(s["distance"] - 29 / 500 * 111180) < 200 and jumps.count() == 0
    assert all(min(x["bearing"], 360 - x["bearing"]) < 1e-6 for x in s["gpsPoints"])
    asked = len(r.asked())
    route.dry_run(spark, o, r, str(cache / "c"))[0].count()
    assert len(r.asked()) == asked
    written = summary.to_json(found).first()["value"]
    assert list(json.loads(written)) == summary.KEYS and json.loads(written)["gpsPoints"][0].keys() == {"lat", "lng", "bearing", "ele"}
    (folder / "s.json").write_text(json.dumps(json.loads(written), indent=1))
    back, _ = route.dry_run(spark, options(f"{folder}/s.json", "--use-metadata"), r)
    assert back.select(summary.KEYS).collect() == found.select(summary.KEYS).collect()
    assert route.rendered(spark, o, found, r, str(out), str(cache / "c")).first()["frames"] == 5
    assert len(list(out.iterdir())) == 1
    names = sorted(p.name for p in out.glob("*/*"))
    assert names == sorted([f"{i}.jpg" for i in range(5)] + [f"{i}.map.png" for i in range(5)])
    picture = images.from_png(next(out.glob("*/3.map.png")).read_bytes())
    assert picture.shape[0] == 384 + 2 * images.pad(384) and tuple(picture[picture.shape[0] // 2, picture.shape[1] // 2]) == images.FILL
    with pytest.raises(RuntimeError, match="not enabled"):
        route.rendered(spark, o, found, Recorder(log, "staticmap"), str(out), None)
    assert "SECRET" not in summary.to_text(found).first()["value"]


def test_null_elevation_stays_in_the_summary(spark):
    df = spark.createDataFrame([("t", 1.0, 1, [(1.0, 2.0, 3.0, None)], [(1.0, 2.0, None)], 0.5, "n", 32)], "track_id string, " + summary.SCHEMA)
    assert '"ele":null' in summary.to_json(df).first()["value"]


def runs(n, k, step=2e-5):
    return [np.array([(51.5 + step * (i + 1000 * j), -0.12 + 1.5 * step * i) for i in range(n)]) for j in range(k)]


@pytest.mark.parametrize(("track", "panorama"), [(runs(50_000, 1), runs(50_000, 1)), (runs(60, 30), runs(60, 30)), (runs(40, 200), runs(40, 200)), (runs(1, 1500), runs(3, 1500))])
def test_url_budget(track, panorama):
    url = maps.map_url(51.5, -0.12, 16, 192, track, panorama, "K")
    assert len(url) <= maps.LONGEST and url.endswith("&key=K") and "color%3A0x1e88e5ff%7Cweight%3A5" in url or track[0].shape[0] == 1
    if len(track) == 1:
        assert len(url) > 4096 and url.count("&path=") == 2


def test_small_urls_hold_everything():
    a = np.array([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)])
    url = maps.map_url(1.0, -2.5, 3, 192, [a, a[:1]], [], "K")
    assert url.startswith(f"{maps.BASE}?center=1,-2.5&zoom=3&size=192x192&scale=2&maptype=roadmap&path=")
    assert "enc%3A_p~iF~ps%7CU_ulLnnqC_mqNvxq%60%40" in url and url.count("&path=") == 1


def test_overview_and_probe(spark):
    line = spark.createDataFrame([("t", i, 47.0 + i / 100, 8.0) for i in range(5)], "track_id string, seq long, lat double, lng double")
    whole = maps.map_urls("overview", line, line, 16, 192, "K").collect()
    assert len(whole) == 1 and "center=47.019999999999996,8&" in whole[0]["url"] and whole == maps.probe_urls("overview", line, line, 16, 192, "K").collect()
    each = maps.map_urls("follow", line, line, 16, 192, "K").orderBy("frame").collect()
    assert len(each) == 5 and each[0]["url"] == maps.probe_urls("follow", line, line, 16, 192, "K").first()["url"]
    assert maps.map_urls("overview", line.filter("false"), line.filter("false"), 16, 192, "K").count() == 0


def test_images(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (9, 7, 4), np.uint8)
    assert (images.from_png(images.to_png(a)) == a).all()
    base = np.full((100, 100, 4), 50, np.uint8)
    framed = images.compose(base, 0.0, 0.0)
    p = images.pad(100)
    assert framed.shape == (100 + 2 * p, 100 + 2 * p, 4) and tuple(framed[p, p]) == images.FILL and framed[0, -1, 3] == 0
    ys, xs = np.nonzero((framed[..., :3] == 255).all(axis=2))
    assert abs(ys.mean() - p) < 0.5 and abs(xs.mean() - p) < 0.5
    with pytest.raises(ValueError, match="PNG"):
        images.from_png(b"jpeg")


def test_every_png_filter():
    import struct
    import zlib

    rng = np.random.default_rng(2)
    for kind, n in ((0, 1), (2, 3), (4, 2), (6, 4)):
        px = rng.integers(0, 256, (5, 6 * n), np.uint8).astype(int)
        lines = []
        for y in range(5):
            a = np.concatenate([np.zeros(n, int), px[y, :-n]])
            b = px[y - 1] if y else np.zeros(6 * n, int)
            c = np.concatenate([np.zeros(n, int), b[:-n]])
            d = np.abs(np.stack([b - c, a - c, a + b - 2 * c]))
            paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), a, np.where(d[1] <= d[2], b, c))
            guess = [0, a, b, (a + b) // 2, paeth][y]
            lines.append(bytes([y]) + ((px[y] - guess) & 255).astype(np.uint8).tobytes())
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
        data = images.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
        got = images.from_png(data)
        want = px.reshape(5, 6, n)
        assert (got[..., 3] == (want[..., -1] if n in (2, 4) else 255)).all() and (got[..., 0] == want[..., 0]).all()


def test_map_counts_must_fit(spark):
    f = spark.createDataFrame([("t", 0), ("t", 1)], "track_id string, seq long")
    with pytest.raises(ValueError, match="1 maps for 2 frames"):
        render.check_counts(f.limit(1), f)


def test_encoder_arguments():
    assert render.finish_arguments("skip", None, "a", "b") is None
    over = render.finish_arguments("good", Overlay(-4, 5, 200), "a.mp4", "b.mp4")
    graph = over[over.index("-filter_complex") + 1]
    assert graph.index("minterpolate") < graph.index("overlay=-4:5") and "%d.map.png" in over and over[-1] == "b.mp4"
    assert render.join_arguments(True, "x")[5] == "%d.opt.jpg" and render.motion("best") == render.motion(None) == "good"
    assert render.graph_text("fast", None) == "[0:v]minterpolate=fps=48,tblend=all_mode=average,framestep=2[out]"


def test_optimizer(tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.jpg").write_text(str(i))
    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\n[ \"$2\" = bad ] && exit 3\necho '[0, 2, 3]'\n")
    tool.chmod(0o755)
    assert render.optimizer(str(tool), str(tmp_path), "bad") == []
    assert render.optimizer(str(tool), str(tmp_path)) == [0, 2, 3]
    assert [(tmp_path / f"{i}.opt.jpg").read_text() for i in range(3)] == ["0", "2", "3"]


ENCODER = """#!/bin/sh
# stands in for the encoder: says frames, writes its arguments and the files it was shown
for out; do :; done
echo "frame=1"; echo "frame=  4"
{ echo "$@"; ls | tr '\\n' ' '; } > "$out"
"""


def encoder(folder, body=ENCODER):
    tool = folder / "encoder"
    tool.write_text(body)
    tool.chmod(0o755)
    return str(tool)


def test_video_of_one_track(spark, tmp_path):
    own = tmp_path / "frames"
    own.mkdir()
    said = []
    render.make_video(str(own), 8, "good", Overlay(1, 2, 3), str(tmp_path / "v.mp4"), tell=said.append, command=encoder(tmp_path))
    assert said == ["12.5%", "50.0%", "4.2%", "16.6%"]
    assert "%d.jpg" in (tmp_path / "v-original.mp4").read_text() and "overlay=1:2" in (tmp_path / "v.mp4").read_text()
    render.make_video(str(own), 8, "skip", None, str(tmp_path / "w.mp4"), optimized=True, command=encoder(tmp_path))
    assert "%d.opt.jpg" in (tmp_path / "w.mp4").read_text() and not (tmp_path / "w-original.mp4").exists()
    with pytest.raises(RuntimeError):
        render.make_video(str(own), 8, "skip", None, str(tmp_path / "x.mp4"), command=encoder(tmp_path, "#!/bin/sh\nexit 4\n"))


def test_videos_of_all_tracks(spark, tmp_path):
    rows = [(k, str(tmp_path / k), n) for k, n in (("a", 3), ("b", 2), ("none", 0))]
    for _, f, _ in rows:
        os.makedirs(f)
    o = options("x", "--minterp", "fast", "--minimap", "follow", "-o", "film.mp4")
    out = {r["track_id"]: r for r in route.filmed(o, spark.createDataFrame(rows, "track_id string, folder string, frames long"), command=encoder(tmp_path)).collect()}
    assert set(out) == {"a", "b"} and out["a"]["video"] == f"{tmp_path}/a/film.mp4" and out["a"]["bytes"] > 0
    assert "tblend" in (tmp_path / "b" / "film.mp4").read_text()


@pytest.mark.parametrize("choice", ["path", "tool"])
def test_plan_with_a_choice_of_frames(spark, folder, tmp_path, choice):
    """The kept images are renamed, and maps drawn for these alone; the built-in path with costs that make it skip."""
    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\n[ -d \"$1\" ] && echo '[0, 3, 4]'\n")
    tool.chmod(0o755)
    (tmp_path / "log").mkdir()
    r = Recorder(tmp_path / "log")
    more = ["--optimizer", "path", "--optimizer-arg", '{"velocity_factor": 0}'] if choice == "path" else ["--optimizer", str(tool)]
    o = options(f"{folder}/b.gpx", "--frames-per-mile", "20", "--minimap", "follow", "--max-frames", "5", *more)
    found, _ = route.dry_run(spark, o, r)
    got = route.rendered(spark, o, found, r, str(tmp_path / "out"), decode=lambda body: None).collect()
    kept = 2 if choice == "path" else 3
    assert [x["frames"] for x in got] == [kept]
    names = {p.name for p in (tmp_path / "out").glob("*/*")}
    assert {f"{i}.opt.jpg" for i in range(kept)} <= names and {n for n in names if n.endswith("png")} == {f"{i}.map.png" for i in range(kept)}


def test_parameters_of_the_choice(spark):
    df = spark.createDataFrame([("a", 0, b"x"), ("a", 1, b"y"), ("b", 0, b"z")], "track_id string, seq long, body binary")
    kept = route.chosen_frames(df, '{"n_features": 50, "ratio_test": 0.8}')
    assert sorted(r["value"] for r in frames.kept_json(kept).collect()) == ["[0,0]", "[0,1]"]
    with pytest.raises(ValueError, match="unknown"):
        route.chosen_frames(df, '{"speed": 1}')


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    from waymark.__main__ import main

    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "cache"))
    (tmp_path / "log").mkdir()
    r = Recorder(tmp_path / "log")
    line = [f"{folder}/b.gpx", "--api-key", "K", "-f", "20", "--max-frames", "3", "--minterp", "skip", "--progress", "-o", str(tmp_path / "v.mp4"), "--output-dir", str(tmp_path / "out")]
    assert main(line, r, encoder=encoder(tmp_path)) == 0
    assert "%d.jpg" in (tmp_path / "v.mp4").read_text() and len(list((tmp_path / "out").glob("*/*.jpg"))) == 3
    asked = len(r.asked())
    assert main(line, r, encoder=encoder(tmp_path)) == 0 and len(r.asked()) == asked
    assert main([*line, "--no-cache"], r, encoder=encoder(tmp_path)) == 0 and len(r.asked()) > asked
    assert "Joining" in capsys.readouterr().out


def test_default_cache(spark, monkeypatch):
    monkeypatch.setenv("XDG_CACHE_HOME", "/x")
    assert fetch.default_cache(spark) == "file:///x/waymark"
    monkeypatch.delenv("XDG_CACHE_HOME")
    monkeypatch.setenv("HOME", "/h")
    assert fetch.default_cache(spark) == "file:///h/.cache/waymark"


def test_overlay_geometry(spark):
    o = route.overlay(options("x", "--minimap", "follow"))
    assert (o.x, o.y, o.size) == (640 - 192 - 12 - 8, 480 - 192 - 12 - 8, 192 + 16) or o.size == 192 + 2 * (images.pad(384) // 2)
    assert route.overlay(options("x")) is None and route.map_size(options("x")) == 192
    rows = spark.range(1, 101).select(view.dot_pad(F.col("id").cast("int")).alias("p"), F.col("id")).collect()
    assert all(r["p"] == images.pad(r["id"]) for r in rows)


def test_options(monkeypatch, capsys):
    o = options("x.gpx")
    assert (o.network_concurrency, o.frames_per_mile, o.offset_frames, o.minimap, o.minimap_position, o.minimap_size, o.minimap_margin, o.minimap_zoom, o.minterp, o.max_frames) == (40, 100.0, 0, "off", "br", 40, 12, 16, "good", None)
    for bad in (["--minimap-size", "0"], ["--minimap-size", "101"], ["--minimap-zoom", "22"], ["--minimap", "big"], ["--max-frames", "-1"]):
        with pytest.raises(SystemExit):
            options("x", *bad)
    monkeypatch.delenv("GOOGLE_API_KEY", raising=False)
    with pytest.raises(SystemExit):
        parse(["x"])
    monkeypatch.setenv("GOOGLE_API_KEY", "from the environment")
    assert parse(["x"]).api_key == "from the environment"
    capsys.readouterr()
    with pytest.raises(SystemExit):
        parse(["--help"])
    assert "from the environment" not in capsys.readouterr().out


def test_progress():
    out, now = [], [1000.0]
    p = Progress(True, out.append, lambda: now[0])
    for t, call in ((1000, p.message), (1100, p.message), (1201, p.message), (1210, p.stage), (1211, p.message)):
        now[0] = t
        call(str(t))
    assert [json.loads(x).get("message") or json.loads(x)["stage"] for x in out] == ["1000", "1201", "1210", "1211"]
    Progress(False, out.append).stage("x")
    assert len(out) == 4


def test_frames_from_files(spark, tmp_path):
    for n in (10, 9, 1):
        (tmp_path / f"f{n}.jpg").write_bytes(b"x" * n)
    (tmp_path / "no.png").write_bytes(b"y")
    assert [r["length"] for r in fetch.read_frames(spark, str(tmp_path)).collect()] == sorted((1, 9, 10), key=lambda n: int("".join(c for c in f"{tmp_path}/f{n}" if c.isdigit())))
    assert tuple(fetch.folder_size(spark, str(tmp_path)).first()) == (4, 21)
