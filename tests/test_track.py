from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import frames, gaps, panos, track, view

POINTS = "track_id string, seq long, lat double, lng double, ele double"


def table(spark, **tracks):
    return spark.createDataFrame([(t, i, p[0], p[1], p[2] if len(p) > 2 else None) for t, ps in tracks.items() for i, p in enumerate(ps)] or [], POINTS).repartition(3)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("track_id", "seq").collect()]


def walk(seed: int, n: int) -> list[tuple[float, float]]:
    rng = random.Random(seed)
    at, out = [50.0, 8.0], []
    for _ in range(n):
        if rng.random() > 0.2:
            at = [at[0] + rng.uniform(-1e-3, 1e-3), at[1] + rng.uniform(-1e-3, 1e-3)]
        out.append(tuple(at))
    return out


def greedy(steps: list[float], n: int) -> list[int]:
    due, so_far, out = sum(steps) / (n - 0.99), 0.0, []
    for i in range(len(steps) + 1):
        if len(out) < n and so_far >= due * len(out):
            out.append(i)
        so_far += steps[i] if i < len(steps) else 0
    return out


@pytest.mark.parametrize("n", [1, 3, 10, 50])
def test_sampling_is_the_greedy_walk(spark, n):
    tracks = {f"t{k}": walk(k, 1 + 7 * k % 40) for k in range(12)} | {"same": [(1.0, 1.0)] * 8}
    got = track.with_steps(table(spark, **tracks))
    out = rows(track.sample_even(got, n), "track_id", "lat", "lng")
    for t, ps in tracks.items():
        p = np.array(ps)
        steps = geo.vincenty(p[:-1, 0], p[:-1, 1], p[1:, 0], p[1:, 1]).tolist()
        assert [(a, b) for x, a, b in out if x == t] == [ps[i] for i in greedy(steps, n)]


def test_steps_running_and_lengths(spark):
    df = track.with_running(track.with_steps(table(spark, a=[(0.0, i / 10) for i in range(11)], b=[(1.0, 1.0)])))
    out = rows(df, "track_id", "step", "running")
    assert out[0] == ("a", None, 0.0) and out[-1] == ("b", None, 0.0)
    assert all(math.isclose(r[1], 11131.949, rel_tol=1e-6) for r in out[1:11]) and math.isclose(out[10][2], 111319.49, rel_tol=1e-6)
    assert {r["track_id"]: (round(r["length"]), r["points"]) for r in track.lengths(df).collect()} == {"a": (111319, 11), "b": (0, 1)}


def test_bearings(spark):
    out = rows(track.with_bearings(table(spark, a=[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], b=[(1.0, 1.0)])), "track_id", "bearing")
    assert [t for t, _ in out] == ["a", "a", "a"] and out[0][1] == 0 and out[1][1] == out[2][1] and 89 < out[1][1] < 90


def test_densify_drops_vertices_and_elevation_is_a_place_behind(spark):
    df = table(spark, a=[(0.0, 0.0, 0.0), (0.0, 1.0, 100.0)], b=[(0.0, 0.0, 1.0), (0.0, 0.0, 2.0), (0.0, 2.0, None)], c=[(5.0, 5.0)])
    out = rows(track.densify(df, 4), "track_id", "seq", "lng", "ele")
    assert [(t, s, round(x, 9), e) for t, s, x, e in out] == [("a", 0, 0.25, 0.0), ("a", 1, 0.5, 25.0), ("a", 2, 0.75, 50.0), ("b", 0, 0.5, None), ("b", 1, 1.0, None), ("b", 2, 1.5, None)]
    assert rows(track.densify(df, 1), "track_id", "seq", "lng") == rows(df, "track_id", "seq", "lng")


def test_factor(spark):
    df = spark.createDataFrame([(100, 10), (9, 10), (5, 0)], "frames int, steps int")
    assert [tuple(r) for r in df.select(track.densify_factor(F.col("frames"), F.col("steps")), track.densify_factor(F.col("frames"), F.col("steps"), 7)).collect()] == [(11, 7), (1, 7), (None, None)]
    assert spark.range(1).select(track.expected_frames(F.lit(1599.9), 100.0)).first()[0] == 99


def test_best_of_runs(spark):
    found = [("OK", "A", 0.0), ("ZERO", "", 0.0), ("OK", "A", 0.0), ("OK", "B", 0.3), ("OK", "B", 0.3), ("OK", "A", 0.5)]
    df = table(spark, t=[(0.0, i / 10) for i in range(6)])
    looked = spark.createDataFrame([("t", i, s, p, 0.0, lng) for i, (s, p, lng) in enumerate(found)], "track_id string, seq long, status string, pano_id string, pano_lat double, pano_lng double")
    both = panos.zip_lookups(df, looked)
    assert rows(panos.with_runs(panos.found(both)), "seq", "run") == [(0, 0), (2, 0), (3, 1), (4, 1), (5, 2)]
    out = panos.best_of_runs(both).orderBy("seq").collect()
    assert [(r["seq"], round(r["lng"], 9), r["pano_id"]) for r in out] == [(0, 0.0, "A"), (1, 0.3, "B"), (2, 0.5, "A")]
    assert rows(panos.rejected(both), "seq") == [(1,)]
    tie = panos.zip_lookups(df, looked.withColumn("pano_lng", F.lit(0.05)).filter("seq in (0, 2)").withColumn("seq", F.when(F.col("seq") == 2, 1).otherwise(0).cast("long")))
    assert panos.best_of_runs(tie).first()["lng"] == 0.0  # equally far: the first


def spaced(n: int, metres: float, start: float = 54.0) -> list[tuple[float, float]]:
    return [(start + i * metres / 111320.0, -2.6) for i in range(n)]


def test_gaps(spark):
    hole = spaced(100, 16)
    hole += spaced(50, 16, hole[-1][0] + 1000 / 111320.0)
    thin = spaced(60, 16)
    thin += spaced(3, 200, thin[-1][0] + 200 / 111320.0)
    thin += spaced(40, 16, thin[-1][0] + 16 / 111320.0)
    out = {r["track_id"]: r for r in gaps.gaps(table(spark, even=spaced(80, 16), hole=hole, thin=thin, one=[(1.0, 1.0)], slow=[*spaced(30, 3), (54.0 + 130 / 111320, -2.6)])).collect()}
    assert set(out) == {"hole", "thin"}
    assert (out["hole"]["frame"], out["hole"]["spans"]) == (100, 1) and abs(out["hole"]["metres"] - 1000) < 2
    assert (out["thin"]["frame"], out["thin"]["spans"]) == (60, 3) and abs(out["thin"]["metres"] - 600) < 5
    assert out["hole"]["from"]["lat"] == hole[99][0] and out["hole"]["to"]["lat"] == hole[100][0]
    line = gaps.report(gaps.gaps(table(spark, thin=thin))).first()["line"]
    assert line.startswith("     2.5s  skips   599 m over 3 frames  https://") or line.startswith("     2.5s  skips   600 m over 3 frames  https://")


def test_usual_step_is_the_upper_median(spark):
    lat = [0.0, 1.0, 3.0, 6.0, 10.0]
    df = gaps.with_threshold(table(spark, t=[(0.0, x) for x in lat]))
    assert abs(df.first()["usual"] - 3 * 111319.49) < 1 and df.select("usual").distinct().count() == 1


def brute_runs(points, center, zoom, size):
    def on(p):
        wx = lambda g: 256 * (g + 180) / 360
        wy = lambda a: 128 - 0.5 * math.log((1 + math.sin(math.radians(a))) / (1 - math.sin(math.radians(a)))) * 128 / math.pi
        x, y = size / 2 + (wx(p[1]) - wx(center[1])) * 2**zoom, size / 2 + (wy(p[0]) - wy(center[0])) * 2**zoom
        return 0 <= x <= size and 0 <= y <= size

    seen = [on(p) for p in points]
    keep = [any(seen[max(0, i - 1) : i + 2]) for i in range(len(points))]
    out, now = [], []
    for p, k in zip(points, keep, strict=True):
        if k:
            now.append(p)
        elif now:
            out.append(now)
            now = []
    return out + [now] * bool(now)


def test_runs_in_a_window(spark):
    points = [(0.0, i * 0.01) for i in range(40)] + [(i * 0.01, 0.4) for i in range(40)] + [(0.4 - i * 0.01, 0.4 - i * 0.01) for i in range(40)]
    df = table(spark, t=points)
    runs = view.visible_runs(df, 0.0, 0.0, 11, 192).orderBy("run").collect()
    assert [[(p["lat"], p["lng"]) for p in r["points"]] for r in runs] == brute_runs(points, (0.0, 0.0), 11, 192)
    f = df.filter("seq % 9 = 0").select("track_id", F.col("seq").alias("frame"), "lat", "lng")
    got = {}
    for r in view.follow_runs(f, df, 11, 192).orderBy("frame", "run").collect():
        got.setdefault(r["frame"], []).append([(p["lat"], p["lng"]) for p in r["points"]])
    assert got == {i: brute_runs(points, points[i], 11, 192) for i in range(0, len(points), 9)}
    top = view.longest(view.visible_runs(df, 0.0, 0.0, 13, 192), 1).collect()
    assert len(top) == 1


def test_frames(spark):
    df = table(spark, t=spaced(6, 10), one=[(1.0, 1.0)])
    assert rows(frames.offset_limit(df, 2, 3), "track_id", "seq") == [("t", 0), ("t", 1), ("t", 2)]
    assert frames.offset_limit(df, 0, 0).count() == 0 and frames.offset_limit(df, 99).count() == 0
    kept = spark.createDataFrame([("t", [5, 0, 0])], "track_id string, kept array<long>")
    assert [r[0] for r in rows(frames.gather(df, kept), "lat")] == [spaced(6, 10)[i][0] for i in (5, 0, 0)]
    assert {(r["i"], r["j"]) for r in frames.band_pairs(df).collect()} == {(i, j) for i in range(6) for j in range(i + 1, min(6, i + 5))}


def slow_path(n, cost):
    best, before = [math.inf] * n, [0] * n
    best[0] = 0
    for i in range(n - 1):
        for j in range(i + 1, min(n, i + 5)):
            if cost[i, j] + best[i] < best[j]:
                best[j], before[j] = cost[i, j] + best[i], i
    path, at = [n - 1], before[-1]
    while at:
        path.append(at)
        at = before[at]
    return [0, *reversed(path)]


def test_best_paths(spark):
    rng = random.Random(3)
    costs = {t: {(i, j): float(rng.randint(0, 4)) + 2 * (j - i - 1) ** 2 for i in range(n) for j in range(i + 1, min(n, i + 5))} for t, n in (("a", 2), ("b", 30), ("c", 9))}
    edges = spark.createDataFrame([(t, i, j, c) for t, e in costs.items() for (i, j), c in e.items()], "track_id string, i long, j long, cost double")
    got = {r["track_id"]: r["kept"] for r in frames.best_paths(edges).collect()}
    assert got == {t: slow_path(max(j for _, j in e) + 1, e) for t, e in costs.items()}
    all_ = frames.chosen(table(spark, a=spaced(2, 9), lone=[(1.0, 1.0)]), edges.filter("track_id = 'a'")).collect()
    assert {r["track_id"]: r["kept"] for r in all_} == {"a": [0, 1], "lone": [0, 0]}


def test_match_cost(spark):
    df = spark.createDataFrame([(10.0, 5.0), (3.0, 5.0), (3.0, 400.0), (None, 1.0), (1.0, None)], "c0 double, cr double")
    assert [r[0] for r in df.select(frames.match_cost(F.col("c0"), F.col("cr"), F.lit(800.0))).collect()] == [5.0, 3.0, 400.0, 400.0, 400.0]
