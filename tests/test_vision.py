from __future__ import annotations

import numpy as np

from waymark.functions import images, vision
from waymark.operators import frames


def scene(shift: int = 0, seed: int = 1, zoom: int = 4) -> np.ndarray:
    blocks = np.random.default_rng(seed).integers(0, 256, (60, 80, 3))
    big = np.kron(blocks, np.ones((zoom, zoom, 1)))
    return np.concatenate([big[20 : 20 + 160, 20 + shift : 20 + shift + 220], np.full((160, 220, 1), 255)], axis=2).astype(np.uint8)


def test_motion_of_a_shifted_scene():
    a = scene()
    assert vision.match_cost(a, a) < 1e-6
    assert vision.match_cost(a, scene(7)) < 8
    assert vision.match_cost(a, np.zeros_like(a)) == 0.5 * np.hypot(220, 160)


def test_plane_motion_ignores_outliers():
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 200, (60, 2))
    m = np.array([[1.1, 0.02, 5], [-0.03, 0.95, -7], [1e-4, 0, 1]])
    q = vision.moved(m, p)
    q[:15] += rng.uniform(30, 90, (15, 2))
    assert np.abs(vision.plane_motion(p, q) - m).max() < 1e-6 and vision.plane_motion(p[:3], q[:3]) is None


def test_largest_and_ratio():
    r = np.array([[1.0, 9.0], [9.0, 3.0]])
    assert vision.largest(r, 3).tolist() == [[0, 1], [1, 0], [1, 1]] and len(vision.largest(r, 99)) == 4
    d = np.array([[0, 0], [10, 0], [11, 0]], np.uint8)
    assert vision.matches(d[:1], d).tolist() == [[0, 0]] and len(vision.matches(d[1:2] + np.uint8(1), d[1:] * np.uint8(1) + np.uint8(1))) == 1
    assert len(vision.matches(d, d[:1])) == 0


def test_costs_of_frames(spark):
    rows = [("t", i, images.to_png(scene(2 * i))) for i in range(4)] + [("u", 0, images.to_png(scene())), ("u", 1, b"broken")]
    out = {(r["track_id"], r["i"], r["j"]): r["cost"] for r in frames.image_costs(spark.createDataFrame(rows, "track_id string, seq long, body binary")).collect()}
    assert len(out) == 7 and out["u", 0, 1] == 400.0 and out["t", 0, 1] < 10 and 100 <= out["t", 0, 2] < 110 and 400 <= out["t", 0, 3] < 415
    kept = {r["track_id"]: r["kept"] for r in frames.best_paths(spark.createDataFrame([(*k, c) for k, c in out.items()], "track_id string, i long, j long, cost double")).collect()}
    assert kept == {"t": [0, 1, 2, 3], "u": [0, 1]}
