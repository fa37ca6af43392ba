"""How well one image continues another: corners, descriptors, matches, a plane's motion. Plain arrays in and out.

The pattern of point pairs that descriptors compare is drawn once from a fixed
seed, so costs are comparable with each other but not with another library's.
"""

from __future__ import annotations

import numpy as np

# Rows cut off below, corner detector's weight, corners, nearest-to-second ratio.
CUT, HARRIS, CORNERS, RATIO = 19, 0.04, 360, 0.75
_pairs = np.clip(np.random.default_rng(256).normal(0, 6, (256, 4)), -15, 15).astype(int)


def _shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    return np.pad(a, ((max(0, -dy), max(0, dy)), (max(0, -dx), max(0, dx))), mode="reflect")[max(0, dy) :, max(0, dx) :][: a.shape[0], : a.shape[1]]


def gray(image: np.ndarray) -> np.ndarray:
    return image[..., :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)


def corner_response(g: np.ndarray) -> np.ndarray:
    """Harris response with 3x3 Sobel derivatives, summed over 2x2."""
    s = lambda dy, dx: _shifted(g, dy, dx)
    gx = s(-1, 1) - s(-1, -1) + 2 * (s(0, 1) - s(0, -1)) + s(1, 1) - s(1, -1)
    gy = s(1, -1) - s(-1, -1) + 2 * (s(1, 0) - s(-1, 0)) + s(1, 1) - s(-1, 1)
    block = lambda a: a + _shifted(a, -1, 0) + _shifted(a, 0, -1) + _shifted(a, -1, -1)
    xx, yy, xy = block(gx * gx), block(gy * gy), block(gx * gy)
    return xx * yy - xy * xy - HARRIS * (xx + yy) ** 2


def largest(response: np.ndarray, n: int) -> np.ndarray:
    """Places (y, x) of the n largest values, largest first; the earlier one on a tie."""
    flat = response.reshape(-1)
    n = min(n, flat.size)
    at = np.argsort(-flat, kind="stable")[:n]
    return np.stack(np.unravel_index(at, response.shape), axis=1)


def features(image: np.ndarray, n: int = CORNERS) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y) and their descriptors, 32 bytes each, of an image without its lowest rows."""
    g = gray(image[:-CUT])
    at = largest(corner_response(g), n)
    room = (at[:, 0] >= 16) & (at[:, 0] < g.shape[0] - 16) & (at[:, 1] >= 16) & (at[:, 1] < g.shape[1] - 16)
    at = at[room]
    soft = sum(_shifted(g, dy, dx) for dy in (-2, -1, 0, 1, 2) for dx in (-2, -1, 0, 1, 2))
    y, x = at[:, :1], at[:, 1:]
    bits = soft[y + _pairs[:, 0], x + _pairs[:, 1]] < soft[y + _pairs[:, 2], x + _pairs[:, 3]]
    return at[:, ::-1].astype(float), np.packbits(bits, axis=1)


def matches(d1: np.ndarray, d2: np.ndarray, ratio: float = RATIO) -> np.ndarray:
    """Pairs of places in d1 and d2: each of d1 with its nearest of d2, if that is much nearer than the second."""
    if not len(d1) or len(d2) < 2:
        return np.empty((0, 2), int)
    a, b = d1.astype(float), d2.astype(float)
    away = np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))
    two = np.argsort(away, axis=1, kind="stable")[:, :2]
    i = np.arange(len(a))
    good = away[i, two[:, 0]] < ratio * away[i, two[:, 1]]
    return np.stack([i[good], two[good, 0]], axis=1)


def _homography(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """The plane motion that takes p to q, by least squares on centered points."""

    def centered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, s = x.mean(0), max(x.std(), 1e-9)
        return (x - c) / s, np.array([[1 / s, 0, -c[0] / s], [0, 1 / s, -c[1] / s], [0, 0, 1]])

    (a, ta), (b, tb) = centered(p), centered(q)
    one, zero = np.ones(len(a)), np.zeros((len(a), 3))
    h = np.column_stack([a, one])
    rows = np.concatenate([np.hstack([h, zero, -h * b[:, :1]]), np.hstack([zero, h, -h * b[:, 1:]])])
    m = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    return m / m[2, 2] if abs(m[2, 2]) > 1e-12 and np.linalg.matrix_rank(m) == 3 else None


def moved(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    h = np.column_stack([p, np.ones(len(p))]) @ m.T
    return h[:, :2] / h[:, 2:]


def plane_motion(p: np.ndarray, q: np.ndarray, tries: int = 300, within: float = 3.0) -> np.ndarray | None:
    """The motion that most pairs of points follow (RANSAC); none with fewer than four pairs."""
    if len(p) < 4:
        return None
    rng, best = np.random.default_rng(4), None
    with np.errstate(all="ignore"):
        for _ in range(tries):
            some = rng.choice(len(p), 4, replace=False)
            try:
                m = _homography(p[some], q[some])
            except np.linalg.LinAlgError:
                continue
            if m is None:
                continue
            follow = np.hypot(*(moved(m, p) - q).T) <= within
            if best is None or follow.sum() > best.sum():
                best = follow
        if best is None or best.sum() < 4:
            return None
        try:
            return _homography(p[best], q[best])
        except np.linalg.LinAlgError:
            return None


def match_cost(first: np.ndarray, second: np.ndarray, count: int = CORNERS, ratio: float = RATIO) -> float:
    """Cost of showing second behind first: how far its center moves or how badly the points fit, the smaller; half the diagonal if that can't be told."""
    h, w = first.shape[:2]
    half = 0.5 * float(np.hypot(w, h))
    (p1, d1), (p2, d2) = features(first, count), features(second, count)
    pairs = matches(d1, d2, ratio)
    a, b = p1[pairs[:, 0]], p2[pairs[:, 1]]
    m = plane_motion(b, a)
    if m is None:
        return half
    center = np.array([[w // 2, h // 2]], float)
    c0, c_r = float(np.linalg.norm(center - moved(m, center))), float(np.linalg.norm(a - moved(m, b)))
    return min(c0, c_r) if c_r < half else half
