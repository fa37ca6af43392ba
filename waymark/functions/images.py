"""Map images with a position dot: small rasters in numpy, PNG in and out."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

#: Colors of the dot and its ring.
FILL, RING = (255, 255, 255, 255), (17, 17, 17, 255)
MAGIC = b"\x89PNG\r\n\x1a\n"


def ring_radius(size: float) -> float:
    r = max(2.5, size / 34.0)
    return r + max(1.0, r / 2.5)


def pad(size: float) -> int:
    return -(-math.ceil(ring_radius(size)) // 2) * 2


def stamp(canvas: np.ndarray, x: float, y: float, ring: float) -> np.ndarray:
    """A copy of an RGBA image with a dot at (x, y), as much of it as the image has room for."""
    out = canvas.copy()
    h, w = out.shape[:2]
    py, px = np.ogrid[:h, :w]
    away = np.hypot(px - x, py - y)
    out[away <= ring] = RING
    out[away <= ring / 1.4] = FILL
    return out


def compose(image: np.ndarray, x: float, y: float) -> np.ndarray:
    """A map on a transparent margin that is wide enough for a dot on its edge, with the dot at (x, y) of the map."""
    h, w = image.shape[:2]
    p = pad(min(h, w))
    canvas = np.zeros((h + 2 * p, w + 2 * p, 4), np.uint8)
    canvas[p : p + h, p : p + w] = image
    return stamp(canvas, x + p, y + p, ring_radius(min(h, w)))


def to_png(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1)
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """RGBA pixels of an 8-bit PNG without interlacing; ValueError for anything else."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG image")
    at, body, palette, alpha, head = 8, b"", None, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = part
    if not head or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise ValueError("a kind of PNG image that isn't supported")
    w, h, _, kind, *_ = head
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out, above = np.zeros((h, w * n), np.uint8), np.zeros(w * n, np.int64)
    for y in range(h):
        line, f = raw[y, 1:].astype(np.int64), raw[y, 0]
        if f == 2:
            line = line + above
        elif f in (1, 3, 4):
            got = np.zeros(w * n + n, np.int64)  # with a pixel of zeros in front
            up = np.concatenate([np.zeros(n, np.int64), above])
            for i in range(n, w * n + n):
                a, b, c = got[i - n], up[i], up[i - n]
                if f == 1:
                    guess = a
                elif f == 3:
                    guess = (a + b) // 2
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                got[i] = (line[i - n] + guess) & 255
            line = got[n:]
        above = line & 255
        out[y] = above
    px = out.reshape(h, w, n)
    full = np.full((h, w, 1), 255, np.uint8)
    if kind == 3:
        a = np.full(len(palette), 255, np.uint8)
        a[: len(alpha)] = np.frombuffer(alpha, np.uint8)
        return np.concatenate([palette[px[..., 0]], a[px]], axis=2)
    if kind in (0, 4):
        return np.concatenate([np.repeat(px[..., :1], 3, axis=2), px[..., 1:] if kind == 4 else full], axis=2)
    return px.copy() if kind == 6 else np.concatenate([px, full], axis=2)
