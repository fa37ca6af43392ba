"""Geometry on the earth and on Web Mercator maps, as column expressions.

Distances are on the WGS84 ellipsoid; bearings and interpolation are on the
sphere.  Null coordinates give null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import ship

# WGS84.
MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
MINOR = MAJOR * (1 - FLATTENING)
#: Passes of Vincenty's inverse formula. Each shrinks the error about 300 times; five leave less than 1e-5 m except near antipodes.
PASSES = 5

#: Side of the Web Mercator world at zoom 0, deepest zoom of maps, image pixels to a map pixel.
WORLD, MAX_ZOOM, MAP_SCALE = 256.0, 21, 2


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def vincenty(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    """Ellipsoidal distances in metres by Vincenty's inverse formula; nearly antipodal pairs are out of scope."""
    f = FLATTENING
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = apart = np.radians(lng2 - lng1)
    for _ in range(PASSES):
        sl, cl = np.sin(lam), np.cos(lam)
        x, y = cu2 * sl, cu1 * su2 - su1 * cu2 * cl
        ss, cs = np.sqrt(x * x + y * y), su1 * su2 + cu1 * cu2 * cl
        sig = np.arctan2(ss, cs)
        sa = np.where(ss == 0, 0.0, cu1 * cu2 * sl / np.where(ss == 0, 1.0, ss))  # equal points
        c2 = 1.0 - sa * sa
        m = np.where(c2 == 0, 0.0, cs - 2.0 * su1 * su2 / np.where(c2 == 0, 1.0, c2))  # along the equator
        c = f / 16 * c2 * (4.0 + f * (4.0 - 3.0 * c2))
        lam = apart + (1.0 - c) * f * sa * (sig + c * ss * (m + c * cs * (2.0 * m * m - 1.0)))
    q = c2 * ((MAJOR**2 - MINOR**2) / MINOR**2)
    a = 1.0 + q / 16384.0 * (4096.0 + q * (-768.0 + q * (320.0 - 175.0 * q)))
    b = q / 1024.0 * (256.0 + q * (-128.0 + q * (74.0 - 47.0 * q)))
    d = b * ss * (m + b / 4.0 * (cs * (2.0 * m * m - 1.0) - b / 6.0 * m * (4.0 * ss * ss - 3.0) * (4.0 * m * m - 3.0)))
    return MINOR * a * (sig - d)


def distance(lat1, lng1, lat2, lng2) -> Column:
    """Ellipsoidal distance in metres; null if a coordinate is.

    An Arrow UDF.  The unrolled formula can be written as chained selects, and
    then runs as fast, but any filter on the result is pushed down through them,
    which repeats every step's expression inside the next until planning runs
    out of memory.
    """

    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        parts = [x.to_numpy(zero_copy_only=False) for x in (a, b, c, d)]
        missing = np.logical_or.reduce([x.is_null().to_numpy(zero_copy_only=False) for x in (a, b, c, d)])
        return pa.array(vincenty(*parts), pa.float64(), mask=missing)

    ship()
    run.__annotations__ = dict.fromkeys("abcd", pa.Array) | {"return": pa.Array}
    return F.arrow_udf(run, "double")(*(_col(x).cast("double") for x in (lat1, lng1, lat2, lng2)))


def with_distance(df: DataFrame, lat1, lng1, lat2, lng2, out: str) -> DataFrame:
    return df.withColumn(out, distance(lat1, lng1, lat2, lng2))


def bearing(lat1, lng1, lat2, lng2) -> Column:
    """Initial great-circle bearing in degrees, 0 to 360, clockwise from north."""
    a, b, d = F.radians(_col(lat1)), F.radians(_col(lat2)), F.radians(_col(lng2) - _col(lng1))
    east = F.sin(d) * F.cos(b)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    turn = F.degrees(F.atan2(east, north)) + 360.0
    return F.when(turn >= 360.0, turn - 360.0).otherwise(turn)


def central_angle(lat1, lng1, lat2, lng2) -> Column:
    """Spherical distance in radians (haversine)."""
    a, b = F.radians(_col(lat1)), F.radians(_col(lat2))
    x, y = F.sin((b - a) / 2.0), F.sin(F.radians(_col(lng2) - _col(lng1)) / 2.0)
    return 2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(x * x + F.cos(a) * F.cos(b) * y * y)))


def with_between(df: DataFrame, lat1, lng1, lat2, lng2, share: Column, lat: str, lng: str) -> DataFrame:
    """df with the point at a share of the great circle between two points of each row."""
    p = "__between_"
    c = lambda name: F.col(p + name)
    a, b, m, n = F.radians(_col(lat1)), F.radians(_col(lat2)), F.radians(_col(lng1)), F.radians(_col(lng2))
    df = df.withColumns({p + "d": central_angle(lat1, lng1, lat2, lng2), p + "s": share, p + "a": a, p + "b": b, p + "m": m, p + "n": n})
    df = df.withColumns({p + "v": F.sin((1.0 - c("s")) * c("d")) / F.nullif(F.sin(c("d")), F.lit(0.0)), p + "w": F.sin(c("s") * c("d")) / F.nullif(F.sin(c("d")), F.lit(0.0))})
    df = df.withColumns({
        p + "x": c("v") * F.cos(c("a")) * F.cos(c("m")) + c("w") * F.cos(c("b")) * F.cos(c("n")),
        p + "y": c("v") * F.cos(c("a")) * F.sin(c("m")) + c("w") * F.cos(c("b")) * F.sin(c("n")),
        p + "z": c("v") * F.sin(c("a")) + c("w") * F.sin(c("b")),
    })
    df = df.withColumns({p + "lat": F.degrees(F.atan2(c("z"), F.sqrt(c("x") * c("x") + c("y") * c("y")))), p + "lng": F.degrees(F.atan2(c("y"), c("x")))})
    df = df.withColumns({lat: c("lat"), lng: c("lng")})
    return df.drop(*(x for x in df.columns if x.startswith(p)))


def world_x(lng) -> Column:
    """Web Mercator pixel at zoom 0, eastward."""
    return WORLD * (_col(lng) + 180.0) / 360.0


def world_y(lat) -> Column:
    """Web Mercator pixel at zoom 0, southward; unclamped beyond about 85 degrees."""
    s = F.sin(F.radians(_col(lat)))
    return WORLD / 2 - 0.5 * F.ln((1.0 + s) / (1.0 - s)) * (WORLD / 2) / math.pi


def project(lat, lng, center_lat, center_lng, zoom, size) -> tuple[Column, Column]:
    """Pixel of a point in a square map image of `size` pixels around a center."""
    scale = F.pow(F.lit(2.0), _col(zoom))
    half = _col(size) / 2.0
    return half + (world_x(lng) - world_x(center_lng)) * scale, half + (world_y(lat) - world_y(center_lat)) * scale


def image_pixel(lat, lng, center_lat, center_lng, zoom, size) -> tuple[Column, Column]:
    """Pixel in the fetched image, which has MAP_SCALE pixels to a map pixel."""
    x, y = project(lat, lng, center_lat, center_lng, zoom, size)
    return x * MAP_SCALE, y * MAP_SCALE


def on_screen(x: Column, y: Column, size) -> Column:
    """Whether a pixel lies in the image, edges included."""
    return x.between(F.lit(0.0), _col(size)) & y.between(F.lit(0.0), _col(size))


def fit_zoom(north, south, east, west, size) -> Column:
    """The deepest zoom at which a box fits a square image; MAX_ZOOM for a box without extent."""
    extent = F.greatest(F.abs(world_x(east) - world_x(west)), F.abs(world_y(south) - world_y(north)))
    zoom = F.floor(F.log2(_col(size) / F.nullif(extent, F.lit(0.0))))
    return F.when(extent <= 0, MAX_ZOOM).otherwise(F.greatest(F.lit(0), F.least(F.lit(MAX_ZOOM), zoom))).cast("int")
