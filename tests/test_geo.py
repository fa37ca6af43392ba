from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo

CITIES = "a_lat double, a_lng double, b_lat double, b_lng double"
LONDON, PARIS = (51.5074, -0.1278), (48.8566, 2.3522)


def one(spark, column, *values):
    return spark.createDataFrame([values], CITIES).select(column.alias("x")).first()["x"]


def test_distance_is_ellipsoidal(spark):
    d = one(spark, geo.distance("a_lat", "a_lng", "b_lat", "b_lng"), *LONDON, *PARIS)
    assert abs(d - 343923.120090) < 1e-3


def test_distance_special_cases():
    lat1, lng1 = np.array([10.0, 0.0, 0.0, 50.0]), np.array([20.0, 0.0, 0.0, 179.9])
    lat2, lng2 = np.array([10.0, 0.0, 1.0, 50.0]), np.array([20.0, 1.0, 0.0, -179.9 + 360])
    d = geo.vincenty(lat1, lng1, lat2, lng2)
    assert d[0] == 0 and abs(d[1] - math.radians(1) * geo.MAJOR) < 1e-6 and abs(d[2] - 110574.389) < 0.01 and 14_000 < d[3] < 15_000


def test_distance_has_settled():
    rng = np.random.default_rng(1)
    points = rng.uniform(-70, 70, (4, 5000))
    points[3] = points[1] + rng.uniform(-90, 90, 5000)
    five = geo.vincenty(*points)
    geo.PASSES, before = 12, geo.PASSES
    try:
        assert np.abs(geo.vincenty(*points) - five).max() < 1e-4
    finally:
        geo.PASSES = before


def test_filters_on_distance_can_be_planned(spark):
    df = geo.with_distance(spark.createDataFrame([(*LONDON, *PARIS), (None, 1.0, 2.0, 3.0)], CITIES), "a_lat", "a_lng", "b_lat", "b_lng", "d")
    assert df.filter("d is not null and d > 10").count() == 1 and df.filter("d is null").count() == 1


@pytest.mark.parametrize(("a", "b", "want"), [(LONDON, PARIS, 148.115616871053), ((0.0, 0.0), (1.0, 0.0), 0.0), ((0.0, 1.0), (0.0, 0.0), 270.0), ((1.0, 0.0), (0.0, 0.0), 180.0)])
def test_bearing(spark, a, b, want):
    assert abs(one(spark, geo.bearing("a_lat", "a_lng", "b_lat", "b_lng"), *a, *b) - want) < 1e-9


def test_between(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 90.0)], CITIES)
    r = geo.with_between(df, "a_lat", "a_lng", "b_lat", "b_lng", F.lit(0.5), "lat", "lng").first()
    assert abs(r["lat"]) < 1e-12 and abs(r["lng"] - 45) < 1e-12


def test_world_pixel_of_the_published_example(spark):
    r = spark.range(1).select(geo.world_x(F.lit(-87.650)).alias("x"), geo.world_y(F.lit(41.850)).alias("y")).first()
    assert abs(r["x"] - 65.67) < 0.01 and abs(r["y"] - 95.17) < 0.01


def test_fit_zoom(spark):
    zoom = lambda extent: one(spark, geo.fit_zoom("a_lat", "b_lat", "b_lng", "a_lng", 256), 0.0, 0.0, 0.0, extent)
    assert [zoom(x) for x in (0.0, 360.0, 180.0, 181.0, 1e-9)] == [21, 0, 1, 0, 21]


def test_project_centers(spark):
    x, y = geo.project("a_lat", "a_lng", "a_lat", "a_lng", 7, 300)
    r = spark.createDataFrame([(*LONDON, *PARIS)], CITIES).select(x.alias("x"), y.alias("y")).first()
    assert (r["x"], r["y"]) == (150.0, 150.0)
