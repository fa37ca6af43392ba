"""Queries over tracks longer than those of the small tables: no point is left out."""

from __future__ import annotations

import datetime
import random

import duckdb
import pytest

from waymark.plans import oracles, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(1000 * user + k, start + datetime.timedelta(seconds=400 * k + rng.randint(0, 300)), user, rng.choice(["view", "buy", "error"]), rng.uniform(0, 500)) for user, n in ((1, 130), (2, 75), (3, 1), (4, 12)) for k in range(n)]
    path = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def held_against(spark, folder, name):
    """The query's rows, equal to its SQL's."""
    sql = oracles.oracle_sql()[name]
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    df = queries.queries()[name](spark, folder)
    found = con.execute(sql)
    own = [d[0] for d in found.description]
    key = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    rows = df.select(own).collect()
    assert key(map(tuple, rows)) == key(found.fetchall())
    return rows


# fit_zoom
def test_fit_zoom_has_all_points(spark, folder):
    rows = held_against(spark, folder, "fit_zoom")
    assert len(rows) == 130 + 75 + 1 + 12


# features
@pytest.mark.parametrize("name", ["frame_top_features", "frame_feature_matches"])
def test_features_of_all_frames(spark, folder, name):
    rows = held_against(spark, folder, name)
    assert max(r["seq" if name == "frame_top_features" else "j"] for r in rows) >= 20


# windows
def test_follow_view_has_all_frames(spark, folder):
    rows = held_against(spark, folder, "follow_view")
    assert len(rows) == 130 + 75 + 1 + 12


def test_map_urls_show_the_panoramas_of_all_points(spark, folder):
    rows = queries.queries()["map_url_follow"](spark, folder).collect()
    assert sorted((r["track_id"], r["frame"]) for r in rows) == sorted((t, k) for t, n in ((1, 130), (2, 75), (3, 1), (4, 12)) for k in range(n))
    line = queries.panorama(spark, folder).collect()
    best = queries.queries()["pano_run_best"](spark, folder).collect()
    assert sorted((r["track_id"], r["seq"], round(r["lat"], 6)) for r in line) == sorted((r["track_id"], r["seq"], r["lat"]) for r in best)
    assert len(queries.queries()["map_url_overview"](spark, folder).collect()) == 4
