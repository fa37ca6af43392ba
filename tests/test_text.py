from __future__ import annotations

from urllib.parse import unquote

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import maps


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_percent_encode(spark):
    assert apply(spark, text.percent_encode, ["a b*c~d|e`f", "é/\\", "", "-_.~"]) == ["a%20b%2Ac~d%7Ce%60f", "%C3%A9%2F%5C", "", "-_.~"]


def test_without_key(spark):
    have = ["http://x/?key=1&a=2", "http://x/?a=2&key=1", "http://x/?key=1", "http://x/", "http://x/?monkey=1", "http://x/?keys=1&key=2", "http://x/?key", "http://x/?a=b?key=3"]
    want = ["http://x/?a=2", "http://x/?a=2", "http://x/", "http://x/", "http://x/?monkey=1", "http://x/?keys=1", "http://x/?key", "http://x/?a=b?key=3"]
    assert apply(spark, text.without_key, have) == want


def test_redact_key(spark):
    have = ["key=S", "a?key=S&b=1", "a&key=S) x", "key=S key=T", "monkey=S", "monkey=key=S", "?key=", "no", "(?key=S\nx"]
    want = ["key=REDACTED", "a?key=REDACTED&b=1", "a&key=REDACTED) x", "key=REDACTED key=T", "monkey=S", "monkey=key=REDACTED", "?key=REDACTED", "no", "(?key=REDACTED\nx"]
    assert apply(spark, text.redact_key, have) == want


def test_number(spark):
    have = [1.0, 0.1, -0.00001, 123456789.25, 1e22, 0.0, -7.0, 1.5e-7, 1.25e10]
    want = ["1", "0.1", "-0.00001", "123456789.25", "10000000000000000000000", "0", "-7", "0.00000015", "12500000000"]
    assert apply(spark, text.number, have, "double") == want


@pytest.mark.parametrize(("data", "want"), [(b"", 0xCBF29CE484222325), (b"a", 0xAF63DC4C8601EC8C), (b"foobar", 0x85944171F73967E8)])
def test_fnv_vectors(data, want):
    assert text.fnv1a(data) == want and text.fnv1a_many([data, None, data])[2] == want


@settings(max_examples=50)
@given(st.lists(st.binary(max_size=40), max_size=20))
def test_fnv_of_many(texts):
    assert text.fnv1a_many(texts).tolist() == [text.fnv1a(t) for t in texts]


def test_digest_does_not_depend_on_the_key(spark):
    a, b, c, d = apply(spark, text.digest, ["http://x/?a=1&key=K", "http://x/?a=1&key=L", "http://x/?a=2", None])
    assert a == b != c and d is None and a == f"{text.fnv1a(b'http://x/?a=1'):016x}"
    assert spark.range(1).select(text.cache_path("/c/", F.lit("map"), F.lit("ab12")).alias("p"), text.cache_path("/c", F.lit("no"), F.lit("ab")).alias("q")).first() == ("/c/map/ab/ab12.png", None)


def decode(line: str) -> list[tuple[float, float]]:
    """Polyline decoding from its published description."""
    values, at = [], 0
    while at < len(line):
        z = shift = 0
        while True:
            c = ord(line[at]) - 63
            at += 1
            z |= (c & 31) << shift
            shift += 5
            if c < 32:
                break
        values.append(~(z >> 1) if z & 1 else z >> 1)
    out, lat, lng = [], 0, 0
    for i in range(0, len(values), 2):
        lat, lng = lat + values[i], lng + values[i + 1]
        out.append((lat / 1e5, lng / 1e5))
    return out


def test_polyline(spark):
    points = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    kind = "array<struct<lat: double, lng: double>>"
    far = [(-89.99999, -179.99999), (89.99999, 179.99999), (0.0, 0.0), (-0.000014, 0.000015)]
    got = apply(spark, text.polyline, [points, [], far], kind)
    assert got[0] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@" and got[1] == ""
    assert all(abs(a - b) <= 5.1e-6 for p, q in zip(decode(got[2]), far, strict=True) for a, b in zip(p, q, strict=True))


@pytest.mark.parametrize(("most", "want"), [(0, list(range(11))), (1, [0]), (2, [0, 10]), (3, [0, 5, 10]), (4, [0, 3, 7, 10]), (11, list(range(11))), (50, list(range(11)))])
def test_downsample(spark, most, want):
    points = [[(float(i), 0.0) for i in range(11)]]
    (got,) = apply(spark, lambda c: text.downsample(c, most), points, "array<struct<lat: double, lng: double>>")
    assert [p["lat"] for p in got] == want


def test_failure_message(spark):
    df = spark.createDataFrame([(403, "x?key=S"), (500, "y"), (None, "z")], "status int, message string")
    a, b, c = [r[0] for r in df.select(text.failure_message(F.col("status"), F.col("message"))).collect()]
    assert "not enabled" in a and "S" not in a.split("key=")[1][:1] and "not enabled" not in b + c and all(text.ENABLE_URL in m for m in (a, b, c))


def test_both_forms_of_lines_agree(spark):
    """The columns' polylines and thinning, and those that the loop over a URL uses."""
    rng = np.random.default_rng(3)
    lines = [rng.uniform(-80, 80, (n, 2)) for n in (2, 3, 10, 57, 200)]
    points = [[(float(a), float(b)) for a, b in x] for x in lines]
    kind = "array<struct<lat: double, lng: double>>"
    whole = apply(spark, text.polyline, points, kind)
    assert [unquote(maps.encode(x[:, 0], x[:, 1])) for x in lines] == whole
    thin = apply(spark, lambda c: text.polyline(text.downsample(c, 9)), points, kind)
    drawn = [unquote(maps.Line([x], "s").drawn(9, 1)).split("enc:")[1] for x in lines]
    assert drawn == thin
