"""Strings, URLs, hashes and polylines, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.session import ship

#: FNV-1a, 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3

#: Kinds of cached responses, their folders and file endings.
KINDS = {"streetview": ("streetview", "jpg"), "map": ("map", "png"), "metadata": ("metadata", "json")}

#: Fixed value: where the map service is switched on.
ENABLE_URL = "https://console.cloud.google.com/apis/library/static-maps-backend.googleapis.com"


def percent_encode(value: Column) -> Column:
    """All bytes but A-Z a-z 0-9 - _ . ~ as %XX."""
    quoted = F.url_encode(value)
    for have, want in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(have), F.lit(want))
    return quoted


def without_key(url: Column) -> Column:
    """A URL without its query parameters named key that have a value; without the question mark if none is left."""
    head = F.substring_index(url, "?", 1)
    query = F.substr(url, F.char_length(head) + 2)
    rest = F.array_join(F.filter(F.split(query, "&", -1), lambda p: ~p.startswith("key=")), "&")
    return F.when(~F.contains(url, F.lit("?")), url).when(rest == "", head).otherwise(F.concat(head, F.lit("?"), rest))


def redact_key(text: Column) -> Column:
    """Free text with the values of key parameters hidden: at the start, after ? or &, or right behind another key=."""
    return F.regexp_replace(text, r"(?U)(?<=^|[?&]|key=)key=[^&)\s]*", "key=REDACTED")


def number(x: Column) -> Column:
    """A double as the shortest decimal that reads back the same, without a trailing .0 and without an exponent."""
    plain = F.regexp_replace(x.cast("string"), r"\.0$", "")
    digits = F.regexp_replace(F.regexp_extract(plain, r"^-?([0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(plain, r"E(-?\d+)$", 1).cast("int")
    bare = F.replace(digits, F.lit("."))
    shift = 1 + power
    wide = F.when(shift <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -shift), bare)).when(shift >= F.char_length(bare), F.rpad(bare, shift, F.lit("0"))).otherwise(F.concat(F.substr(bare, F.lit(1), shift), F.lit("."), F.substr(bare, shift + 1)))
    return F.when(~F.contains(plain, F.lit("E")), plain).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), wide))


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_many(texts: list[bytes | None]) -> np.ndarray:
    """FNV-1a of many byte strings: one step for all of them at each position."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i] or b""))
    lengths = np.array([len(texts[i] or b"") for i in order])
    h = np.full(len(texts), FNV_OFFSET, np.uint64)
    if len(texts) and lengths[0]:
        data = np.frombuffer(b"".join(texts[i] or b"" for i in order), np.uint8)
        start = np.cumsum(lengths) - lengths
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        for k in range(lengths[0]):
            m = active[k]
            h[:m] = (h[:m] ^ data[start[:m] + k]) * np.uint64(FNV_PRIME)
    out = np.empty(len(texts), np.uint64)
    out[order] = h
    return out


def digest(url: Column) -> Column:
    """Name of a URL in the cache: 16 hex digits of FNV-1a of the URL without its key. Null for null. An Arrow UDF: 64-bit wrap-around has no built-in."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.cast(pa.binary()).to_pylist()
            yield pa.array([None if t is None else f"{h:016x}" for t, h in zip(texts, fnv1a_many(texts).tolist(), strict=True)], pa.string())

    ship()
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(without_key(url))


def cache_path(root: str, kind: Column, name: Column) -> Column:
    """root/kind/first two digits/digits.ending; null for an unknown kind."""
    folder, ending = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (d, e) in KINDS.items():
        folder, ending = F.when(kind == k, d).otherwise(folder), F.when(kind == k, e).otherwise(ending)
    return F.concat(F.lit(root.rstrip("/") + "/"), folder, F.lit("/"), F.substring(name, 1, 2), F.lit("/"), name, F.lit("."), ending)


def failure_message(status: Column, message: Column) -> Column:
    """What went wrong with a map request, for people: never with the request itself, which holds the key."""
    hint = F.when(status.isin(401, 403), F.lit("\nThe map API is probably not enabled for this key; it is separate from the imagery API.")).otherwise("")
    return F.concat(F.lit("Minimap request failed: "), redact_key(message), hint, F.lit(f"\nEnable the Maps Static API at {ENABLE_URL}"))


def imagery_url(lat: Column, lng: Column, heading: Column, key: str) -> Column:
    return F.concat(F.lit("https://maps.googleapis.com/maps/api/streetview?size=640x480&location="), number(lat), F.lit(","), number(lng), F.lit("&fov=100&source=outdoor&heading="), number(heading), F.lit(f"&pitch=0&key={key}"))


def lookup_url(lat: Column, lng: Column, key: str) -> Column:
    return F.concat(F.lit("https://maps.googleapis.com/maps/api/streetview/metadata?location="), number(lat), F.lit(","), number(lng), F.lit(f"&source=outdoor&key={key}"))


def polyline_value(delta: Column) -> Column:
    """One difference in polyline form: zig-zag, five bits a character, lowest first."""
    z = F.when(delta < 0, -2 * delta - 1).otherwise(2 * delta).cast("long")
    part = lambda k: F.shiftright(z, 5 * k)
    chars = [F.when(part(k) > 0, F.char(F.when(part(k + 1) > 0, F.lit(95)).otherwise(63) + part(k).bitwiseAND(F.lit(31)))).otherwise(F.char(F.lit(63)) if k == 0 else F.lit("")) for k in range(7)]
    return F.concat(*chars)


def polyline(points: Column) -> Column:
    """Polyline of an array of points (lat, lng)."""
    e5 = lambda v: F.round(v * 100000.0).cast("long")
    before = lambda i, name: F.coalesce(e5(F.get(points, i - 1)[name]), F.lit(0).cast("long"))
    one = lambda p, i: F.concat(polyline_value(e5(p["lat"]) - before(i, "lat")), polyline_value(e5(p["lng"]) - before(i, "lng")))
    return F.array_join(F.transform(points, one), "")


def downsample(points: Column, most: Column | int) -> Column:
    """At most `most` of the points, evenly by index, first and last kept; all of them for 0."""
    most = F.lit(most) if isinstance(most, int) else most
    n = F.size(points)
    step = (n - 1) / F.nullif((most - 1).cast("double"), F.lit(0.0))
    pick = F.transform(F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0))), lambda i: F.get(points, F.round(i * step).cast("int")))
    return F.when((n <= most) | (most == 0), points).when(most == 1, F.slice(points, 1, 1)).otherwise(pick)
