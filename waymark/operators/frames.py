"""Choosing frames: offset and limit, a list of frames, the cheapest path through a track's frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.operators.track import resequenced

#: How far apart kept frames may be, and what a skipped frame costs (squared).
WINDOW, VELOCITY = 4, 100.0


def offset_limit(frames: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Frames from `offset` on, at most `limit` (0 keeps none); past the end there are none."""
    df = frames.filter(F.col("seq") >= offset)
    if limit is not None:
        df = df.filter(F.col("seq") < offset + limit)
    return resequenced(df)


def gather(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """The frames listed in kept (track_id, kept: array), in the order of the list."""
    wanted = kept.select("track_id", F.posexplode("kept").alias("__to", "__from"))
    df = frames.join(wanted, (frames.track_id == wanted.track_id) & (frames.seq == wanted["__from"])).drop(wanted.track_id)
    return df.withColumn("seq", F.col("__to").cast("long")).drop("__to", "__from")


def band_pairs(frames: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pairs of frames at most `window` apart: track_id, i, j. No row meets rows outside its band."""
    n = frames.groupBy("track_id").agg(F.max("seq").alias("last"))
    df = frames.select("track_id", F.col("seq").alias("i")).join(n, "track_id").filter(F.col("i") < F.col("last"))
    return df.select("track_id", "i", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("last"), F.col("i") + window))).alias("j"))


def match_cost(c0: Column, c_r: Column, diagonal: Column) -> Column:
    """Cost of two frames from how far their center moves (c0) and the points' misfit (c_r); half the diagonal if either is missing or the misfit is as large."""
    return F.when((c_r < diagonal * 0.5) & c0.isNotNull(), F.least(c0, c_r)).otherwise(diagonal * 0.5)


def edge_cost(match: Column, i: Column, j: Column, velocity: float = VELOCITY) -> Column:
    skipped = (j - i - 1).cast("double")
    return match + velocity * skipped * skipped


def best_paths(edges: DataFrame, cost: str = "cost") -> DataFrame:
    """A row for each track: kept, the frames on the cheapest path from the first to the last.

    edges: track_id, i, j, cost with i < j.  The earliest predecessor wins a
    tie.  One track is one dynamic program over its edges in order; tracks run
    side by side.
    """

    def solve(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["i", "j"], kind="stable")
        n = int(pdf["j"].max()) + 1
        total, before = np.full(n, np.inf), [0] * n
        total[0] = 0.0
        for i, j, c in zip(pdf["i"].tolist(), pdf["j"].tolist(), pdf[cost].tolist(), strict=True):
            if (new := c + total[i]) < total[j]:
                total[j], before[j] = new, i
        path, at = [n - 1], before[n - 1]
        while at != 0:
            path.append(at)
            at = before[at]
        path.append(0)
        return pd.DataFrame({"track_id": [pdf["track_id"].iloc[0]], "kept": [path[::-1]], "total": [float(total[n - 1])]})

    schema = T.StructType([edges.schema["track_id"], T.StructField("kept", T.ArrayType(T.LongType())), T.StructField("total", T.DoubleType())])
    return edges.select("track_id", "i", "j", cost).groupBy("track_id").applyInPandas(solve, schema)


def chosen(frames: DataFrame, edges: DataFrame, cost: str = "cost") -> DataFrame:
    """best_paths() for all tracks of frames; a track of one frame, which has no edge, keeps it twice as its first and last."""
    single = frames.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    return best_paths(edges, cost).unionByName(single.select("track_id", F.expr("array(0L, 0L)").alias("kept"), F.lit(0.0).alias("total")))


def kept_json(kept: DataFrame) -> DataFrame:
    """track_id, value: the kept frames as a JSON array of their numbers."""
    return kept.select("track_id", F.to_json("kept").alias("value"))


def frame_number(path: Column) -> Column:
    """The number made of all digits of a file's path, by which frames are ordered."""
    return F.regexp_replace(path, "[^0-9]", "").cast("decimal(38,0)")


def image_costs(frames: DataFrame, decode: Callable | None = None, cost: Callable | None = None, window: int = WINDOW, velocity: float = VELOCITY) -> DataFrame:
    """Edges (track_id, i, j, cost) between frames (track_id, seq, body: the image file) at most `window` apart.

    A frame's image goes to the few rows of its band, so each is joined to at
    most 2 x window others.  decode makes an array of a file (PNG by default),
    cost a number of two arrays; a pair of which that fails costs half the
    diagonal of 640 x 480.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    from waymark.functions import images, vision
    from waymark.session import ship

    decode, cost = decode or images.from_png, cost or vision.match_cost
    ship(frames.sparkSession)

    def run(a: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for first, second in a:
            out = []
            for x, y in zip(first.to_pylist(), second.to_pylist(), strict=True):
                try:
                    out.append(float(cost(decode(x), decode(y))))
                except Exception:  # noqa: BLE001  an image that can't be read or compared
                    out.append(400.0)
            yield pa.array(out, pa.float64())

    run.__annotations__ = {"a": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    at = lambda k: frames.select("track_id", F.col("seq").alias(k), F.col("body").alias(f"b_{k}"))
    both = band_pairs(frames, window).join(at("i"), ["track_id", "i"]).join(at("j"), ["track_id", "j"])
    match = F.arrow_udf(run, "double")("b_i", "b_j")
    return both.select("track_id", "i", "j", edge_cost(match, F.col("i"), F.col("j"), velocity).alias("cost"))


def top_features(features: DataFrame, n: int) -> DataFrame:
    """The n strongest features (track_id, seq, feature, response) of each frame, the lower feature number on a tie."""
    order = Window.partitionBy("track_id", "seq").orderBy(F.col("response").desc(), "feature")
    return features.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= n).drop("__k")


def feature_matches(features: DataFrame, window: int = WINDOW, ratio: float = 0.75) -> DataFrame:
    """For frames at most `window` apart: each feature of the first with its nearest of the second, if that is nearer than ratio x the second nearest.

    features: track_id, seq, feature, descriptor (array of numbers).  The result
    has track_id, i, j, feature, nearest, distance.
    """
    pairs = band_pairs(features.select("track_id", "seq").distinct(), window)
    at = lambda k, f, d: features.select("track_id", F.col("seq").alias(k), F.col("feature").alias(f), F.col("descriptor").alias(d))
    both = pairs.join(at("i", "feature", "d_i"), ["track_id", "i"]).join(at("j", "nearest", "d_j"), ["track_id", "j"])
    square = F.aggregate(F.zip_with("d_i", "d_j", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    order = Window.partitionBy("track_id", "i", "j", "feature").orderBy("distance", "nearest")
    near = both.withColumn("distance", F.sqrt(square)).withColumns({"__k": F.row_number().over(order), "__second": F.lead("distance").over(order)})
    return near.filter((F.col("__k") == 1) & (F.col("distance") < ratio * F.col("__second"))).select("track_id", "i", "j", "feature", "nearest", "distance")
