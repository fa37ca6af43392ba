"""Requests to services through an injected fetcher, and a shared cache of their answers.

A fetcher is a callable url -> (body, status, message): body for an answer with
status 2xx; else None with the status, or None for a request that was never
completed.  It runs on the executors, `concurrency` requests at once in each
task.  The cache is a table (digest, body) partitioned by kind and shard (the digest's
first two digits); only successes get in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from waymark.functions.text import digest, redact_key
from waymark.session import ship, stored

Fetcher = Callable[[str], tuple[bytes | None, int | None, str]]
CONCURRENCY = 40
ANSWER = "body binary, status int, message string"

#: Lookup answers; fields that are missing get these values.
LOOKUP = "date string, location struct<lat: double, lng: double>, pano_id string, status string"


def http(timeout: float = 30.0) -> Fetcher:
    """A fetcher for real services."""

    def get(url: str) -> tuple[bytes | None, int | None, str]:
        from urllib.error import HTTPError
        from urllib.request import urlopen

        try:
            with urlopen(url, timeout=timeout) as answer:
                return answer.read(), answer.status, ""
        except HTTPError as e:
            return None, e.code, f"HTTP {e.code}"
        except Exception as e:  # noqa: BLE001  whatever kept the request from being completed
            return None, None, str(e)

    return get


def fetch(df: DataFrame, fetcher: Fetcher, url: str = "url", concurrency: int = CONCURRENCY) -> DataFrame:
    """df with body, status and message for each URL; messages never hold a key. A null URL is not asked for."""
    at = df.columns.index(url)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                ask = lambda u: (None, None, "no request") if u is None else fetcher(u)
                got = list(pool.map(ask, batch.column(at).to_pylist()))
                made = [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.binary(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "body", "status", "message"])

    ship(df.sparkSession)
    out = df.mapInArrow(run, T.StructType([*df.schema.fields, *T._parse_datatype_string(ANSWER).fields]))
    return out.withColumn("message", redact_key(F.col("message")))


def default_cache(spark: SparkSession) -> str | None:
    """The cache below the system's folder for such; on a cluster below spark.checkpoint.dir, as all machines write to it; none if there is neither."""
    import os
    import sys

    if not spark.sparkContext.master.startswith("local"):
        shared = spark.conf.get("spark.checkpoint.dir", None)
        return f"{shared.rstrip('/')}/waymark-cache" if shared else None
    home = os.path.expanduser("~")
    by_system = {"darwin": os.path.join(home, "Library", "Caches"), "win32": os.environ.get("LOCALAPPDATA")}
    top = by_system.get(sys.platform, os.environ.get("XDG_CACHE_HOME") or os.path.join(home, ".cache"))
    return f"file://{top}/waymark" if top and os.path.isabs(top) else None


def cached(spark: SparkSession, cache: str | None) -> DataFrame | None:
    """The cache's table; none if it is switched off or not there yet."""
    if not cache:
        return None
    try:
        return spark.read.schema("digest string, body binary, kind string, shard string").parquet(cache)
    except AnalysisException:
        return None


def hits_and_misses(df: DataFrame, cache: DataFrame | None, kind: str, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """df with digest, once with the bodies that are in the cache, once without those rows."""
    named = df.withColumn("digest", digest(F.col(url)))
    if cache is None:
        return named.withColumn("body", F.lit(None).cast("binary")).filter("false"), named
    own = cache.filter(F.col("kind") == kind).dropDuplicates(["digest"]).select("digest", "body")
    return named.join(own, "digest"), named.join(own.select("digest"), "digest", "left_anti")


def fetch_cached(df: DataFrame, fetcher: Fetcher, cache: str | None, kind: str, url: str = "url", concurrency: int = CONCURRENCY) -> DataFrame:
    """fetch(), asking only for what the cache lacks, and for each URL once; new answers are added to it.

    The requests of one call run once: their answers are written down before
    anything reads them.  A cache that can't be written is reported and does not
    stop the result.
    """
    spark = df.sparkSession
    have = cached(spark, cache)
    hits, misses = hits_and_misses(df, have, kind, url)
    asked = fetch(misses.groupBy("digest").agg(F.min(url).alias("__url")), fetcher, "__url", concurrency).drop("__url")
    # written down, not persisted: what is persisted may be lost, and goes when the cache that it was planned with is written to
    asked = stored(asked, "answers")
    if cache:
        new = asked.filter(F.col("body").isNotNull()).select("digest", "body", F.lit(kind).alias("kind"), F.substring("digest", 1, 2).alias("shard"))
        try:
            new.write.mode("append").partitionBy("kind", "shard").parquet(cache)
        except Exception as e:  # noqa: BLE001
            print(f"warning: could not write the cache: {type(e).__name__}")
    found = hits.withColumns({"status": F.lit(200), "message": F.lit("")})
    return found.unionByName(misses.join(asked, "digest"))


def first_error(answers: DataFrame) -> DataFrame:
    """Of each track the first row, by seq, whose request failed: track_id, seq, status, message."""
    bad = answers.filter(F.col("body").isNull())
    return bad.groupBy("track_id").agg(F.min(F.struct("seq", "status", "message")).alias("e")).select("track_id", "e.*")


def parsed_lookups(answers: DataFrame) -> DataFrame:
    """Lookup answers: track_id, seq, date, pano_lat, pano_lng, pano_id, status; absent fields are empty or 0, a broken answer is an error."""
    j = F.from_json(F.col("body").cast("string"), LOOKUP, {"mode": "FAILFAST"})
    df = answers.select("track_id", "seq", j.alias("j"))
    empty, zero = F.lit(""), F.lit(0.0)
    return df.select("track_id", "seq", F.coalesce("j.date", empty).alias("date"), F.coalesce("j.location.lat", zero).alias("pano_lat"), F.coalesce("j.location.lng", zero).alias("pano_lng"), F.coalesce("j.pano_id", empty).alias("pano_id"), F.coalesce("j.status", empty).alias("status"))


def save_files(answers: DataFrame, name: str, folder: str) -> None:
    """Writes each body to folder/name (a column, with folders of its own); the folder must be one that the executors share."""

    def put(rows) -> None:
        import os

        made = set()
        for row in rows:
            path = os.path.join(folder, row[name].lstrip("/"))
            if (own := os.path.dirname(path)) not in made:
                os.makedirs(own, exist_ok=True)
                made.add(own)
            with open(f"{path}.part", "wb") as f:
                f.write(row["body"])
            os.replace(f"{path}.part", path)

    answers.filter(F.col("body").isNotNull()).select(name, "body").foreachPartition(put)


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """JPEG files of a folder in the order of the numbers in their paths: path, number, length, content."""
    from waymark.operators.frames import frame_number

    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder)
    return df.select("path", frame_number(F.col("path")).alias("number"), "length", "content").orderBy("number")


def folder_size(spark: SparkSession, folder: str) -> DataFrame:
    """files and bytes below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("length")
    return df.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
