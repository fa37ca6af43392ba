"""Tables and files in the folder that every machine of the cluster can read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import clear, discard, new_path, partitions, ship, shared_dir, stored

__all__ = ["clear", "discard", "map_arrow", "named", "new_path", "partitions", "quoted", "shared_dir", "stored", "words"]

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Words are runs of characters other than ASCII white space.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def _release() -> None:
    """Gives memory that a task no longer needs back to the system: workers stay for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """df.mapInArrow(f, schema), with this package sent to the executors first."""
    ship(df.sparkSession)
    # rows are whole documents here: smaller batches than Spark's default, unless the session has its own
    if df.sparkSession.conf.get(BATCH) == "10000":
        df.sparkSession.conf.set(BATCH, "2000")

    def run(batches):
        try:
            yield from f(batches)
        finally:
            _release()

    return df.mapInArrow(run, schema)


def named(df: DataFrame, **columns: str) -> DataFrame:
    """df with columns renamed (new name = old one); what has had one of the new names goes."""
    gone = [c for c in df.columns if c in columns]
    df = df.drop(*gone) if gone else df
    return df.withColumnsRenamed({old: new for new, old in columns.items()})


def quoted(columns: list[str]) -> list[Column]:
    """References to columns of any name."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def words(text: Column) -> Column:
    """Array of the words of a text, repeats included; empty for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")
