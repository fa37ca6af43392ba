"""Sessions, and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()


def session(name: str = "waymark", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC, or the one that is there."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession | None = None) -> None:
    """Sends this package to the executors, once for an application."""
    spark = spark or SparkSession.getActiveSession()
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for x in top.rglob("*.py"):
            z.write(x, x.relative_to(top.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def partitions(df: DataFrame, each: int = 256 << 20) -> int:
    """How many partitions to deal df to: as the session says, or more if the files it is read from would give over `each` bytes to one."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 58)  # tables without files count as endless
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // each))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a new temporary one only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        app = spark.sparkContext.applicationId
        path = _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='waymark-')}")
    return path.rstrip("/")


def local_path(path: str) -> str:
    """A path as the operating system knows it; ValueError for one that only Spark reads."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"files are written one by one to a mounted folder, not to {path}")
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, below one for this application."""
    return f"{shared_dir(spark)}/waymark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has put into the shared folder; no result made from it can be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, "")).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by stored() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
