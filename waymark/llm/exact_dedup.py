"""Exact dedup by distributed most-significant-digit radix partitioning.

The string that is sorted is a document's length in bytes followed by its
bytes.  Each round splits every group by its next digits, the following `width`
bytes (the first round also by the length), and names a group by its largest
row.  A group that has become a single row, or whose bytes have ended, is done;
only the others' remaining bytes go to the next round, with wider digits.
Equality rests on all bytes; the sha256 is only reported.

A group of copies is never gathered: its size and largest row come from a
partial aggregation, and go back to its rows in a join whose skewed partitions
Spark splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._shared import stored

#: Bytes of the first digit, how much wider each next one is, and the widest.
FIRST, WIDER, WIDEST = 64, 16, 1 << 20
#: Stands for a null doc_id, below all others.
NONE = -(1 << 63)


def _order(doc_id: str):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NONE))


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty.  Of equal texts the row with the largest doc_id
    is kept (a null doc_id is smaller than any).  Of rows that repeat both
    doc_id and text exactly one is kept.  Other columns are not read.  An empty
    table gives an empty result.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("rest"))
    rows = rows.select("doc_id", F.lit(None).cast("string").alias("gid"), F.octet_length("rest").alias("len"), "rest", F.sha2("rest", 256).alias("text_sha256"))
    width, keys, done = FIRST, ["len", "head"], []
    while True:
        keyed = rows.withColumns({"head": F.expr(f"substring(rest, 1, {width})"), "rest": F.expr(f"substring(rest, {width + 1})"), "tie": F.monotonically_increasing_id()})
        # the digest in a group's name only tells rows of one doc_id apart
        largest = F.max(F.struct(_order("doc_id").alias("id"), F.col("text_sha256")))
        groups = keyed.groupBy(*keys).agg(largest.alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        # stored by itself: Spark can split a skewed partition of a join only if no aggregation stands right below it
        groups = stored(groups.select(*(F.col(k).alias(f"g_{k}") for k in keys), F.col("top.id").alias("top_id"), F.concat_ws(":", "top.id", "top.text_sha256").alias("top"), "n"), "groups")
        # both sides dealt by key at every size: copies of the small side would only do for small inputs
        joined = keyed.join(groups.hint("merge"), [keyed[k] == groups[f"g_{k}"] for k in keys], "left")
        ended = F.col("n").isNull() | (F.octet_length("rest") == 0)
        table = stored(
            joined.select(
                "doc_id",
                F.coalesce("top", F.concat_ws(":", _order("doc_id"), "text_sha256")).alias("gid"),
                F.coalesce("top_id", _order("doc_id")).alias("top_id"),
                F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                "len",
                F.when(~ended, F.col("rest")).alias("rest"),
                "text_sha256",
                "tie",
            ),
            "radix",
        )
        done.append(table.filter("rest is null").withColumn("kept", _order("doc_id") == F.col("top_id")))
        rows = table.filter("rest is not null").select("doc_id", "gid", "len", "rest", "text_sha256")
        if rows.isEmpty():
            break
        width, keys = min(width * WIDER, WIDEST), ["gid", "head"]
    out = reduce(DataFrame.unionByName, done)
    # rows that repeat the largest doc_id of their group: the first of them stays
    repeated = stored(out.filter("kept and group_size > 1").groupBy("gid").agg(F.min("tie").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("gid", "first"), "repeated")
    if not repeated.isEmpty():
        out = out.join(repeated, "gid", "left").withColumn("kept", F.col("kept") & (F.col("first").isNull() | (F.col("first") == F.col("tie"))))
    return out.select("doc_id", F.nullif("top_id", F.lit(NONE)).alias("keep_id"), "group_size", "kept", "text_sha256")


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that exact_groups() keeps, with all their columns; of rows that repeat doc_id and text any one.

    Null texts count as empty ones, and one of all empty texts stays; a null
    doc_id is smaller than any; texts of any length are compared whole; an
    empty table gives an empty one.  Columns that begin with two underscores are the operator's own.
    """
    groups = exact_groups(df, doc_id, text)
    gone = groups.filter("doc_id is distinct from keep_id").select(_order("doc_id").alias("__gone"), F.col("text_sha256").alias("__sha"))
    own = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256)
    kept = df.join(gone, (_order(doc_id) == gone["__gone"]) & (own == gone["__sha"]), "left_anti")
    if groups.filter("not kept and doc_id <=> keep_id").isEmpty():
        return kept
    return kept.withColumn("__text", F.coalesce(text, F.lit(""))).dropDuplicates([doc_id, "__text"]).drop("__text")
