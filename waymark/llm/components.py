"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._shared import discard, map_arrow, stored


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n nodes the smallest node that edges a-b (on top of the labels so far) reach from it."""
    label = np.arange(n) if label is None else label.copy()
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a piece of a partition, replaced by stars around the smallest nodes."""

    def stars(parts: list[np.ndarray]) -> pa.RecordBatch:
        e = np.concatenate(parts)
        nodes, at = np.unique(e, return_inverse=True)
        at = at.reshape(e.shape)
        root = forest(len(nodes), at[:, 0], at[:, 1])
        own = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
        n += batch.num_rows
        if n >= 1 << 21:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b: long), root being the smallest node of its component.

    Large-star and small-star steps in turn, each after the edges of a partition
    have been reduced to a forest; a node's neighbours are never gathered: their
    minimum is a partial aggregation and goes back to the edges in a join.
    Nulls in an edge drop the edge; no edges give no rows.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    now = stored(map_arrow(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), _contract, "a long, b long").distinct(), "edges")
    while True:
        # large star: every larger neighbour of a node is linked to the node's smallest
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
        large = both.join(low, both.a == low.n).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "edges")
        # small star: a node's smaller neighbours, and the node, are linked to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "n")
        small = large.join(low, large.a == low.n).select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        small = stored(map_arrow(small.filter("a <> b"), _contract, "a long, b long").distinct(), "edges")
        same = small.exceptAll(now).isEmpty() and now.exceptAll(small).isEmpty()
        discard(large)
        discard(now)
        now = small
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
