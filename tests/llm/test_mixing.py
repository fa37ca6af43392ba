"""Sources with one long document among many short ones."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from waymark.llm import mixing


@pytest.mark.parametrize("fraction", [0.3, 0.4, 0.5, 0.6])
def test_a_long_document_leaves_no_hole(spark, fraction):
    """Some ids so that the long text's place in the order differs from source to source."""
    sizes = spark.range(8 * 301).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 301).cast("string").alias("source"), F.when(F.col("id") % 301 == 0, 20_000).otherwise(100 + F.col("id") % 5).alias("n"))
    docs = sizes.select("doc_id", "source", F.expr("repeat('w ', cast(n as int))").alias("text"))
    taken, target = defaultdict(int), {}
    for r in mixing.mixture(docs, weights=(1.0,), fraction=fraction).collect():
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in target), (taken, target)


def test_repeated_rows_that_do_not_fit_together_are_passed_by(spark):
    docs = spark.createDataFrame([(1, "x " * 40, "a")] * 50 + [(k, "y " * 10, "a") for k in range(2, 202)], "doc_id long, text string, source string")
    out = mixing.mixture(docs, fraction=0.2).collect()
    assert len({r["copies"] for r in out if r["doc_id"] == 1}) == 1
    assert abs(sum(r["copies"] * r["size"] for r in out) - out[0]["target"]) <= 5


@pytest.mark.parametrize(("fraction", "seed", "listed"), [(1.0, 1, 64), (0.4, 2, 64), (0.7, 3, 3)])
def test_the_choice_is_the_pareto_order_walked_by_hand(spark, monkeypatch, fraction, seed, listed):
    """Ranks by odds, taken in order as they fit, again and again, and at last the document that comes nearest."""
    monkeypatch.setattr(mixing, "LISTED", listed)
    rng = random.Random(seed)
    rows = [(i, " ".join([f"w{i}"] * int(rng.choice([1, 3, 20, 100]) * rng.uniform(1, 3))), rng.choice("abc"), rng.choice([0.5, 1.0, 4.0])) for i in range(400)] + [(999, "x " * 5000, "a", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, w double").repartition(3)
    got = mixing.mixture(df, weight="w", fraction=fraction).withColumn("u", mixing.uniform(20, F.col("doc_id"), F.col("text"))).collect()
    for source in "abc":
        own = [r for r in got if r["source"] == source]
        target, weighted = own[0]["target"], sum(r["size"] * r["w"] for r in own)
        copies, order = {}, []
        for r in own:
            rate = min(target * r["w"] / weighted, 3.0)
            copies[r["doc_id"]], p = math.floor(rate), rate - math.floor(rate)
            order.append(((r["u"] * (1 - p) / (r["u"] * (1 - p) + (1 - r["u"]) * p)) if p else 1 + r["u"], r["u"], r["doc_id"], r["size"]))
        order.sort()
        gap = target - sum(copies[d] * n for _, _, d, n in order)
        took = True
        while took:
            took = False
            for _, _, d, n in order:
                if n <= gap and copies[d] < 3:
                    copies[d], gap, took = copies[d] + 1, gap - n, True
        near = min(((abs(n - gap), copies[d], rank, u, d) for rank, u, d, n in order if n < 2 * gap and copies[d] < 3 and abs(n - gap) < gap), default=None)
        if near:
            copies[near[-1]] += 1
        assert {r["doc_id"]: r["copies"] for r in own} == copies
