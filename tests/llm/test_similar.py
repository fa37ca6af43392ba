"""The pipeline's near-dedup stage against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline as pipeline
from waymark.llm import similar
from waymark.llm.components import forest


def corpus(seed: int = 3) -> list[tuple]:
    """Texts, and copies of each with more and more words changed: similarities from 1 down to below 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = [word() for _ in range(12)]
    out = []
    for k in range(25):
        base = [word() for _ in range(rng.randint(30, 300))] + line
        for changed in range(8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(changed, 1 + k % 7)):
                copy[at] = word()
            out.append(" ".join(copy))
    out += ["One two three", "one two THREE", "one two four", "", None]
    ids = rng.sample(range(10_000), len(out))
    return [(i, t, "en", "a", 1) for i, t in zip(ids, out, strict=True)]


def slow(rows: list[tuple], width: int = 5, similarity: float = 0.8) -> tuple[set, list[tuple]]:
    """doc_ids that stay, and the pairs that are linked."""
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    pairs = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if x and y and len(x & y) >= similarity * len(x | y)]
    root = forest(len(rows), np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    low: dict[int, int] = {}
    for r, k in zip(rows, root.tolist(), strict=True):
        low[k] = min(low.get(k, r[0]), r[0])
    return set(low.values()), pairs


def test_near_stage_finds_all_similar_pairs(spark):
    rows = corpus()
    kept, pairs = slow(rows)
    assert len(pairs) > 200 and len(kept) > 25
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = pipeline.near(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(kept)
    assert similar.near_dedup(docs.limit(0)).count() == 0


def test_rows_without_id_stay_and_link(spark):
    w = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(w), " ".join([*w[:-6], *"uvwxyz"]), " ".join([*"uvwxyz", *w[6:-6], *"uvwxyz"])
    docs = spark.createDataFrame([(2, a), (None, b), (1, c), (3, "else"), (3, "else")], "doc_id long, text string")
    assert slow([(2, a), (9, b), (1, c)])[1] == [(1, 0), (2, 1)]
    assert sorted(str(r["doc_id"]) for r in similar.near_dedup(docs).collect()) == ["1", "3", "3", "None"]


def test_large_keys_are_cut_into_blocks(spark, monkeypatch):
    """Two blocks or more for most keys: what the blocks leave apart is found across them."""
    monkeypatch.setattr(similar, "USUAL", 32)
    monkeypatch.setattr(similar, "SPLIT", 24)
    rows = corpus(8)
    kept, pairs = slow(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert sorted(r["doc_id"] for r in similar.near_dedup(docs).collect()) == sorted(kept) and len(pairs) > 200


def test_fingerprints_by_bit():
    texts = [b"a b c d e f g", b"a b c d e f h i j k", b"x", b"q " * 2000 + b"r s t u v w"]
    h, n = similar.shingled([*texts, b" "], 5)
    assert n.tolist() == [3, 6, 1, 7, 0]
    got = similar.fingerprints(h, n[:4])
    at = 0
    for k, m in enumerate(n[:4].tolist()):
        bits = []
        for seed in similar._SEEDS[: similar.WORDS]:
            for byte in np.ascontiguousarray(similar.ngram_lm._mix(h[at : at + m] ^ seed)).view(np.uint8).reshape(m, 8).T.tolist():
                bits += [int(2 * sum(x >> (7 - i) & 1 for x in byte) > m) for i in range(8)]
        assert np.unpackbits(got[k]).tolist() == bits
        at += m


def test_tries_meet_as_often_as_they_say():
    """Pairs that differ in each bit by the chance of the least similarity: at most MISS of them meet nowhere."""
    t = similar.Tries.of(1_000_000, 0.8)
    p = np.arccos(1.6 / 1.8) / np.pi
    x = np.packbits(np.random.default_rng(1).random((20_000, 64 * similar.WORDS)) < p, axis=1).view(np.uint64)
    met = t.met_before(x, np.full(len(x), len(t.paths))) & (np.bitwise_count(x).sum(axis=1) <= t.errors)
    assert (~met).mean() < 2 * similar.MISS
