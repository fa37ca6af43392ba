from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from waymark.llm import exact_dedup, simhash
from waymark.llm.components import components, forest


def brute_groups(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    return by


@pytest.mark.parametrize("width", [1, 3, 64])
def test_exact_groups(docs, rows, width, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FIRST", width)
    if width < 64:
        monkeypatch.setattr(exact_dedup, "WIDER", 64)
    got = exact_dedup.exact_groups(docs).collect()
    by = brute_groups(rows)
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        group = next(g for t, g in by.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(group)
        assert r["keep_id"] == max((d for d in group if d is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_exact_dedup_keeps_columns(docs, rows, empty):
    got = exact_dedup.exact_dedup(docs)
    assert got.columns == docs.columns
    assert sorted((r["text"] or "") for r in got.collect()) == sorted(brute_groups(rows))
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0


def slow_fingerprint(text: str) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups(docs, rows, empty):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_groups(docs).collect()}
    fps = [slow_fingerprint(r[1] or "") for r in rows]
    known, at = np.unique(np.array(fps, np.uint64), return_inverse=True)
    near = np.bitwise_count(known[:, None] ^ known[None, :]) <= 4
    root = forest(len(known), *np.nonzero(np.triu(near, 1)))[at]
    low = defaultdict(list)
    for r, k in zip(rows, root, strict=True):
        low[k] += [r[0]] * (r[0] is not None)
    assert got == {(r[0], f"{fp:016x}"): min(low[k], default=None) for r, fp, k in zip(rows, fps, root, strict=True)}
    assert simhash.near_groups(empty).count() == 0
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {min(v) for v in low.values() if v} | {None}
    assert simhash.near_dedup(empty).count() == 0


def cluster(n: int, flips: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 1 << 63, n, np.uint64)
    center = np.uint64(0x0123456789ABCDEF)
    for i in range(n // 2):
        x = center
        for b in rng.integers(0, 64, rng.integers(0, flips)):
            x ^= np.uint64(1) << np.uint64(b)
        fp[i] = x
    return np.unique(fp)


@pytest.mark.parametrize("errors", [0, 2, 4])
def test_trie_join(errors):
    fp = cluster(900, 9, errors)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= errors
    want = forest(len(fp), *np.nonzero(np.triu(near, 1)))
    assert (simhash.trie_join(np.zeros(len(fp), int), fp, errors) == want).all()
    key = np.arange(len(fp)) // 100
    got = simhash.trie_join(key, fp, errors)
    near &= key[:, None] == key[None, :]
    assert (got == forest(len(fp), *np.nonzero(np.triu(near, 1)))).all()


def test_hot_blocks_are_cut_further(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 20)
    fp = cluster(600, 8, 5)
    found = components(simhash.links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), 4)).collect()
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    want = forest(len(fp), *np.nonzero(np.triu(near, 1)))
    group = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    got = np.arange(len(fp))
    for r in found:
        got[group[r["node"]]] = group[r["root"]]
    partition = lambda label: sorted(tuple(np.flatnonzero(label == k)) for k in np.unique(label))
    assert partition(got) == partition(want)


def test_components(spark):
    rng = np.random.default_rng(2)
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    some = [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (250, 2))]
    edges = path + star + some + [(5, 5), (None, 3), (-9, -7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    real = [e for e in edges if None not in e]
    nodes = sorted({x for e in real for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    root = forest(len(nodes), np.array([at[a] for a, _ in real]), np.array([at[b] for _, b in real]))
    assert got == {x: nodes[root[i]] for x, i in at.items() if root[i] != i}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
