"""Every query of the subpackage over the smallest tables, against its contract."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import tokenizers
import xxhash

from tests.llm.test_native import like, paragraphs, targets
from waymark.llm import licenses, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def rows():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: [r.asDict() for r in queries.queries()[name](spark, SF).collect()]


def by_id(found: list[dict], rows: list[dict]) -> list[tuple[dict, dict]]:
    own = {r["doc_id"]: r for r in found}
    assert len(own) == len(found) == len(rows)
    return [(r, own[r["doc_id"]]) for r in rows]


def words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fold(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(run, name):
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    out = run(name)
    assert set(columns) == set(out[0])
    assert sorted(map(str, ([r[c] for c in columns] for r in out))) == sorted(map(str, map(list, found.fetchall())))


def test_op1_and_op3(run, rows):
    t = tokenizers.Tokenizer.from_file(queries.byte_bpe())
    t.no_truncation()
    t.no_padding()
    start = 0
    ids = {}
    files, coded = ({r["doc_id"]: r for r in run(name)} for name in ("op1_token_file", "op3_bpe"))
    assert len(files) == len(coded) == len(rows)
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        f, c = files[r["doc_id"]], coded[r["doc_id"]]
        assert (f["start"], f["n_tokens"], f["ids_crc32"]) == (start, len(ids) + 1, zlib.crc32(raw + (2).to_bytes(4, "little")))
        assert (c["n_tokens"], c["ids_sha256"], c["decoded_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        start += len(ids) + 1


def test_op2(run, rows):
    def fingerprint(text):
        w = words(lowered(text))
        grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    low = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints.items():
            best = min(low[b] for b, y in prints.items() if (x ^ y).bit_count() <= 4)
            if best < low[a]:
                low[a], changed = best, True
    for r, o in by_id(run("op2_simhash"), rows):
        assert (o["fingerprint"], o["component_id"]) == (f"{prints[r['doc_id']]:016x}", low[r["doc_id"]])


def test_op5(run, rows):
    own = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for r in rows:
        for k, notices in licenses.NOTICES.items():
            for i, t in enumerate(notices):
                n = min(5, len(own(t)))
                of = grams(own(t), n)
                if len(of & grams(own(r["text"]), n)) >= 0.8 * len(of):
                    want.add((r["doc_id"], k, i))
    assert {(r["doc_id"], r["license"], r["notice"]) for r in run("op5_license_scan")} == want and want


def test_op6(run, rows):
    found = {r["doc_id"]: r for r in run("op6_fingerprints")}
    order = sorted(rows, key=lambda r: -r["doc_id"])
    assert len(found) == len(rows)
    prints = defaultdict(set)
    for i, r in enumerate(order):
        text, after = r["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        half = len(text) // 2
        edited, o = text[: len(text) - half] + after[:half], found[r["doc_id"]]
        assert (o["n_chars"], o["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(o["near_edited"] - like(paragraphs(text), paragraphs(edited))) < 1e-12 and abs(o["near_next"] - like(paragraphs(text), paragraphs(after))) < 1e-12
        prints[text].add(o["fingerprint"])
        prints[edited].add(o["edited_fingerprint"])
    assert all(len(x) == 1 for x in prints.values())


def test_op8(run, rows):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    want, taken = targets(sizes), Counter()
    for r, o in by_id(run("op8_mixing"), rows):
        n = len(words(r["text"]))
        assert (o["size"], o["source_size"]) == (n, sizes[r["source"]]) and abs(o["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= o["taken"] <= 3 * n and (n == 0 or o["taken"] % n == 0)
        taken[r["source"]] += o["taken"]
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], 60) for s in sizes), (taken, want)


def test_op9(run, rows):
    tokens = {r["doc_id"]: [*words(lowered(r["text"])), None] for r in rows}
    count = Counter(w for r in rows if fold(r["doc_id"], 7) != 2 for w in tokens[r["doc_id"]])
    total = sum(count.values())
    better = 0.0
    for r, o in by_id(run("op9_ngram_lm"), rows):
        own = tokens[r["doc_id"]]
        assert (o["held_out"], o["n_tokens"], o["n_known"], o["train_tokens"]) == (fold(r["doc_id"], 7) == 2, len(own), sum(count[w] > 0 for w in own), total)
        assert abs(o["base_score"] - sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in own)) < 1e-6 * len(own)
        better += (o["score"] - o["base_score"]) * o["held_out"]
    assert better > 0


def test_op10(run, rows):
    right = []
    for r, o in by_id(run("op10_language_id"), rows):
        assert o["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= o["score"] <= 1
        assert (o["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        if o["held_out"] and r["lang"] and o["lang_pred"] != "und":
            right.append(o["lang_pred"] == r["lang"])
    assert np.mean(right) > 0.95
