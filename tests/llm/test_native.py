"""Chat formatting, license scan, fingerprints and mixing against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from waymark.llm import chat, iblt, licenses, mixing

TURNS = "conv_id long, turn long, role string, text string, formatted string, window int"


def conversations() -> list[tuple]:
    rng = random.Random(4)
    words = ["<|im_start|>", "<|im_end|>\n", "\\", "<\\|", "|>", "<", "word", "日本", "\n", "<|im_sep|>x"]
    out = []
    for c in range(25):
        first = rng.random() < 0.5
        for t in range(rng.randint(1, 14)):
            role = "system" if first and t == 0 else ("user", "assistant")[(t + first) % 2]
            out.append((c, t, role, "".join(rng.choice(words) for _ in range(rng.randint(0, 60)))))
    out += [(100, 0, None, None), (101, 0, "system", "only"), (None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (102, 1, "assistant", "same"), (102, 1, "assistant", "same"), (103, 0, "we<|im_sep|>ird\n", "x"), (104, 0, "assistant", "y" * 5000)]
    return [(*r, "clash", 3) for r in out]


def key(x):
    return (x is not None, x if x is not None else 0)


def turns_of(rows) -> dict:
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return {c: [(r[2] or "", r[3] or "") for r in sorted(g, key=lambda r: (key(r[1]), r[2] or "", r[3] or ""))] for c, g in by.items()}


@pytest.mark.parametrize(("budget", "history"), [(2048, 512), (120, 40), (10, 0)])
def test_chats_come_back(spark, budget, history):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    windows = chat.format_chats(df, budget, history)
    want = turns_of(rows)
    back = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    assert set(back) == set(want)
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == turns
        assert back[c]["loss_text"] == "".join(t for r, t in turns if r == "assistant")
    plain = lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|")
    for w in windows.collect():
        turns = want[w["conv_id"]]
        blocks = [f"<|im_start|>{plain(r)}<|im_sep|>{plain(t)}<|im_end|>\n" for r, t in turns]
        system = turns[0][0] == "system"
        parts = re.findall(r"<\|im_start\|>.*?<\|im_end\|>\n", w["formatted"], re.S)
        assert len(parts) == w["n_turns"] and "".join(parts) == w["formatted"]
        assert w["n_tokens"] == sum(-(-len(p.encode()) // 4) for p in parts)
        new = w["n_turns"] - (w["n_repeated"] or system)  # a turn that doesn't fit beside the system turn stands there all the same
        assert w["n_tokens"] <= budget or new <= 1
        if w["window"]:
            repeated = parts[system : w["n_repeated"]]
            assert not system or parts[0] == blocks[0]
            assert sum(-(-len(p.encode()) // 4) for p in repeated) <= history
        for m in w["loss"]:
            assert m["start"] >= sum(len(p) for p in parts[: w["n_repeated"]])


def test_no_chats(spark):
    windows = chat.format_chats(spark.createDataFrame([], TURNS))
    assert windows.count() == 0 and chat.read_back(windows).count() == 0


def test_given_tokens_count(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t}", 10) for t in range(6)]
    w = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tok int"), 25, 10, tokens="tok").orderBy("window").collect()
    assert [(r["n_turns"], r["n_repeated"], r["n_tokens"]) for r in w] == [(2, 0, 20), (2, 1, 20), (2, 1, 20), (2, 1, 20), (2, 1, 20)]


def test_a_long_conversation(spark):
    """100,000 turns; memory would not do for a copy of the conversation in each of its windows."""
    text = F.concat(F.lit("word "), F.repeat(F.col("id").cast("string"), 40))
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 0, "assistant").otherwise("user").alias("role"), text.alias("text"))
    windows = chat.format_chats(rows)
    assert windows.agg(F.max("n_tokens")).first()[0] <= 2048
    back = chat.read_back(windows).select(F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("|"), t["text"])), "\n"), 256).alias("h"), F.sha2("loss_text", 256).alias("l")).first()
    own = [("system" if i == 0 else "user" if i % 2 else "assistant", "word " + str(i) * 40) for i in range(100_000)]
    assert back["h"] == hashlib.sha256("\n".join(f"{r}|{t}" for r, t in own).encode()).hexdigest()
    assert back["l"] == hashlib.sha256("".join(t for r, t in own if r == "assistant").encode()).hexdigest()


def paragraphs(text: str | None) -> set[str]:
    return set(re.findall(r"[^\n]{1,200}", text or ""))


def like(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs, rows, empty):
    got = defaultdict(list)
    for r in iblt.fingerprints(docs).collect():
        got[r["doc_id"]].append(r)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""), reverse=True) + sorted((r for r in rows if r[0] is None), key=lambda r: r[1] or "", reverse=True)
    assert sum(map(len, got.values())) == len(rows)
    prints = defaultdict(set)
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        own = [x for x in got[r[0]] if x["edited_sha256"] == digest and x["n_chars"] == len(text)]
        assert own, (r[0], text[:40])
        assert any(abs(x["near_edited"] - like(paragraphs(text), paragraphs(edited))) < 1e-12 and abs(x["near_next"] - like(paragraphs(text), paragraphs(after))) < 1e-12 for x in own)
        prints[text].add(own[0]["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())
    assert len({next(iter(v)) for t, v in prints.items() if paragraphs(t)}) == len({frozenset(paragraphs(t)) for t in prints if paragraphs(t)})
    assert iblt.fingerprints(empty).count() == 0


def test_large_differences_are_peeled(spark):
    df = spark.range(6).select("id", F.expr("transform(sequence(1, cast(pow(4, id + 1) as int)), x -> xxhash64(x, 1))").alias("a"), F.expr("transform(sequence(3, cast(pow(4, id + 1) as int) + 9), x -> xxhash64(x, 1))").alias("b"))
    for r in iblt.compare(df, {"near": ("a", "b")}).collect():
        assert abs(r["near"] - like(set(r["a"]), set(r["b"]))) < 1e-12
    assert {r["near"] for r in iblt.compare(df.withColumn("b", F.lit(None).cast("array<bigint>")), {"near": ("a", "b")}).collect()} == {0.0}


def test_many_differing_paragraphs_take_no_longer_than_their_number(spark):
    """Time in proportion: what took minutes for 8,000 lines takes seconds for 100,000."""
    lines = lambda k, n: "\n".join(f"{k} line {i}" for i in range(n))
    rows = [(1, lines("a", 100_000)), (2, lines("b", 8000)), (3, lines("b", 8000) + "\nmore"), (4, lines("c", 20_000))]
    start = time.monotonic()
    got = {r["doc_id"]: r for r in iblt.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.monotonic() - start < 60
    texts, order = dict(rows), [4, 3, 2, 1]
    for i, d in enumerate(order):
        after = texts[order[(i + 1) % 4]]
        half = len(texts[d]) // 2
        edited = texts[d][: len(texts[d]) - half] + after[:half]
        assert abs(got[d]["near_next"] - like(paragraphs(texts[d]), paragraphs(after))) < 1e-12
        assert abs(got[d]["near_edited"] - like(paragraphs(texts[d]), paragraphs(edited))) < 1e-12


def test_pairs_named_like_columns_of_the_table(spark):
    df = spark.sql("select array(1L, 2L) a, array(2L, 3L) b, 'old' near")
    assert [r["near"] for r in iblt.compare(df, {"near": ("a", "b")}).collect()] == [1 / 3]


def test_one_row_is_its_own_next(spark):
    r = iblt.fingerprints(spark.createDataFrame([(4, "ab\ncd")], "doc_id long, text string")).first()
    assert (r["near_next"], r["n_chars"]) == (1.0, 5) and r["edited_sha256"] == hashlib.sha256(b"ab\nab").hexdigest()


def test_license_scan(spark, docs, empty):
    filler = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    mit, gpl = licenses.NOTICES["MIT"][1], licenses.NOTICES["GPL-3.0"][0]
    cut = " ".join(mit.split()[:-6])
    rows = [(i, f"{filler(n, i)} {t} {filler(m, i)}") for i, (n, t, m) in enumerate([(0, mit, 0), (500, mit, 3), (37, cut, 90), (3, gpl, 200), (9, gpl.upper().replace(" ", "\n"), 9), (5, " ".join(mit.split()[:20]), 5), (7, mit + " " + filler(8, 0) + " " + gpl, 4000), (1, "Released under the MIT License.", 1)])]
    rows += [(90, None), (91, ""), (94, "x\nAll rights reserved. y"), (94, "all rights served"), (95, "ALL RIGHTS  reserved"), (92, "Released under the MIT"), (93, filler(30_000, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"], r["notice"]): r["containment"] for r in licenses.scan(df).collect()}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n=5: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = {}
    for d, text in rows:
        for k, notices in licenses.NOTICES.items():
            for i, t in enumerate(notices):
                n = min(5, len(words(t)))
                if (share := len(grams(words(t), n) & grams(words(text), n)) / len(grams(words(t), n))) >= 0.8:
                    want[d, k, i] = share
    assert got == want and len(want) >= 8
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty).count() == 0 and licenses.scan(df, {}).count() == 0


def test_many_licenses_in_one_text_take_no_longer_than_their_number(spark):
    mit = licenses.NOTICES["MIT"][1]
    df = spark.createDataFrame([(1, "\n".join([mit] * 2000))], "doc_id long, text string")
    start = time.monotonic()
    assert [(r["license"], r["containment"]) for r in licenses.scan(df).collect()] == [("MIT", 1.0)]
    assert time.monotonic() - start < 20


def test_many_notices_are_joined(spark, monkeypatch):
    rows = [(1, licenses.NOTICES["MIT"][1] + " and all rights reserved"), (1, "Licensed under CC BY 4.0."), (None, "Licensed under CC BY 4.0."), (2, "none")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, licenses.scan(df).collect()))
    monkeypatch.setattr(licenses, "IN_PLAN", 5)
    assert sorted(map(str, licenses.scan(df).collect())) == want and len(want) == 4


def targets(sizes: dict, most: float = 3.0) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        left = sum(weight[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else rest * weight[s] / left for s in names}
        over = {s for s in names if out[s] > most * sizes[s] + 1e-9}
        if not over - full:
            return out
        full |= over


def test_mixture(docs, rows, empty):
    out = mixing.mixture(docs).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    for r in out:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["copies"] <= 3 and r["score"] == "clash"
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 0.5 * min(largest[s], 200))
    again = mixing.mixture(docs.repartition(2)).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "", r["copies"]) for r in out) == sorted((str(r["doc_id"]), r["text"] or "", r["copies"]) for r in again)
    mixed = mixing.apply_mixture(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.mixture(empty).count() == 0


def test_ranks_follow_the_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    out = mixing.mixture(df, weight="w", fraction=0.25).groupBy("source", "w").agg(F.avg("copies").alias("c")).collect()
    c = {(r["source"], r["w"]): r["c"] for r in out}
    assert 2.3 < c["a", 3.0] / c["a", 1.0] < 3.9 and 2.0 < c["b", 3.0] / c["b", 1.0] < 4.5
