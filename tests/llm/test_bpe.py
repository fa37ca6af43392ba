from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.llm import bpe, rans, token_file
from waymark.llm._shared import new_path
from waymark.llm.queries import byte_bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(byte_bpe())


PIECES = st.sampled_from([" ", "  ", "\n", "\r\n", "\t", " ", "　", "a", "Zé", "don't", "'s", "'", "$'s", "12", ".", "...", "<|endoftext|>", "<|", "日本", "𐍈", "foo_bar", "the", "x" * 40, "a.b", "U.S."])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join) | st.text(max_size=30), min_size=1, max_size=5))
def test_ids_equal_the_library(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    own, reference = bpe.bpe(byte_bpe()), tokenizers.Tokenizer.from_file(byte_bpe())
    for t, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        want = reference.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids).decode() == reference.decode(want, skip_special_tokens=False)


def test_an_added_token_does_not_reach_over_two_texts():
    own = bpe.bpe(byte_bpe())
    ids = list(own.encode([b"a <|endof", b"text|> b"]))
    assert 50256 not in np.frombuffer(b"".join(ids), "<u4")


def test_cuts_are_forced_and_remembered_fragments_are_forgotten(monkeypatch):
    own = bpe.ForcedBoundaryBPE(byte_bpe())
    assert own.forced[ord("a"), ord(" ")] and not own.forced[ord(" "), ord("a")]
    text = b"one two  three. Four\n"
    parts = own.fragments(np.frombuffer(text, np.uint8))
    assert 3 in parts and 4 not in parts
    first = list(own.encode([text]))
    monkeypatch.setattr(bpe, "REMEMBERED", 1)
    assert list(own.encode([text])) == first == list(own.encode([text]))
    assert not own._known


def test_table_round_trip(docs, rows, reference):
    ids = bpe.encode(docs, byte_bpe(), decoded="again")
    assert ids.filter("again <> coalesce(text, '')").count() == 0
    out = bpe.decode(ids, byte_bpe()).select("doc_id", "text", "token_ids", "decoded", "size", bpe.n_ids().alias("n")).collect()
    assert len(out) == len(rows)
    for r in out:
        want = reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == want and r["n"] == len(want) and r["size"] == 7
        assert r["decoded"] == (r["text"] or "")


def test_clash_and_empty(docs, empty):
    assert bpe.encode(empty, byte_bpe()).count() == 0
    assert dict(bpe.encode(docs, byte_bpe(), column="size").dtypes)["size"] == "binary"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60_000), max_size=300), max_size=8), st.integers(0, 3))
def test_segments_round_trip(docs, reps):
    docs = docs * (1 + 40 * reps)
    tokens = np.array([t for d in docs for t in d], "<u4")
    ids = [None if i == 2 else i for i in range(len(docs))]
    got = rans.unpack(rans.pack(ids, np.array([len(d) for d in docs], "<u4"), tokens))
    assert got[0] == ids and got[1].tolist() == [len(d) for d in docs] and (got[2] == tokens).all()


def test_damage_is_found_and_size_is_near_the_entropy():
    rng = np.random.default_rng(1)
    t = np.minimum(rng.zipf(1.5, 150_000), 50_000).astype("<u4")
    data = rans.pack([0], np.array([len(t)], "<u4"), t)
    _, n = np.unique(t, return_counts=True)
    assert len(data) < 1.15 * -(n * np.log2(n / n.sum())).sum() / 8
    bad = bytearray(data)
    bad[len(data) * 2 // 3] ^= 4
    with pytest.raises(ValueError):
        rans.unpack(bytes(bad))
    with pytest.raises(ValueError):
        rans.unpack(b"no segment")


def test_frequencies_add_up_with_many_rare_ids():
    t = np.concatenate([np.arange(70_000), np.zeros(10, int)]).astype("<u4")
    _, f, scale = rans.frequencies(t)
    assert f.min() >= 1 and int(f.astype(np.int64).sum()) == 1 << scale and scale == rans.SCALE


def test_more_distinct_ids_than_frequencies_add_up_to(monkeypatch):
    monkeypatch.setattr(rans, "SCALE", 8)
    t = np.concatenate([np.arange(3000), np.zeros(5000, int), np.arange(700)]).astype("<u4")
    ids, lengths, got = rans.unpack(rans.pack([7], np.array([len(t)], "<u4"), t))
    assert ids == [7] and lengths.tolist() == [len(t)] and (got == t).all()


def test_token_file(spark, docs, rows, reference, monkeypatch):
    path = new_path(spark, "tokens")
    token_file.write(docs, path, byte_bpe(), 2, shards=3)
    got = token_file.read(spark, path, ids=True).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    got.sort(key=lambda r: r["start"])
    for want, r in zip(order, got, strict=True):
        ids = reference.encode(want[1] or "", add_special_tokens=False).ids + [2]
        raw = np.array(ids, "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["token_ids"])) == (want[0], start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)


def test_token_file_of_nothing_and_of_many_segments(spark, docs, empty, monkeypatch):
    path = new_path(spark, "tokens")
    token_file.write(empty, path, byte_bpe(), 2)
    assert token_file.read(spark, path).count() == 0
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word after word "), 800).alias("text"))
    path = new_path(spark, "tokens")
    token_file.write(big, path, byte_bpe(), 2, shards=1)
    assert spark.read.parquet(path).count() > 1
    out = token_file.read(spark, path).orderBy("doc_id").collect()
    n = out[0]["n_tokens"]
    assert [r["start"] for r in out] == [n * i for i in range(3000)]
