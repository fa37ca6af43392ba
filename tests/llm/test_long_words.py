"""A word is one word, however long it is."""

from __future__ import annotations

import os
import random

import pytest

from waymark.llm import ngram_lm


@pytest.mark.parametrize("size", [1_100_000, 3_000_000])
def test_a_long_word_is_one_word(size):
    h, n = ngram_lm.hashed([b"one " + b"a" * size + b" two", b"A" * size, b" " * size])
    short, _ = ngram_lm.hashed([b"one two"])
    assert n.tolist() == [4, 2, 1]
    assert h[[0, 2, 3]].tolist() == short.tolist() and h[1] == h[4]


def test_words_hash_alike_at_every_size_of_parts(monkeypatch):
    rng = random.Random(2)
    texts = [b" ".join(bytes(rng.choices(b"abXY", k=rng.choice([1, 5, 31, 32, 33, 64, 200]))) for _ in range(30)) for _ in range(20)]
    want = ngram_lm.hashed(texts)
    monkeypatch.setattr(ngram_lm, "AT_ONCE", 128)
    ngram_lm._powers.cache_clear()
    got = ngram_lm.hashed(texts)
    ngram_lm._powers.cache_clear()
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_a_lost_file_is_an_error(spark):
    df = spark.createDataFrame([(1, "some words and some more")], "doc_id long, text string")
    model = ngram_lm.fit(df, shards=2)
    texts = ngram_lm.hashed([b"some words and none"])
    want = ngram_lm.score_tokens(model, *texts)
    assert len(model.pair_files) + len(model.word_files) > 1 and want[1].tolist() == [2, 1, 1, 0, 1]
    for name, files in (("pairs", model.pair_files), ("words", model.word_files)):
        for k in files:
            os.remove(f"{model.folder}/{name}-{k}")
    ngram_lm._mapped.cache_clear()
    with pytest.raises(FileNotFoundError):
        ngram_lm.score_tokens(model, *texts)
