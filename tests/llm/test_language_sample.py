"""The bounded training sample is of different texts."""

from __future__ import annotations

import numpy as np

from waymark.llm import langid


def test_few_texts_in_many_rows_are_learned(spark):
    rows = [("привет мир", "ru"), ("добрый день", "ru")] * 300 + [("hello world", "en")] * 300 + [("good day", "en")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3), max_rows_per_language=2)
    once = langid.fit(spark.createDataFrame(sorted(set(rows)), "text string, lang string"))
    assert model.languages == once.languages == ["en", "ru"]
    assert np.array_equal(model.two, once.two) and np.array_equal(model.three, once.three) and np.array_equal(model.candidate, once.candidate)
    assert langid.label(["мир", "day"], model, 6.0)[0] == ["ru", "en"]


def test_marks_are_no_letters_and_letters_of_any_plane_are():
    g = langid.grams(["́", "́áb ́́ c", "\U00032010\U00032011", "1́ é"])
    assert list(zip(g.doc.tolist(), (g.starts - g.offset[g.doc]).tolist(), (g.ends - g.starts).tolist(), strict=True)) == [(1, 1, 3), (1, 8, 1), (2, 0, 2), (3, 3, 2)]


def test_long_texts_fall_into_stretches():
    rng = np.random.default_rng(3)
    for scale in (1, 4, 20):
        doc = np.sort(rng.integers(0, 5, 400))
        score = (rng.normal(size=(400, 4)) * scale).astype(np.float32)
        score -= score.max(axis=1, keepdims=True)
        assert (langid.viterbi(score, doc, 6.0) == langid._paths(score, doc, 6.0)).all()


def test_slices_of_words_give_the_same_scores(monkeypatch):
    rng = np.random.default_rng(5)
    model = langid.Model(["a", "b"], *(rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32) for _ in range(2)), np.ones((len(langid.SCRIPTS) + 1, 2), bool))
    g = langid.grams(["some words of several lengths, and onelongwordofmanyletters", "é à"])
    whole = langid._word_scores(g, model)
    monkeypatch.setattr(langid, "CELLS", 14)
    assert np.allclose(whole, langid._word_scores(g, model), atol=1e-4)
