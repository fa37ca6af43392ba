"""The language model and language identification."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from waymark.llm import langid, ngram_lm


def words(text: str | None) -> list[str]:
    small = "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "")
    return [w for w in small.split(" ") if w] + ["</s>"]


def discounts(values) -> list[float]:
    n = Counter(values)
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) if n[k] else 0.5 * min(k, 1) for k in (1, 2, 3)]


class Slow:
    """Kneser-Ney as in the definition."""

    def __init__(self, texts):
        self.c, self.b = Counter(), Counter()
        for t in texts:
            w = words(t)
            self.c.update(w)
            self.b.update(zip(["<s>", *w], w, strict=False))
        self.before, self.total, self.kinds = Counter(w for _, w in self.b), Counter(), Counter()
        self.d, self.low = discounts(self.b.values()), discounts(Counter(w for _, w in self.b).values())
        for (u, _), n in self.b.items():
            self.total[u] += n
            self.kinds[u, min(n, 3)] += 1
        self.gamma = sum(self.low[min(n, 3) - 1] for n in self.before.values()) / len(self.b)

    def p(self, u, w):
        cut = lambda n, d: n - d[min(n, 3) - 1] if n else 0
        low = cut(self.before[w], self.low) / len(self.b) + self.gamma / (len(self.c) + 1)
        if not self.total[u]:
            return low
        return cut(self.b[u, w], self.d) / self.total[u] + sum(self.d[k - 1] * self.kinds[u, k] for k in (1, 2, 3)) / self.total[u] * low


def test_scores(docs, rows, empty):
    train = docs.filter("doc_id % 3 <> 1")
    model = ngram_lm.fit(train, shards=3)
    slow = Slow([r[1] for r in rows if r[0] is not None and r[0] % 3 != 1])
    assert (model.tokens, model.distinct) == (sum(slow.c.values()), len(slow.c))
    got = ngram_lm.score(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words(r["text"])
        assert (r["n_tokens"], r["n_known"]) == (len(w), sum(slow.c[x] > 0 for x in w))
        assert math.isclose(r["score"], sum(math.log10(slow.p(u, x)) for u, x in zip(["<s>", *w], w, strict=False)), rel_tol=1e-9)
        assert math.isclose(r["base_score"], sum(math.log10((slow.c[x] + 1) / (model.tokens + model.distinct + 1)) for x in w), rel_tol=1e-9)
    assert ngram_lm.score(empty, model).count() == 0


def test_probabilities_add_up(docs, rows):
    slow = Slow([r[1] for r in rows])
    for u in ["<s>", *list(slow.c)[:5]]:
        assert math.isclose(sum(slow.p(u, w) for w in [*slow.c, "never seen"]), 1.0, rel_tol=1e-9)


def test_model_of_nothing(docs, empty):
    model = ngram_lm.fit(empty, shards=2)
    r = ngram_lm.score(docs.filter("text = ''"), model).first()
    assert (model.tokens, model.distinct, r["n_tokens"], r["n_known"], r["score"]) == (0, 0, 1, 0, 0.0)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 80))).encode() for _ in range(30)]
    want = ngram_lm.hashed(texts)
    parts = [ngram_lm._hashed_long([t]) for t in texts]
    assert (np.concatenate([p[0] for p in parts]) == want[0]).all() and [int(p[1][0]) for p in parts] == want[1].tolist()
    monkeypatch.setattr(ngram_lm, "AT_ONCE", 128)
    ngram_lm._powers.cache_clear()
    got = ngram_lm.hashed(texts)
    ngram_lm._powers.cache_clear()
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_packed_pieces():
    rng = np.random.default_rng(3)
    u, w, c = np.sort(rng.integers(0, 1 << 48, 500, np.uint64)), rng.integers(0, 1 << 48, 500, np.uint64), rng.integers(1, 1 << 20, 500)
    got = ngram_lm._unpack(ngram_lm._pack(u, w, c))
    assert all((a == b).all() for a, b in zip(got, (u, w, c), strict=True))


def test_pieces_write_frequent_words_in_two_bytes():
    rng = np.random.default_rng(4)
    frequent = np.unique(rng.integers(3, 1 << 63, 1000, np.uint64))
    u, w = (np.where(rng.random(5000) < 0.75, rng.choice(frequent, 5000), rng.integers(3, 1 << 63, 5000, np.uint64)) for _ in "uw")
    u, w, c = ngram_lm._counted(u, w, rng.integers(1, 4, 5000))
    packed = ngram_lm._pack(u, w, c, frequent)
    assert len(packed) < 0.7 * len(ngram_lm._pack(u, w, c)) and len(packed) < 8 * len(u)
    for words in (frequent, frequent[:1], ngram_lm.NONE):
        got = ngram_lm._counted(*ngram_lm._unpack(ngram_lm._pack(u, w, c, words), words))
        assert all((a == b).all() for a, b in zip(got, (u, w, c), strict=True))
        assert [len(x) for x in ngram_lm._unpack(ngram_lm._pack(u[:0], w[:0], c[:0], words), words)] == [0, 0, 0]


def test_frequent_words_change_no_score(docs, empty, monkeypatch):
    of = lambda: sorted((str(r["doc_id"]), r["text"] or "", r["n_known"], r["base_score"], r["score"]) for r in ngram_lm.score(docs, ngram_lm.fit(docs, shards=3)).collect())
    want = of()
    known = ngram_lm._frequent(docs, "text")
    assert (np.diff(known) > 0).all() and ngram_lm.START in known and ngram_lm.END in known and len(known) > 10
    assert len(ngram_lm._frequent(empty, "text")) == 0
    monkeypatch.setattr(ngram_lm, "_frequent", lambda df, text: known[::3])
    some = of()
    monkeypatch.setattr(ngram_lm, "_frequent", lambda df, text: ngram_lm.NONE)
    assert want == some == of()


def test_languages(docs, rows, empty):
    model = langid.fit(docs.filter("doc_id % 3 <> 1"))
    assert model.languages == ["en", "fr", "ru"]
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    true = {r[0]: r[2] for r in rows}
    right = [r["lang_pred"] == true[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 160 and r["doc_id"] % 3 == 1 and r["doc_id"] % 16 > 2 and true[r["doc_id"]]]
    assert np.mean(right) > 0.9
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert not letters or r["spans"]
    assert langid.identify(empty, model).count() == 0
    nothing = langid.identify(docs, langid.fit(empty))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_spans_of_a_mixed_text(docs):
    model = langid.fit(docs)
    text = "the thing whshthe ing sh thewh, 12 ! что нини чтоов рани что. éeau que lesou éque eaules"
    lang, share, spans = langid.label([text, None, "77"], model, 6.0)
    assert [s["lang"] for s in spans[0]] == ["en", "ru", "fr"] and lang[1:] == ["und", "und"] and spans[1] == []
    assert text[spans[0][1]["start"] :][: spans[0][1]["length"]] == "что нини чтоов рани что"


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_is_the_best_path(seed):
    rng = np.random.default_rng(seed)
    lengths = [1, 5, 3, 6, 1]
    score, doc = rng.normal(size=(sum(lengths), 3)).astype(np.float32), np.repeat(np.arange(5), lengths)
    got = langid.viterbi(score, doc, 1.0)
    for d, n in enumerate(lengths):
        s, g = score[doc == d], got[doc == d]
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert abs(value(g.tolist()) - max(map(value, itertools.product(range(3), repeat=n)))) < 1e-4
