"""A small corpus with all that operators have to cope with."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, fp int, keys string, head string, __sha string"


def make(rows: int = 160, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    syllables = {"en": ["the", "ing", "sh", "wh", "th"], "fr": ["é", "eau", "ou", "que", "les"], "ru": ["что", "ов", "ни", "ра"]}
    out = []
    for i in range(rows):
        lang = rng.choice(list(syllables))
        word = lambda: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))  # noqa: B023, E731
        lines = [" ".join(word() for _ in range(rng.randint(1, 30))) + "." for _ in range(rng.randint(1, 6))]
        text = "\n".join(lines)
        kind = i % 16
        if kind == 1 and out:
            text = rng.choice(out)[1]  # an exact copy
        elif kind == 2 and out and (old := rng.choice(out)[1]):
            words = old.split(" ")
            words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        out.append((i, text, lang if i % 5 else None, rng.choice(["a", "b", "ü", None])))
    n = rows
    out += [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, "   \n\t ", "fr", "b"), (n + 3, "12 34 !?", "en", "a"), (n + 4, None, "en", "b"), (n + 5, "x" * 3000, "en", "a"), (n + 6, ("ab c\n" * 4000), "en", "b"), (None, "no id here at all", "en", "a"), (None, None, None, None)]
    out += [(n + 7, "twice the same row of words", "en", "a")] * 2 + [(n + 8, "<|endoftext|> and <|im_end|> \\ <| it's  'll\r\n 日本 語 𐍈 é", "en", "a"), (n + 9, "Shared hot text of many rows", "en", "a")]
    out += [(n + 10 + k, "Shared hot text of many rows", "en", "hot") for k in range(60)]
    return [(*r, len(r[1]) if r[1] is not None else None, 7, "clash", 1, "k", "h", "s") for r in out]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return make()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
