"""Language identification of spans in mixed-language text.

Every letter of a text is scored by the two and three letters that end at it,
for each language that was learned (naive Bayes over hashed n-grams).  A word's
score is the sum of its letters'; languages that hardly use the word's script
are no candidates for it.  Viterbi's algorithm then labels the words with the
best path, where each change of language costs `penalty`.  All steps work on
arrays over many documents at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm._shared import map_arrow, named

#: Hashed n-grams of either length.
BUCKETS = 1 << 15
#: Characters that are worked on at once.
AT_ONCE = 1 << 19
#: Scores (letters x languages) that are held at once.
CELLS = 1 << 23
MAX_LANGUAGES = 400
NEVER = np.float32(-1e4)

#: First and last code points of scripts' main ranges (Unicode).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x139F)],
    "kana": [(0x3040, 0x30FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the lower-case letter or the mark (0: neither), whether it is a mark, and the number of its script (0: other)."""
    top = 0x110000
    lower, mark = np.zeros(top, np.uint32), np.zeros(top, bool)
    for c in range(top):
        x = chr(c)
        if x.isalpha():
            small = x.lower()
            lower[c] = ord(small) if len(small) == 1 else c
        elif unicodedata.category(x)[0] == "M":
            lower[c], mark[c] = c, True
    script = np.zeros(top, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return lower, mark, script


@dataclass
class Grams:
    """Letters of some texts, one after the other with a gap behind each."""

    starts: np.ndarray  #: of the words, in the joined texts
    ends: np.ndarray
    doc: np.ndarray  #: text of each word
    offset: np.ndarray  #: where each text begins
    scored: np.ndarray  #: places that are scored: letters, and the first place after a word
    two: np.ndarray  #: their hashed n-grams
    three: np.ndarray
    script: np.ndarray  #: of each word


def grams(texts: list[str]) -> Grams:
    lower, marks, scripts = _tables()
    joined = "\n".join(texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    offset = np.cumsum(lengths) - lengths
    c = lower[raw]
    mark = marks[raw]
    if mark.any():  # a mark belongs to the letter before it; without one it is nothing
        base = np.maximum.accumulate(np.where(mark, 0, np.arange(len(raw))))
        c[mark & ((c[base] == 0) | mark[base])] = 0
    letter = c > 0
    before = np.concatenate([[False], letter[:-1]])
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(before & ~letter)
    at = np.flatnonzero(letter | before)
    c1 = np.concatenate([[np.uint32(0)], c[:-1]])
    c2 = np.where(before, np.concatenate([np.zeros(min(2, len(c)), np.uint32), c[:-2]]), 0)
    k = np.uint32
    h2 = c[at] * k(0x9E3779B1) + c1[at] * k(0x85EBCA6B)
    h3 = h2 + c2[at].astype(np.uint32) * k(0xC2B2AE35)
    mix = lambda h: ((h ^ (h >> k(15))) * k(0x2C1B3C6D)) >> k(32 - 15)
    return Grams(starts, ends, np.searchsorted(offset, starts, side="right") - 1, offset, at, mix(h2).astype(np.int64), mix(h3).astype(np.int64), scripts[raw[starts]] if len(starts) else np.empty(0, np.uint8))


@dataclass
class Model:
    languages: list[str]
    two: np.ndarray  #: log-probability: n-gram x language
    three: np.ndarray
    candidate: np.ndarray  #: script x language


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= AT_ONCE or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def fit(df: DataFrame, text: str = "text", lang: str = "lang", max_rows_per_language: int = 4000) -> Model:
    """Learns from the rows of df with text and language.

    The n-grams of about max_rows_per_language different texts of each language
    are counted, once each (chosen by a hash of the text; all, if there are no more); what reaches the driver is bounded by
    languages x n-gram buckets.  More than 400 languages are an error.  Rows of
    null text or language teach nothing, nor do empty texts; a very long text is read whole;
    other columns are not read; an empty table gives a model without languages.
    """
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    place = F.xxhash64("text", F.lit(10))
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", place.alias("place")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    share = F.lit(1.0)
    for x in languages:
        if sizes[x] > max_rows_per_language:
            share = F.when(F.col("lang") == x, F.lit(max_rows_per_language / sizes[x])).otherwise(share)
    chosen = rows.filter((F.shiftrightunsigned(place, 11).cast("double") / F.lit(float(1 << 53))) < share).distinct()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 2 * BUCKETS + len(SCRIPTS) + 1
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x in set(langs):
                own = [t for t, y in zip(texts, langs, strict=True) if y == x]
                n = total.setdefault(x, np.zeros(size, np.int64))
                for a, b in _chunks(own):
                    g = grams(own[a:b])
                    n += np.bincount(np.concatenate([g.two, g.three + BUCKETS, g.script.astype(np.int64) + 2 * BUCKETS]), minlength=size)
        for x, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "feature", "n"])

    counts = map_arrow(chosen, count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((2 * BUCKETS + len(SCRIPTS) + 1, len(languages)))
    at = {x: i for i, x in enumerate(languages)}
    table[counts["feature"].to_numpy(), [at[x] for x in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
    log = lambda t: np.log((t + 0.5) / (t.sum(axis=0) + 0.5 * len(t))).astype(np.float32)
    script = table[2 * BUCKETS :]
    return Model(languages, log(table[:BUCKETS]), log(table[BUCKETS : 2 * BUCKETS]), script >= 0.01 * np.maximum(1, script.sum(axis=0)))


def viterbi(score: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """The label of each word on the best path of its text; score: words x labels, doc ascending.

    A word whose best label beats all others by more than two changes cost has that label
    on every best path.  It ends one stretch of words and begins the next, so that
    a text of any length falls into short stretches that are worked on side by side.
    """
    n, k = score.shape
    if not n or k < 2:
        return np.zeros(n, np.int64)
    last_two = np.partition(score, k - 2, axis=1)[:, k - 2 :]
    sure = last_two[:, 1] - last_two[:, 0] > 2 * penalty
    inner = np.flatnonzero(sure[1:-1] & (doc[1:-1] == doc[:-2]) & (doc[1:-1] == doc[2:])) + 1
    twice = np.insert(np.arange(n), inner, inner)
    part = np.zeros(len(twice), np.int64)
    part[inner + 1 + np.arange(len(inner))] = 1  # the second of the two begins a stretch
    part[1:] += doc[twice[1:]] != doc[twice[:-1]]
    own = score[twice]
    fixed = sure[twice]
    own[fixed] = np.where(own[fixed] == own[fixed].max(axis=1, keepdims=True), own[fixed], NEVER)
    out = np.empty(n, np.int64)
    out[twice] = _paths(own, np.cumsum(part), penalty)
    return out


def _paths(score: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """viterbi() of stretches (doc), word after word."""
    n, k = score.shape
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    best = np.empty((n, k), np.float32)
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # texts with more than t words
    last = score[first]
    best[first] = last
    for t in range(1, length[0]):
        m = active[t]
        at = first[:m] + t
        last = last[:m]
        last = score[at] + np.maximum(last, last.max(axis=1, keepdims=True) - penalty)
        last -= last.max(axis=1, keepdims=True)
        best[at] = last
    out = np.empty(n, np.int64)
    for t in range(length[0] - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        top = best[at].argmax(axis=1)
        if t < length[0] - 1 and active[t + 1]:
            a = active[t + 1]
            after = out[at[:a] + 1]
            here = best[at[:a]]
            stay = here[np.arange(a), after] >= here.max(axis=1) - penalty
            top[:a] = np.where(stay, after, top[:a])
        out[at] = top
    return out


def _word_scores(g: Grams, model: Model) -> np.ndarray:
    """Words x languages; letters are worked on in slices, as a text may be long and languages many."""
    first = np.append(np.searchsorted(g.scored, g.starts), len(g.scored))
    each = max(1, CELLS // len(model.languages))
    cuts = np.append(np.flatnonzero(np.diff(first[:-1] // each, prepend=-1)), len(g.starts))
    out = np.empty((len(g.starts), len(model.languages)), np.float32)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = slice(first[a], first[b])
        out[a:b] = np.add.reduceat(model.two[g.two[own]] + model.three[g.three[own]], first[a:b] - first[a], axis=0)
    return out


def label(texts: list[str | None], model: Model, penalty: float) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """For each text its language, the share of its letters in that language, and its spans."""
    langs, shares, spans = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    k = len(model.languages)
    for a, b in _chunks(texts):
        g = grams([t or "" for t in texts[a:b]])
        if not len(g.starts) or not k:
            continue
        score = _word_scores(g, model)
        fits = model.candidate[g.script]
        score = np.where(fits | ~fits.any(axis=1, keepdims=True), score, NEVER)
        labels = viterbi(score - score.max(axis=1, keepdims=True), g.doc, penalty)
        size = g.ends - g.starts
        by = np.zeros((b - a, k), np.int64)
        np.add.at(by, (g.doc, labels), size)
        total = by.sum(axis=1)
        top = by.argmax(axis=1)
        change = np.flatnonzero(np.concatenate([[True], (g.doc[1:] != g.doc[:-1]) | (labels[1:] != labels[:-1])]))
        end = g.ends[np.append(change[1:], len(labels)) - 1]
        for d, s, e, x in zip(g.doc[change].tolist(), (g.starts[change] - g.offset[g.doc[change]]).tolist(), (end - g.offset[g.doc[change]]).tolist(), labels[change].tolist(), strict=True):
            spans[a + d].append({"start": s, "length": e - s, "lang": model.languages[x]})
        for d in np.flatnonzero(total).tolist():
            langs[a + d] = model.languages[top[d]]
            shares[a + d] = by[d, top[d]] / total[d]
    return langs, shares, spans


def identify(df: DataFrame, model: Model, text: str = "text", penalty: float = 6.0, names: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """df with lang_pred, score (share of letters in that language) and spans.

    Spans are runs of words of one language: start and length in code points.
    A text that is null or has no letter is `und` with score 0 and no spans, as
    is every text if nothing was learned.  A word in a script that no language
    uses is judged among all.  Very long texts are labelled whole; repeated rows
    stay; an empty table gives an empty table.  Columns of df named like the new
    ones are replaced; names says how those are called.
    """
    at = df.columns.index(text)
    held = df.sparkSession.sparkContext.broadcast(model)  # bounded: MAX_LANGUAGES x 2 x BUCKETS numbers
    span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                langs, shares, spans = label(b.column(at).to_pylist(), held.value, penalty)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(shares), pa.array(spans, span)], names=[*b.schema.names, "__lang", "__score", "__spans"])

    made = T._parse_datatype_string("__lang string, __score double, __spans array<struct<start:int,length:int,lang:string>>")
    return named(map_arrow(df, run, T.StructType([*df.schema.fields, *made.fields])), **dict(zip(names, made.names, strict=True)))
