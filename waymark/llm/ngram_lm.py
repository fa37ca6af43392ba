"""Interpolated modified Kneser-Ney bigram model.

Counting: tasks turn texts into word hashes, count the pairs of neighbours they
have seen, and send them off in sorted, packed pieces, one for each shard of the
pair's hash, so that no word, however common, meets in one task.  Frequent words
are two bytes in them, all others 63 bits of hash.  A shard's
task merges its pieces and writes two sorted arrays, hashes of pairs and their
counts, to a file in the shared folder.  What words need beside it (how often
they occur, how many different words follow and precede them) is summed by
Spark and written in the same form, dealt to shards by the word's hash.

Scoring: workers map the files into memory and look up whole batches of pairs
and words; the pages they share live in the system's cache.  The score of a pair
is (c(u w) - D(c)) / c(u) + g(u) p(w) with p(w) made in the same way from the
numbers of different words before w, and in the end 1 / (V + 1).
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm._shared import map_arrow, named, new_path, partitions, stored
from waymark.session import local_path

#: Bytes of text that are hashed at once, and pairs that are held before they are sent off.
AT_ONCE, HELD = 1 << 21, 1 << 21
_u = np.uint64
_rng = np.random.default_rng(9)
_CODE = _rng.integers(0, 1 << 63, 256, np.uint64)
_BASE = int(_rng.integers(0, 1 << 62)) * 2 + 1
#: Words are known by 63 bits (two of n different words share them with probability n ** 2 / 2 ** 64: 0.0005 at 100 million); these stand for the start and the end of a text.
BITS = 63
START, END = _u(1), _u(2)
#: What stands for a word that is not among the frequent ones of a packed piece, of which there are at most as many; tasks whose first texts name them.
RARE, DICTIONARY = 0xFFFF, 16
NONE = np.empty(0, np.uint64)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        one = np.full(AT_ONCE, b, np.uint64)
        one[0] = 1
        out.append(np.cumprod(one))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _u(27))) * _u(0x94D049BB133111EB)
    return h ^ (h >> _u(31))


_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_WHITE = re.compile(rb"[\x20\x09-\x0d]")


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in lower case (A-Z), each text followed by END, and the texts' numbers of tokens."""
    if any(len(t) > AT_ONCE // 2 for t in texts):
        return _hashed_long(texts)
    data = b" ".join([*texts, b""])
    a = _SMALL[np.frombuffer(data, np.uint8)]
    word = ~_SPACE[a]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    power, inverse = _powers()
    run = np.concatenate([[_u(0)], np.cumsum(_CODE[a] * power[: len(a)])])
    h = _mix((run[end] - run[start]) * inverse[start]) >> _u(64 - BITS)
    h = np.where(h <= END, h + _u(3), h)
    length = np.array([len(t) + 1 for t in texts], np.int64)
    last = np.searchsorted(start, np.cumsum(length))
    n = np.diff(last, prepend=0) + 1
    return np.insert(h, last, END), n


def _hashed_word(word: bytes) -> np.ndarray:
    """The hash of one word of any length: its sum is carried on from part to part."""
    power, _ = _powers()
    each = AT_ONCE // 4
    total, step = 0, 1
    for at in range(0, len(word), each):
        a = _SMALL[np.frombuffer(word[at : at + each], np.uint8)]
        total += int((_CODE[a] * power[: len(a)]).sum(dtype=np.uint64)) * step
        step = step * pow(_BASE, each, 1 << 64) % (1 << 64)
    h = _mix(np.array([total % (1 << 64)], np.uint64)) >> _u(64 - BITS)
    return np.where(h <= END, h + _u(3), h)


def _hashed_long(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for texts that are hashed in parts, cut at white space; a word longer than a part is hashed by itself."""
    out, n = [], []
    for t in texts:
        at, parts = 0, []
        while at < len(t):
            to = min(len(t), at + AT_ONCE // 4)
            if to < len(t):
                while to > at and not _SPACE[t[to]]:
                    to -= 1
            if to > at:
                parts.append(hashed([t[at:to]])[0][:-1])
            else:  # a word as long as a part, or white space
                found = _WHITE.search(t, at)
                to = found.start() if found else len(t)
                if to > at:
                    parts.append(_hashed_word(t[at:to]))
                else:
                    to += 1
            at = to
        out += [*parts, np.array([END])]
        n.append(sum(map(len, parts)) + 1)
    return np.concatenate(out).astype(np.uint64), np.array(n)


def pairs(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The word before each token; START for a text's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[(np.cumsum(n) - n)] = START
    return before


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(u * _u(0x9E3779B97F4A7C15) + _mix(w))


def _chunks(column: pa.Array) -> Iterator[list[bytes]]:
    held, n = [], 0
    for start in range(0, len(column), 1000):
        for t in column.slice(start, 1000).cast(pa.binary()).to_pylist():
            if held and n + len(t or b"") + 1 > AT_ONCE // 2:
                yield held
                held, n = [], 0
            held.append(t or b"")
            n += len(held[-1]) + 1
    if held:
        yield held


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of values by key, keys ascending."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _counted(u: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, u))
    u, w, c = u[order], w[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])) if len(u) else np.empty(0, np.int64)
    return u[first], w[first], np.add.reduceat(c, first) if len(first) else c[:0]


def _codes(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Places of words among the frequent ones, RARE for all others."""
    if not len(frequent):
        return np.full(len(words), RARE, "<u2")
    at = np.searchsorted(frequent, words)
    at[at == len(frequent)] = 0
    return np.where(frequent[at] == words, at, RARE).astype("<u2")


def _planes(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)


def _pack(u: np.ndarray, w: np.ndarray, c: np.ndarray, frequent: np.ndarray = NONE) -> bytes:
    """Pairs in order of u and w: those whose u is frequent, then the others.

    Frequent words are two bytes; steps of u and counts shrink well; a rare w is without any order.
    """
    cu = _codes(u, frequent)
    order = np.argsort(cu == RARE, kind="stable")  # codes go by hash, so they ascend
    cu, u, w, c = cu[order], u[order], w[order], c[order]
    cw = _codes(w, frequent)
    rare_u, rare_w = u[cu == RARE], w[cw == RARE]
    planes = _planes(np.diff(cu, prepend=cu.dtype.type(0)), cw, c.astype("<u4"), np.diff(rare_u, prepend=_u(0)).astype("<u8"))
    return np.array([len(u), len(rare_w)], "<u8").tobytes() + rare_w.astype("<u8").tobytes() + zlib.compress(planes, 1)


def _unpack(data: bytes, frequent: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(data, "<u8", 2).tolist()
    planes = np.frombuffer(zlib.decompress(memoryview(data)[16 + 8 * m :]), np.uint8)
    at = 0

    def plane(kind: str, n: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize
        at += size * n
        return np.ascontiguousarray(planes[at - size * n : at].reshape(size, n).T).view(kind).reshape(-1)

    def known(codes: np.ndarray, rare: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[codes != RARE] = frequent[codes[codes != RARE]]
        out[codes == RARE] = rare
        return out

    cu = np.cumsum(plane("<u2", n), dtype=np.uint16)
    cw, c = plane("<u2", n), plane("<u4", n).astype(np.int64)
    u = known(cu, np.cumsum(plane("<u8", int((cu == RARE).sum())), dtype=np.uint64))
    return u, known(cw, np.frombuffer(data, "<u8", m, 16)), c


def _frequent(df: DataFrame, text: str) -> np.ndarray:
    """Words, ascending, that pieces write as two bytes: the most frequent ones of the first texts of up to DICTIONARY tasks.

    No count is made from them: with other words, or none, pieces are longer and
    hold the same pairs.  What comes to the driver is bounded by the number of tasks.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, left = [], AT_ONCE
        for batch in batches:
            for texts in _chunks(batch.column(0)):
                if left > 0:
                    seen.append(hashed(texts)[0])
                    left -= sum(map(len, texts)) + len(texts)
        if seen:
            key, n = np.unique(np.concatenate(seen), return_counts=True)
            top = np.argsort(-n, kind="stable")[: min(RARE, int((n > 1).sum()))]
            yield pa.RecordBatch.from_arrays([pa.array([key[top].astype("<u8").tobytes()], pa.binary()), pa.array([n[top].astype("<u4").tobytes()], pa.binary())], names=["words", "n"])

    at = F.col("__at")
    first = df.select(text, F.monotonically_increasing_id().alias("__at")).filter((F.shiftright(at, 33) < DICTIONARY) & (at.bitwiseAND((1 << 33) - 1) < 512))
    rows = map_arrow(first.select(text), run, "words binary, n binary").collect()
    if not rows:
        return NONE
    key, n = _summed(*(np.concatenate([np.frombuffer(r[name], kind) for r in rows]) for name, kind in (("words", "<u8"), ("n", "<u4"))))
    # START begins each text, but is no word of it
    return np.sort(np.append(key[np.argsort(-n.astype(np.int64), kind="stable")[: RARE - 1]], START))


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Writes arrays one after the other; a repeated task puts the same file in the place of the first."""
    os.makedirs(folder, exist_ok=True)
    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(np.array([len(arrays[0])], "<i8").tobytes())
        for a in arrays:
            f.write(a.tobytes())
    os.replace(temporary, f"{folder}/{name}")


@dataclass
class Model:
    folder: str
    pair_shards: int
    word_shards: int
    pair_files: frozenset[int]  #: shards that have got pairs, and so a file
    word_files: frozenset[int]
    tokens: int  #: N
    distinct: int  #: V
    discounts: tuple[float, float, float]  #: of pairs
    lower: tuple[float, float, float]  #: of words before a word
    lower_total: int
    lower_gamma: float


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many n-grams occur once to four times."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    of = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a else 0.5 * min(k, 1)
    return of(1, n1, n2), of(2, n2, n3), of(3, n3, n4)


def fit(df: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    """Counts all rows of df and writes the model.

    Null and empty texts are an end alone; repeated rows count as often as they
    stand there; texts and words of any length are read whole; other columns are
    not read; an empty table gives an empty model.
    """
    spark = df.sparkSession
    s = shards or partitions(df)
    folder = local_path(new_path(spark, "ngrams"))  # for memory-mapping
    frequent = _frequent(df, text)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            u, w, c = _counted(*parts)
            parts.clear()
            shard = (pair_hash(u, w) % _u(s)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(s + 1))
            for k in range(s):
                at = order[ends[k] : ends[k + 1]]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(u[at], w[at], c[at], frequent)], pa.binary())], names=["shard", "piece"])

        for batch in batches:
            for texts in _chunks(batch.column(0)):
                w, n = hashed(texts)
                held.append(_counted(pairs(w, n), w, np.ones(len(w), np.int64)))
                size += len(held[-1][0])
                if size >= HELD:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(shard: int, pieces: list[bytes]) -> Iterator[pa.RecordBatch]:
            parts = [_unpack(p, frequent) for p in pieces]
            pieces.clear()
            u, w, c = _counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            parts.clear()
            h = pair_hash(u, w)
            order = np.argsort(h)
            _save(folder, f"pairs-{shard}", h[order].astype("<u8"), np.minimum(c[order], 0xFFFFFFFF).astype("<u4"))
            ones, twos, more = (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64)
            after = _summed(u, c, ones, twos, more)
            before = _summed(w, c, np.ones(len(w), np.int64))
            for kind, key, *values in ((0, *after), (1, *before)):
                zero = np.zeros(len(key), np.int64)
                values = [*values, *[zero] * (4 - len(values))]
                for at in range(0, len(key), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[at : at + (1 << 16)]), kind, np.int8)), pa.array(key[at : at + (1 << 16)].astype(np.int64)), *(pa.array(v[at : at + (1 << 16)]) for v in values)], names=["kind", "key", "a", "b", "c", "d"])
            n = np.bincount(np.minimum(c, 5), minlength=6)[1:5]  # counts of counts come as rows of a third kind, the shard's file as one of a fourth
            yield pa.RecordBatch.from_arrays([pa.array([2] * 4, pa.int8()), pa.array([1, 2, 3, 4], pa.int64()), pa.array(n.astype(np.int64)), *[pa.array([0] * 4, pa.int64())] * 3], names=["kind", "key", "a", "b", "c", "d"])
            yield pa.RecordBatch.from_arrays([pa.array([3], pa.int8()), pa.array([shard], pa.int64()), *[pa.array([1], pa.int64())] * 4], names=["kind", "key", "a", "b", "c", "d"])

        now, pieces = None, []
        for batch in batches:
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != now and pieces:
                    yield from close(now, pieces)
                    pieces = []
                now = k
                pieces.append(p.as_py())
        if pieces:
            yield from close(now, pieces)

    counted = map_arrow(df.select(text), count, "shard int, piece binary")
    merged = map_arrow(counted.repartition(s, "shard").sortWithinPartitions("shard"), merge, "kind byte, key long, a long, b long, c long, d long")
    by = merged.groupBy("kind", "key").agg(*(F.sum(x).alias(x) for x in "abcd"))
    table = stored(by, "words")
    # a word's occurrences, what follows it, and how many different words precede it
    n_c = lambda k: F.sum(F.when((F.col("kind") == 1) & (F.col("b") == k), 1).otherwise(0))
    sums = table.agg(F.sum(F.when(F.col("kind") == 1, F.col("a"))), F.count(F.when(F.col("kind") == 1, 1)), F.sum(F.when(F.col("kind") == 1, F.col("b"))), *(n_c(k) for k in (1, 2, 3, 4)), *(F.sum(F.when((F.col("kind") == 2) & (F.col("key") == k), F.col("a"))) for k in (1, 2, 3, 4))).first()
    sums = [x or 0 for x in sums]
    word_shards = s

    pair_files = frozenset(r["key"] for r in table.filter("kind = 3").select("key").collect())  # numbers of shards

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []

        def close(shard: int, rows: list[np.ndarray]) -> None:
            r = np.concatenate(rows)  # kind, key, a, b, c, d
            key, at = np.unique(r[:, 1], return_inverse=True)
            out = np.zeros((6, len(key)), np.int64)  # c(w), N(. w), c(w .), N1(w .), N2(w .), N3(w .)
            before, after = r[:, 0] == 1, r[:, 0] == 0
            out[0, at[before]], out[1, at[before]] = r[before, 2], r[before, 3]
            for i in range(4):
                out[2 + i, at[after]] = r[after, 2 + i]
            _save(folder, f"words-{shard}", key.astype("<u8"), *out.astype("<i8"))
            done.append(shard)

        now, rows = None, []
        for batch in batches:
            a = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(7)], axis=1)
            for k in np.unique(a[:, 0]).tolist():
                if k != now and rows:
                    close(now, rows)
                    rows = []
                now = k
                rows.append(a[a[:, 0] == k, 1:])
        if rows:
            close(now, rows)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], names=["shard"])

    dealt = table.filter("kind < 2").withColumn("shard", F.pmod(F.col("key"), F.lit(word_shards)).cast("int")).select("shard", "kind", "key", "a", "b", "c", "d")
    word_files = frozenset(r["shard"] for r in map_arrow(dealt.repartition(word_shards, "shard").sortWithinPartitions("shard"), words, "shard int").collect())
    d, low = discounts(dict(zip((1, 2, 3, 4), sums[7:], strict=True))), discounts(dict(zip((1, 2, 3, 4), sums[3:7], strict=True)))
    n1, n2 = sums[3], sums[4]
    gamma = (low[0] * n1 + low[1] * n2 + low[2] * (sums[1] - n1 - n2)) / sums[2] if sums[2] else 1.0
    return Model(folder, s, word_shards, pair_files, word_files, sums[0], sums[1], d, low, sums[2], gamma)


@lru_cache(maxsize=4096)
def _mapped(path: str, *kinds: str) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory."""
    n = int(np.fromfile(path, "<i8", 1)[0])
    at, out = 8, []
    for k in kinds:
        out.append(np.memmap(path, k, "r", at, (n,)) if n else np.empty(0, k))
        at += n * np.dtype(k).itemsize
    return out


def _look(folder: str, name: str, files: frozenset[int], of: np.ndarray, keys: np.ndarray, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """Values of keys (0 if there is none); keys are sorted first, so that a search goes through a file once.

    A file that was written and can't be read now is an error.
    """
    order = np.lexsort((keys, of))
    own, of = keys[order], of[order]
    out = [np.zeros(len(keys), np.int64) for _ in kinds[1:]]
    here = np.unique(of)
    ends = np.append(np.searchsorted(of, here), len(of)).tolist()
    for k, a, b in zip(here.tolist(), ends, ends[1:], strict=False):
        if k not in files:
            continue
        have, *values = _mapped(f"{folder}/{name}-{k}", *kinds)
        if not len(have):
            continue
        at = np.searchsorted(have, own[a:b])
        at[at == len(have)] = 0
        hit = have[at] == own[a:b]
        for o, v in zip(out, values, strict=True):
            o[order[a:b][hit]] = v[at[hit]]
    return out


def score_tokens(m: Model, tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability of each token, its count in training, and its base score."""
    seen, at = np.unique(np.concatenate([tokens, [START]]), return_inverse=True)
    c, before, follow, n1, n2, n3 = _look(m.folder, "words", m.word_files, (seen % _u(m.word_shards)).astype(np.int64), seen, ("<u8", *["<i8"] * 6))
    w = at[:-1]
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[np.cumsum(n) - n] = at[-1]
    h = pair_hash(seen[u], seen[w])
    (both,) = _look(m.folder, "pairs", m.pair_files, (h % _u(m.pair_shards)).astype(np.int64), h, ("<u8", "<u4"))
    take = lambda x, d: np.where(x > 2, d[2], np.where(x == 2, d[1], np.where(x == 1, d[0], 0.0)))
    flat = 1.0 / (m.distinct + 1)
    low = (before - take(before, m.lower)) / m.lower_total + m.lower_gamma * flat if m.lower_total else np.full(len(seen), flat)
    gamma = np.where(follow > 0, (m.discounts[0] * n1 + m.discounts[1] * n2 + m.discounts[2] * n3) / np.maximum(follow, 1), 1.0)
    p = np.where(follow[u] > 0, (both - take(both, m.discounts)) / np.maximum(follow[u], 1), 0.0) + gamma[u] * low[w]
    base = np.log10((c + 1) / (m.tokens + m.distinct + 1))
    return np.log10(p), c[w], base[w]


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with n_tokens, n_known, base_score, score and perplexity of each whole text.

    Null and empty texts are an end alone; very long ones are read whole;
    repeated rows stay; an empty table gives an empty table.  Columns of df
    named like the new ones are replaced.
    """
    made = T._parse_datatype_string("__n_tokens long, __n_known long, __base_score double, __score double, __perplexity double")
    at = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for texts in _chunks(batch.column(at)):
                tokens, n = hashed(texts)
                p, c, base = score_tokens(model, tokens, n)
                first = np.cumsum(n) - n
                total = np.add.reduceat(p, first)
                out.append((n.astype(np.int64), np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(base, first), total, 10.0 ** np.minimum(300.0, -total / n)))
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.concatenate(x)) for x in zip(*out, strict=True))], names=[*batch.schema.names, *made.names])

    return named(map_arrow(df, run, T.StructType([*df.schema.fields, *made.fields])), **{c.removeprefix("__"): c for c in made.names})
