"""Byte-pair encoding by forced-boundary splitting, and decoding.

A pair of bytes that stands inside no token of the vocabulary can never end up
within one token, so a text may be cut there.  Of these certain cuts the
encoder takes those where the pre-tokenizer's own split is the same for the
parts as for the whole text.  These are, first, the pairs whose right byte is
white space: no pre-token goes from another character on to white space, and a
run of white space that is cut gives the same merges on either side.  Second,
an ASCII letter before a punctuation mark other than the apostrophe: a run of
letters always ends there.  The fragments are encoded one by one, each distinct
one once, and their ids are concatenated.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm._shared import map_arrow, named

#: Distinct fragments that a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Bytes of text whose fragments are worked on at once.
AT_ONCE = 1 << 20

LETTERS = [b for b in range(128) if chr(b).isalpha()]
#: ASCII punctuation without the apostrophe, which starts contractions.
MARKS = [b for b in range(33, 127) if not chr(b).isalnum() and b != 0x27]
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encodes as the tokenizers library does with the same file and add_special_tokens=False, truncation and padding unused."""

    def __init__(self, path: str, remembered: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        of_char = byte_of_char()
        self.added = {x["content"]: x["id"] for x in parts["added_tokens"]}
        self._added_bytes = [x.encode() for x in self.added]
        self._joined = not any(" " in x for x in self.added)
        self.plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in parts["added_tokens"])
        size = max([*parts["model"]["vocab"].values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        inside = np.zeros((256, 256), bool)
        for token, i in parts["model"]["vocab"].items():
            if token in self.added:
                continue
            own = bytes(of_char[c] for c in token)
            self.bytes_of[i] = own
            inside[list(own[:-1]), list(own[1:])] = True
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        #: Pairs of bytes that stand inside no token.
        self.forced = ~inside
        cut = np.zeros((256, 256), bool)
        cut[:, list(WHITE)] = self.forced[:, list(WHITE)]
        mixed = np.ix_(LETTERS, MARKS)
        cut[mixed] = self.forced[mixed]
        self._cut = cut.reshape(-1)
        self._bytes = np.array([len(b) for b in self.bytes_of])
        rng = np.random.default_rng(7)
        self._code = rng.integers(0, 1 << 63, 256, np.uint64)
        base, self._power, self._inverse = int(rng.integers(0, 1 << 62)) * 2 + 1, None, None
        self._powers = base, pow(base, -1, 1 << 64)
        self._forget()

    def _forget(self) -> None:
        #: Place of each fragment that was encoded in _from and _n, which say where its ids are in _pool.
        self._known: dict[bytes, int] = {}
        self._from, self._n, self._pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def fragments(self, a: np.ndarray, also: np.ndarray = ()) -> np.ndarray:
        """Where the fragments of a text (its bytes, not empty) begin: at the certain cuts, and at further places."""
        pairs = a[:-1].astype(np.uint16) << 8
        pairs |= a[1:]
        begins = np.ones(len(a), bool)
        begins[1:] = self._cut[pairs] if self.plain else False
        if len(also):
            begins[also] = True
        return np.flatnonzero(begins)

    def encode(self, texts: Iterable[bytes | None], at_once: int | None = None) -> Iterator[bytes]:
        """For each UTF-8 text (None: empty) its ids as little-endian unsigned 32-bit integers."""
        held: list[bytes] = []
        n = 0
        for text in texts:
            held.append(text or b"")
            n += len(held[-1])
            if n >= (at_once or AT_ONCE):
                yield from self._encoded(held)
                held, n = [], 0
        yield from self._encoded(held)

    def _encoded(self, texts: list[bytes]) -> list[bytes]:
        data = b"".join(texts)
        if not data:
            return [b""] * len(texts)
        a = np.frombuffer(data, np.uint8)
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[lengths > 0]
        at = self.fragments(a, starts)
        if any(x in data for x in self._added_bytes):
            added = self._added_at(texts, (ends - lengths).tolist())
            if len(added):
                at = self.fragments(a, np.concatenate([starts, added[added < len(data)]]))
                at = at[~_within(at, added)]
        size = np.diff(at, append=len(data))
        which, first = self._distinct(a, at, size)
        place = self._places(data, at[first], size[first])
        place = place[which]
        n = self._n[place]
        total = np.cumsum(n)
        ids = self._pool[np.arange(total[-1], dtype=np.int32) + np.repeat((self._from[place] - (total - n)).astype(np.int32), n)].astype("<u4").tobytes()
        last = np.append(0, total)[np.searchsorted(at, ends)]
        if len(self._known) > (self.remembered or REMEMBERED):
            self._forget()
        return [ids[4 * i : 4 * j] for i, j in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]

    def _added_at(self, texts: list[bytes], start: list[int]) -> np.ndarray:
        """Starts and ends of the added tokens in the joined texts."""
        some = re.compile(b"|".join(map(re.escape, sorted(self._added_bytes, key=len, reverse=True))))
        found = [(s + m.start(), s + m.end()) for s, t in zip(start, texts, strict=True) for m in some.finditer(t)]
        return np.array(found, np.int64).reshape(-1, 2)

    def _distinct(self, a: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the distinct fragments each one is, and where each of those stands first. Fragments meet by a hash and are then compared."""
        n = len(a)
        if self._power is None or len(self._power) < n:
            powers = []
            for base in self._powers:
                one = np.full(max(n, AT_ONCE), base, np.uint64)
                one[0] = 1
                powers.append(np.cumprod(one, out=one))
            self._power, self._inverse = powers
            self._run = np.zeros(len(self._power) + 1, np.uint64)
        run = self._run[: n + 1]
        np.take(self._code, a, out=run[1:])
        run[1:] *= self._power[:n]
        np.cumsum(run, out=run)
        h = (run[at + size] - run[at]) * self._inverse[at]
        h ^= h >> np.uint64(29)
        h = (h << np.uint64(6)) ^ size.astype(np.uint64)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        if (size[first][which] != size).any() or (a[np.arange(n, dtype=np.int32) + np.repeat((at[first][which] - at).astype(np.int32), size)] != a).any():
            seen: dict[bytes, int] = {}
            which = np.array([seen.setdefault(a[s : s + n].tobytes(), len(seen)) for s, n in zip(at.tolist(), size.tolist(), strict=True)])
            first = np.unique(which, return_index=True)[1]
        return which, first

    def _places(self, data: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of distinct fragments; those not known yet are encoded."""
        own = [data[s : s + n] for s, n in zip(at.tolist(), size.tolist(), strict=True)]
        known = self._known
        place = list(map(known.get, own))
        new = [f for f, p in zip(own, place, strict=True) if p is None]
        if new:
            new, ids, n = self._of_fragments(new)
            known |= zip(new, range(len(known), len(known) + len(new)), strict=True)
            self._from = np.concatenate([self._from, len(self._pool) + np.cumsum(n) - n])
            self._n = np.concatenate([self._n, n])
            self._pool = np.concatenate([self._pool, ids])
            place = list(map(known.__getitem__, own))
        return np.array(place)

    def _of_fragments(self, new: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The fragments in another order, their ids one after the other, and how many each has.

        Fragments that may stand behind one another (their joint is a certain
        cut) are encoded in one call and told apart by their lengths in bytes.
        """
        joint = self._cut.reshape(256, 256)[:, 0x20].tolist() if self._joined else [False] * 256
        joined = [f for f in new if f[0] == 0x20 and joint[f[-1]]]
        apart = [f for f in new if f[0] != 0x20 or not joint[f[-1]]]
        encode = self.tokenizer.encode_batch_fast
        parts = [e.ids for e in encode([f.decode() for f in apart], add_special_tokens=False)]
        n = [np.array([len(p) for p in parts], np.int64)]
        ids = [np.fromiter((i for p in parts for i in p), np.uint32, int(n[0].sum()))]
        if joined:
            ids.append(np.asarray(encode([b"".join(joined).decode()], add_special_tokens=False)[0].ids, np.uint32))
            ends = np.searchsorted(np.cumsum(self._bytes[ids[1]]), np.cumsum([len(f) for f in joined])) + 1
            n.append(np.diff(ends, prepend=0))
        return apart + joined, np.concatenate(ids), np.concatenate(n)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.decode("utf-8", "replace").encode()


def _within(at: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which places lie inside one of the spans, behind its start."""
    k = np.searchsorted(spans[:, 0], at, side="left") - 1
    return (k >= 0) & (at < spans[np.maximum(k, 0), 1])


@lru_cache(maxsize=2)
def bpe(path: str, remembered: int | None = None) -> ForcedBoundaryBPE:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on every core
    return ForcedBoundaryBPE(path, remembered)


def _mapped(df: DataFrame, source: str, columns: dict[str, T.DataType], path: str, f) -> DataFrame:
    """df with columns that f(coder, values of source) gives as lists of bytes, in pieces of a batch."""
    at = df.columns.index(source)
    made = [T.StructField(f"__made{i}", kind) for i, kind in enumerate(columns.values())]
    arrow = [pa.string() if isinstance(kind, T.StringType) else pa.binary() for kind in columns.values()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                new = f(coder, b.column(at).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.binary()).cast(k) for x, k in zip(new, arrow, strict=True))], names=[*b.schema.names, *(m.name for m in made)])

    out = map_arrow(df, run, T.StructType([*df.schema.fields, *made]))
    return named(out, **{c: m.name for c, m in zip(columns, made, strict=True)})


def encode(df: DataFrame, path: str, text: str = "text", column: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """df with a binary column of token ids (little-endian unsigned 32-bit) and, if it has a name, one of the text they decode to.

    Null and empty texts get no ids (an empty value); very long texts are read
    whole; repeated rows stay; an empty table gives an empty table.  All other
    columns are kept; a column already named like a new one is replaced.
    """

    def both(coder: ForcedBoundaryBPE, texts: list[bytes | None]) -> list[list[bytes]]:
        ids = list(coder.encode(texts))
        return [ids, [coder.decode(x) for x in ids]] if decoded else [ids]

    return _mapped(df, text, {column: T.BinaryType()} | ({decoded: T.StringType()} if decoded else {}), path, both)


def decode(df: DataFrame, path: str, ids: str = "token_ids", column: str = "decoded") -> DataFrame:
    """df with the text of each row's ids; null ids give an empty text.  Other columns as for encode()."""
    return _mapped(df, ids, {column: T.StringType()}, path, lambda coder, rows: [[coder.decode(x or b"") for x in rows]])


def n_ids(ids: str = "token_ids"):
    return (F.octet_length(ids) / 4).cast("long")
