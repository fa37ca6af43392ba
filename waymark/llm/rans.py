"""Static range asymmetric numeral system over token ids.

A segment holds whole documents and one frequency table that all its blocks
share.  A block is BLOCK tokens dealt over LANES interleaved coders which write
to one stream of 32-bit words.  Each checkpoint (CHECK steps apart) has the
lanes' states and the place in the stream, so that every stretch between two
checkpoints can be decoded by itself; the decoder here runs all stretches of a
segment side by side.  A block's crc32 is over its decoded ids.

Frequencies add up to 2 ** SCALE, or more for a segment of more distinct ids than
half of that.

Layout of a segment (little-endian): magic "WTS1", then unsigned 32-bit
numbers: scale bits, lanes, steps of a full block, steps between checkpoints,
documents, then 64-bit: tokens; then parts, each a 32-bit length and bytes:
documents' ids (zlib, 64-bit), which ids are null (zlib, bytes), documents'
lengths (zlib, 32-bit), the table's symbols and their frequencies (zlib,
32-bit each); then the blocks: lengths, checksums, words (32-bit each),
checkpoint states (64-bit), checkpoint places (32-bit), the streams.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"WTS1"
SCALE, LANES, STEPS, CHECK = 20, 32, 1024, 512
BLOCK = LANES * STEPS
#: Ids below this are counted and looked up in arrays of that size.
WIDE = 1 << 22
LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_WORD = np.uint64(0xFFFFFFFF)


def frequencies(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct ids, frequencies of at least 1, and the power of two that they add up to."""
    if len(tokens) and tokens.max() < WIDE:
        counts = np.bincount(tokens)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(tokens, return_counts=True)
    scale = max(SCALE, len(symbols).bit_length() + 1)
    if not len(symbols):
        return symbols.astype("<u4"), counts.astype("<u4"), scale
    total = 1 << scale
    freq = np.maximum(1, counts * total // counts.sum())
    over = int(freq.sum()) - total
    if over < 0:
        freq[counts.argmax()] -= over
    while over > 0:  # the largest give way
        top = np.argsort(-freq, kind="stable")[: max(1, min(over, (freq > 1).sum()))]
        take = np.minimum(freq[top] - 1, -(-over // len(top)))
        take = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
        freq[top] -= take
        over -= int(take.sum())
    return symbols.astype("<u4"), freq.astype("<u4"), scale


def _encode(sym: np.ndarray, freq: np.ndarray, start: np.ndarray, scale: int):
    """sym: blocks x steps x lanes, places in the table.  Gives words of each block, states and places at the checkpoints."""
    blocks, steps, lanes = sym.shape
    x = np.full((blocks, lanes), LOW)
    wrote, words = [None] * steps, [None] * steps
    checks = -(-steps // CHECK)
    states = np.empty((blocks, checks, lanes), np.uint64)
    full = freq << np.uint64(31 - scale + 32)
    shift = np.uint64(scale)
    for t in range(steps - 1, -1, -1):
        s = sym[:, t, :]
        f = freq[s]
        m = x >= full[s]
        words[t] = (x[m] & _WORD).astype("<u4")
        wrote[t] = m.sum(axis=1)
        x = np.where(m, x >> _32, x)
        q = x // f
        x = (q << shift) + start[s] + (x - q * f)
        if t % CHECK == 0:
            states[:, t // CHECK] = x
    counts = np.array(wrote)  # steps x blocks
    owner = np.repeat(np.tile(np.arange(blocks, dtype=np.int32), steps), counts.reshape(-1))
    stream = np.concatenate(words)[np.argsort(owner, kind="stable")]
    before = np.vstack([np.zeros((1, blocks), np.int64), counts.cumsum(axis=0)])
    return stream, before[-1], states, before[:-1:CHECK][:checks].T


def _decode(states: np.ndarray, at: np.ndarray, steps: int, stream: np.ndarray, table, scale: int) -> np.ndarray:
    """states: stretches x lanes; at: places of the stretches in the stream.  Gives stretches x steps x lanes."""
    of_slot, freq, start = table
    mask, shift = np.uint64((1 << scale) - 1), np.uint64(scale)
    x, at = states.copy(), at.astype(np.int64).copy()
    out = np.empty((len(x), steps, x.shape[1]), np.uint32)
    for t in range(steps):
        slot = x & mask
        s = of_slot[slot.astype(np.int64)]
        out[:, t] = s
        x = freq[s] * (x >> shift) + slot - start[s]
        m = x < LOW
        n = np.cumsum(m, axis=1)
        places = (at[:, None] + n - 1)[m]
        if len(places) and places[-1] >= len(stream):
            raise ValueError("the stream ends too soon")
        x[m] = (x[m] << _32) | stream[places].astype(np.uint64)
        at += n[:, -1]
    return out


def _part(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


def pack(doc_ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """A segment of documents whose ids stand one after the other in tokens."""
    symbols, freq32, scale = frequencies(tokens)
    freq = freq32.astype(np.uint64)
    start = np.cumsum(freq) - freq
    n = len(tokens)
    if n and tokens.max() < WIDE:
        of = np.zeros(int(tokens.max()) + 1, np.int32)
        of[symbols] = np.arange(len(symbols))
        place = of[tokens]
    else:
        place = np.searchsorted(symbols, tokens)
    whole, rest = divmod(n, BLOCK)
    parts = []
    if whole:
        parts.append(_encode(place[: whole * BLOCK].reshape(whole, STEPS, LANES), freq, start, scale))
    if rest:
        steps = -(-rest // LANES)
        last = np.full(steps * LANES, int(freq.argmax()), np.int64)
        last[:rest] = place[whole * BLOCK :]
        parts.append(_encode(last.reshape(1, steps, LANES), freq, start, scale))
    sizes = np.full(whole + bool(rest), BLOCK, "<u4")
    if rest:
        sizes[-1] = rest
    raw = tokens.astype("<u4")
    sums = np.array([zlib.crc32(raw[i : i + BLOCK].tobytes()) for i in range(0, n, BLOCK)], "<u4")
    none = np.array([d is None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    z = lambda a: _part(zlib.compress(a.tobytes(), 6))
    raws = [sizes, sums, *(np.concatenate([p[i].reshape(-1) for p in parts]).astype(kind) if parts else np.empty(0, kind) for i, kind in ((1, "<u4"), (2, "<u8"), (3, "<u4"), (0, "<u4")))]
    return b"".join([MAGIC, struct.pack("<5IQ", scale, LANES, STEPS, CHECK, len(doc_ids), n), z(ids), z(none), z(lengths.astype("<u4")), z(symbols), z(freq32), *(_part(a.tobytes()) for a in raws)])


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents' ids, their lengths and all tokens of a segment; ValueError if it is damaged."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    scale, lanes, steps, check, docs, n = struct.unpack_from("<5IQ", data, 4)
    if (lanes, steps, check) != (LANES, STEPS, CHECK) or scale > 31:
        raise ValueError("segment written with other settings")
    at, parts = 4 + struct.calcsize("<5IQ"), []
    while at < len(data):
        (size,) = struct.unpack_from("<I", data, at)
        parts.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    ids, none, lengths, symbols, freq32 = (np.frombuffer(zlib.decompress(p), k) for p, k in zip(parts[:5], ("<i8", np.uint8, "<u4", "<u4", "<u4"), strict=True))
    sizes, sums, words, states, places, stream = (np.frombuffer(p, k) for p, k in zip(parts[5:], ("<u4", "<u4", "<u4", "<u8", "<u4", "<u4"), strict=True))
    freq = freq32.astype(np.uint64)
    table = np.repeat(np.arange(len(freq), dtype=np.int32), freq32), freq, np.cumsum(freq) - freq
    offsets = np.cumsum(words, dtype=np.int64) - words
    whole = n // BLOCK
    per = STEPS // CHECK
    out = []
    if whole:
        k = whole * per
        out.append(_decode(states[: k * LANES].reshape(k, LANES), (offsets[:whole, None] + places[:k].reshape(whole, per)).reshape(-1), CHECK, stream, table, scale).reshape(-1))
    if rest := n - whole * BLOCK:
        s, own = -(-rest // LANES), states[whole * per * LANES :].reshape(-1, LANES)
        got = [_decode(own[i : i + 1], (offsets[whole:] + places[whole * per + i])[:1], min(CHECK, s - i * CHECK), stream, table, scale).reshape(-1) for i in range(len(own))]
        out.append(np.concatenate(got)[:rest])
    tokens = symbols[np.concatenate(out)] if out else np.empty(0, "<u4")
    for i, size in enumerate(sizes):
        if zlib.crc32(tokens[i * BLOCK : i * BLOCK + size].astype("<u4").tobytes()) != sums[i]:
            raise ValueError(f"block {i}: wrong checksum")
    return [None if x else int(i) for i, x in zip(ids, none, strict=True)], lengths, tokens
