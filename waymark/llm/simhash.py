"""SimHash near-duplicates, linked by a binary trie self-join.

A fingerprint's bit is set if it is set in over half of the hashes of the
text's shingles.  Fingerprints that differ in at most `errors` bits are found in
a binary trie: pairs of nodes of one depth are traversed together, the
differing bits of their paths are added up, and a pair is dropped as soon as
they exceed the budget.

To spread the join, a fingerprint goes to errors + 1 tries, one for each block
of bits: of two fingerprints within the budget at least one block is equal, and
there the two share the path down to that block.  A block value with more than
SPLIT fingerprints is cut further in the same way by the bits that are left, so
a trie under one key holds at most SPLIT fingerprints or, at the bottom,
2 ** BOTTOM different ones.  Only distinct fingerprints are joined, and a trie
gives a spanning forest of its links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm._shared import map_arrow, named, partitions, stored
from waymark.llm.components import components, forest

SPLIT = 2048
BOTTOM = 16
#: Pairs of nodes that are traversed at once.
AT_ONCE = 1 << 20


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the shingles of width words of a UTF-8 text; zero without words."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter((h(b" ".join(words[i : i + width]), seed) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", width: int = 4, column: str = "fp") -> DataFrame:
    """df with the fingerprint of each text as a long (its bits as they are).

    Null, empty and wordless texts have zero; texts of any length are read
    whole; repeated rows stay; an empty table gives an empty one.  A column of
    df named like the new one is replaced.
    """
    at = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                b = batch.slice(start, 2000)
                made = np.array([fingerprint(t or b"", width) for t in b.column(at).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made.view(np.int64))], names=[*b.schema.names, "__fp"])

    return named(map_arrow(df, run, T.StructType([*df.schema.fields, T.StructField("__fp", T.LongType())])), **{column: "__fp"})


def traverse(key: np.ndarray, path: np.ndarray, budget: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places a < b of pairs of one key whose paths differ in at most budget[d] of the first d bits, at each depth that is walked.

    key is ascending and path (unsigned) ascending within a key.  Pairs of nodes
    with few paths below them are not walked any further: their pairs all come out.
    """
    n = len(path)
    if not n:
        return
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.append(first[1:], n)
    zeros = {}

    def middle(low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
        if depth not in zeros:
            bit = (path >> np.uint64(63 - depth)) & np.uint64(1)
            zeros[depth] = np.concatenate([[0], np.cumsum(bit == 0)])
        return low + zeros[depth][high] - zeros[depth][low]

    # nodes are ranges low..high of path; all pairs in a piece have the same depth
    many = last - first > 1
    todo = [(0, first[many], last[many], first[many], last[many], np.zeros(many.sum(), np.int8))]
    while todo:
        depth, al, ah, bl, bh, off = todo.pop()
        if len(al) > AT_ONCE:
            half = len(al) // 2
            for s in (slice(half), slice(half, None)):
                todo.append((depth, al[s], ah[s], bl[s], bh[s], off[s]))
            continue
        leaf = ((ah - al) * (bh - bl) <= 16) | (depth == 64)
        if leaf.any():
            for x in _few(al[leaf], ah[leaf], bl[leaf], bh[leaf]):
                a, b = _pairs(*x)
                ok = a < b
                yield a[ok], b[ok]
            keep = ~leaf
            al, ah, bl, bh, off = al[keep], ah[keep], bl[keep], bh[keep], off[keep]
        if not len(al):
            continue
        am, bm = middle(al, ah, depth), middle(bl, bh, depth)
        same = al == bl
        parts = [(al, am, bl, bm, off), (am, ah, bm, bh, off), (al, am, bm, bh, off + 1), (am[~same], ah[~same], bl[~same], bm[~same], off[~same] + 1)]
        al, ah, bl, bh, off = (np.concatenate(x) for x in zip(*parts, strict=True))
        ok = (al < ah) & (bl < bh) & (off <= budget[depth + 1])
        todo.append((depth + 1, al[ok], ah[ok], bl[ok], bh[ok], off[ok].astype(np.int8)))


def trie_join(key: np.ndarray, fp: np.ndarray, errors: int) -> np.ndarray:
    """Spanning forest of the links between distinct fingerprints of one key: for each the place of the smallest it is linked with.

    key is ascending and fp (unsigned) ascending within a key; a key is the
    upper part of the path into its trie.
    """
    root = np.arange(len(fp))
    for a, b in traverse(key, fp, np.full(65, errors)):
        ok = root[a] != root[b]
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= errors
        if ok.any():
            root = forest(len(fp), a[ok], b[ok], root)
    return root


def _few(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of ranges in pieces that hold about 4 x AT_ONCE pairs of places; a pair of long ranges is cut."""
    size = (ah - al) * (bh - bl)
    whole = size <= AT_ONCE
    for i in np.flatnonzero(~whole).tolist():
        step = max(1, AT_ONCE // int(bh[i] - bl[i]))
        for low in range(int(al[i]), int(ah[i]), step):
            yield np.array([low]), np.array([min(low + step, int(ah[i]))]), bl[i : i + 1], bh[i : i + 1]
    al, ah, bl, bh, size = (x[whole] for x in (al, ah, bl, bh, size))
    piece = np.cumsum(size) // (4 * AT_ONCE)
    for s in np.split(np.arange(len(size)), np.flatnonzero(piece[1:] != piece[:-1]) + 1) if len(size) else []:
        yield al[s], ah[s], bl[s], bh[s]


def _pairs(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places from two ranges each."""
    na, nb = ah - al, bh - bl
    size = na * nb
    k = np.repeat(np.arange(len(size)), size)
    i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return al[k] + i // nb[k], bl[k] + i % nb[k]


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits), parts) if len(x)]


def _mask(bits: Iterable[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _linked(batches: Iterable[pa.RecordBatch], errors: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within each key of a partition sorted by (path, value, fp)."""

    def join(part: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (part[1:, :2] != part[:-1, :2]).any(axis=1)])
        key = np.cumsum(new)
        fp = part[:, 2].view(np.uint64) if part[:, 2].flags.c_contiguous else np.ascontiguousarray(part[:, 2]).view(np.uint64)
        order = np.lexsort((fp, key))  # Spark sorts fp as signed
        fp, key = fp[order], key[order]
        root = trie_join(key, fp, errors)
        own = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[root[own]].view(np.int64))], names=["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1))
        if sum(map(len, held)) < 1 << 18:
            continue
        part = np.concatenate(held)
        change = np.flatnonzero((part[1:, :2] != part[:-1, :2]).any(axis=1))
        if len(change):  # the last key may go on
            yield join(part[: change[-1] + 1])
            part = part[change[-1] + 1 :]
        held = [part]
    if held and sum(map(len, held)):
        yield join(np.concatenate(held))


def links(fps: DataFrame, errors: int = 4) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column fp: long) within the error budget as all links would.

    fps must hold each fingerprint once and no nulls (near_groups() sees to
    that); other columns are not read; no fingerprints give no links.
    """
    parts = errors + 1
    paths = [([], list(range(63, -1, -1)))]  # of each path: the bits that are equal, and those that are left
    rows = fps.select("fp", F.lit(0).alias("path"))
    out = None
    while True:
        # each path's keys are cut by the blocks of the bits that are left
        new = [(fixed + block, [b for b in left if b not in set(block)]) for fixed, left in paths for block in _blocks(left, parts)]
        masks = F.lit(np.array([_mask(fixed) for fixed, _ in new], np.int64))
        cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct((F.col("path") * parts + k).alias("path"), F.col("fp").bitwiseAND(F.get(masks, F.col("path") * parts + k)).alias("value")))
        keyed = rows.select("fp", F.explode(cut).alias("k")).select("k.path", "k.value", "fp")
        final = all(len(left) <= BOTTOM for _, left in new)
        if not final:
            large = stored(keyed.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT).select("path", "value"), "large")
            final = large.isEmpty()
        ordinary = keyed if final else keyed.join(large, ["path", "value"], "left_anti")
        n = partitions(fps, 16 << 20)  # each row goes to errors + 1 tries
        found = map_arrow(ordinary.repartition(n, "path", "value").sortWithinPartitions("path", "value", "fp"), lambda batches: _linked(batches, errors), "a long, b long")
        out = found if out is None else out.union(found)
        if final:
            return out
        hot = sorted(r["path"] for r in large.select("path").distinct().collect())
        number = np.zeros(len(new), np.int64)
        number[hot] = np.arange(len(hot))
        rows = stored(keyed.join(large, ["path", "value"], "left_semi").select("fp", F.get(F.lit(number), "path").cast("int").alias("path")).distinct(), "rows")
        paths = [new[k] for k in hot]


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, errors: int = 4) -> DataFrame:
    """A row for each row of df: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links lead to, the row's own
    included.  Null, empty and wordless texts have fingerprint zero and are
    linked like any other; texts of fewer than width words are one shingle.
    Repeated rows share their component.  Rows of null doc_id link others but
    name no component (it is null if it has no other row).  Other columns are
    not read; an empty table gives an empty result.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    slim = stored(fingerprints(docs, width=width).select("doc_id", "fp"), "fingerprints")
    classes = stored(slim.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    found = components(links(classes, errors))
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(rooted.join(low, "root").select(F.col("fp").alias("own"), "component_id"), "named")
    return slim.join(named, slim.fp == named.own).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, errors: int = 4) -> DataFrame:
    """The rows of df, with all their columns, whose doc_id is the smallest of its component; rows of null doc_id stay."""
    gone = near_groups(df, doc_id, text, width, errors).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return df.join(gone, F.col(doc_id).cast("long") == gone["__gone"], "left_anti")
