"""Near-duplicate texts by SimHash: wide fingerprints in sampled tries, similarity of shingles verified.

Two texts of Jaccard similarity s differ in a bit of the SimHash of their sets
of shingles with probability p = acos(2 s / (1 + s)) / pi at most, 0.15 at 0.8: of
64 bits about ten, too many to be told from chance among many texts.  So
fingerprints have 256 bits, and a fingerprint goes to several tries, each with a
path of 64 bits drawn from them.  The first bits of the path are the key under
which Spark deals the rows; below it pairs of nodes are traversed together and
dropped as soon as their differing bits exceed the error budget, which grows
with depth (mean and two deviations of what similar texts differ by).  Keys are
as long as the number of texts asks for, and there are as many tries as it takes to
miss a pair of the least similarity with probability MISS; pairs of more
are missed far less often.

A pair that meets and differs in few enough of all bits is verified: its two
sets of shingles are compared.  Only texts with such a partner are read again
for that, and pairs are never rows: a key's task links them itself.  Texts with equal
sets are one to all this, however many they are.  A key with more than SPLIT
texts is cut into blocks, each joined by itself; what is not connected by
then meets block by block, so that a group of near copies, however large, costs
as much as its size if its blocks connect it, and no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import ngram_lm
from waymark.llm._shared import map_arrow, partitions, quoted, stored
from waymark.llm.components import components
from waymark.llm.simhash import traverse

#: 64-bit words of a fingerprint, how many texts of a key are usual, and how many are joined at once at most.
WORDS, USUAL, SPLIT = 4, 2048, 4096
#: A text counts as one more for each so many shingles.
LONG = 1000
#: Rows and bytes of cells that a task works on at once.
ROWS, BYTES = 1 << 15, 64 << 20
#: How often a pair of the least similarity may not meet in any trie.
MISS = 3e-3
_u = np.uint64
_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, WORDS + 2, np.uint64) * _u(2) + _u(1)


def shingled(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text, ascending, one text after the other, and how many each has; texts of fewer words have one, of all words."""
    w, n = ngram_lm.hashed(texts)
    n = n - 1
    w = w[w != ngram_lm.END]
    many = np.where(n > 0, np.maximum(1, n - width + 1), 0)
    first = np.cumsum(n) - n
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    end = np.repeat(first + n, many)
    h = np.zeros(len(at), np.uint64)
    for j in range(width):
        inside = at + j < end
        h = ngram_lm._mix(h * _u(0x9E3779B97F4A7C15) + np.where(inside, w[np.minimum(at + j, max(0, len(w) - 1))], _u(0)))
    doc = np.repeat(np.arange(len(texts)), many)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
    return h[new], np.bincount(doc[new], minlength=len(texts))


def fingerprints(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of texts' shingles (every text has one at least): texts x bytes.  A bit is 1 if it is in over half of them."""
    first = np.cumsum(n) - n
    out = np.empty((len(n), 8 * WORDS), np.uint8)
    parts = -(-n // 255)  # counts of 255 fit into a byte, eight of them into a number
    begin = np.cumsum(parts) - parts
    cut = np.repeat(first - 255 * begin, parts) + 255 * np.arange(parts.sum())
    edge = np.append(cut, len(h))
    ones = np.empty((len(cut), 64), np.uint8)
    for k in range(WORDS):
        for a in range(0, len(cut), 4096):  # about a million shingles at once
            b = min(a + 4096, len(cut))
            bits = np.unpackbits(ngram_lm._mix(h[edge[a] : edge[b]] ^ _SEEDS[k]).view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
            ones[a:b] = np.add.reduceat(bits, cut[a:b] - edge[a], axis=0).view(np.uint8)
        out[:, 8 * k : 8 * k + 8] = np.packbits(2 * np.add.reduceat(ones.astype(np.int32), begin, axis=0) > n[:, None], axis=1)
    return out


def _fixed(a: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    return pa.array([x.tobytes() for x in a], pa.binary())


def _bytes(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _sketched(rows: DataFrame, width: int) -> DataFrame:
    """(key, low, high, fp, n) of rows (key, text) with words: low and high name the set of n shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, at = batch.column(0).to_numpy(), 0
            for texts in ngram_lm._chunks(batch.column(1)):
                h, n = shingled(texts, width)
                some = np.flatnonzero(n)
                n = n[some]
                if len(some):
                    sums = [np.add.reduceat(ngram_lm._mix(h ^ s), np.cumsum(n) - n).view(np.int64) for s in _SEEDS[WORDS:]]
                    yield pa.RecordBatch.from_arrays([pa.array(key[at + some]), *map(pa.array, sums), _fixed(fingerprints(h, n)), pa.array(n)], names=["key", "low", "high", "fp", "n"])
                at += len(texts)

    return map_arrow(rows, run, "key long, low long, high long, fp binary, n long")


@dataclass
class Tries:
    """How n fingerprints are joined."""

    bits: int  #: of a path that are the key
    paths: np.ndarray  #: tries x 64: bits of the fingerprint
    budget: np.ndarray  #: errors allowed among the first bits behind the key, by depth
    errors: int  #: among all bits

    @classmethod
    def of(cls, n: int, similarity: float) -> Tries:
        p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
        bits = min(32, max(0, math.ceil(math.log2(max(1, n) / USUAL))))
        within = lambda d, k: p * d + k * math.sqrt(p * (1 - p) * d)
        budget = np.array([math.floor(within(d, 2.0)) for d in range(65)])
        errors = math.ceil(within(64 * WORDS, 4.0))
        # texts that differ in d bits meet in a trie by chance; d itself varies
        size = 64 * WORDS
        often = [math.comb(size, d) * p**d * (1 - p) ** (size - d) for d in range(errors + 1)]
        apart = [1.0 - cls._meeting(d / size, bits, budget) for d in range(errors + 1)]
        tries = 1
        while 1.0 - sum(often) < MISS and sum(o * a**tries for o, a in zip(often, apart, strict=True)) > MISS:
            tries += 1
        rng = np.random.default_rng(7)
        paths = np.array([rng.permutation(64 * WORDS)[:64] for _ in range(tries)])
        return cls(bits, paths, budget, errors)

    @staticmethod
    def _meeting(p: float, bits: int, budget: np.ndarray) -> float:
        """The chance that two paths that differ in each bit by the chance p have one key and stay within the budget all the way down."""
        at = np.zeros(66)
        at[0] = (1 - p) ** bits
        for d in range(1, 65 - bits):
            at[1:] = at[1:] * (1 - p) + at[:-1] * p
            at[0] *= 1 - p
            at[budget[d] + 1 :] = 0
        return float(at.sum())

    def path(self, bits: np.ndarray, k: int) -> np.ndarray:
        """The path into trie k of each fingerprint (rows of single bits)."""
        return np.ascontiguousarray(np.packbits(bits[:, self.paths[k]], axis=1)).view(">u8").reshape(-1).astype(np.uint64)

    def met_before(self, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether fingerprints that differ in the bits x meet in a trie before k."""
        differ = np.unpackbits(x.view(np.uint8), axis=1).astype(bool)
        met = np.zeros(len(x), bool)
        for t in range(int(k.max(initial=0))):
            open_ = np.flatnonzero(~met & (k > t))
            same = open_[~differ[np.ix_(open_, self.paths[t, : self.bits])].any(axis=1)]
            off = np.cumsum(differ[np.ix_(same, self.paths[t, self.bits :])], axis=1, dtype=np.int8)
            met[same] = (off <= self.budget[1 : 65 - self.bits]).all(axis=1)
        return met


def _keyed(classes: DataFrame, tries: Tries) -> DataFrame:
    """(trie, value, node, fp, weight): each fingerprint under its key in each trie."""
    held = classes.sparkSession.sparkContext.broadcast(tries)  # some tens of paths

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for batch in batches:
            bits = np.unpackbits(_bytes(batch.column(1), 8 * WORDS), axis=1)
            for k in range(len(t.paths)):
                value = (t.path(bits, k) >> _u(32)).astype(np.int64) >> (32 - t.bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k, np.int32)), pa.array(value), *batch.columns], names=["trie", "value", "node", "fp", "weight"])

    return map_arrow(classes.select("node", "fp", F.greatest(F.lit(1.0), F.col("n") / LONG).alias("weight")), run, "trie int, value long, node long, fp binary, weight double")


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Pieces of a partition sorted by cell (trie, value, block), none cutting a cell, and the number of each row's cell."""
    held, n, size = [], 0, 0

    def cells() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        cell = np.stack([table.column(i).to_numpy() for i in range(3)], axis=1)
        return table, np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1

    def numbered(table: pa.Table, change: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        number = np.zeros(table.num_rows, np.int64)
        number[change] = 1
        return table, np.cumsum(number)

    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n < ROWS and size < BYTES:
            continue
        table, change = cells()
        if len(change):  # the last cell may go on
            yield numbered(table.slice(0, change[-1]), change[:-1])
            table = table.slice(change[-1])
        held, n, size = table.to_batches(), table.num_rows, table.nbytes
    if n:
        yield numbered(*cells())


def _candidates(t: Tries, table: pa.Table, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell that meet there first, and how many bits they differ in.

    Rows of one root are linked already; where a cell has two sides, only pairs across count.
    """
    trie, side, root = (table.column(c).to_numpy() for c in ("trie", "side", "root"))
    fp = _bytes(table.column("fp"), 8 * WORDS)
    bits, path = np.unpackbits(fp, axis=1), np.empty(len(fp), np.uint64)
    for k in np.unique(trie).tolist():
        own = trie == k
        path[own] = t.path(bits[own], k) << _u(t.bits)
    order = np.lexsort((path, cell))
    words = fp.view(np.uint64)
    for a, b in traverse(cell[order], path[order], t.budget):
        a, b = order[a], order[b]
        x = words[a] ^ words[b]
        off = np.bitwise_count(x).sum(axis=1)
        ok = (off <= t.errors) & (root[a] != root[b]) & ((side[a] != side[b]) | (side[a] == 0))
        if ok.any():
            a, b, x, off = a[ok], b[ok], x[ok], off[ok]
            new = ~t.met_before(x, trie[a])
            yield a[new], b[new], off[new].astype(np.int64)


def _dealt(cells: DataFrame, each: int) -> DataFrame:
    return cells.repartition(partitions(cells, each), "trie", "value", "block").sortWithinPartitions("trie", "value", "block")


def _with_partners(cells: DataFrame, tries: Tries) -> DataFrame:
    """The rows of cells (trie, value, block, side, root, node, fp) that have a candidate in their cell."""
    held = cells.sparkSession.sparkContext.broadcast(tries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cell in _whole(batches):
            keep = np.zeros(table.num_rows, bool)
            for a, b, _ in _candidates(held.value, table, cell):
                keep[a] = keep[b] = True
            yield from table.filter(pa.array(keep)).to_batches()

    return map_arrow(_dealt(cells, 32 << 20), run, cells.schema)


def _verified(cells: DataFrame, tries: Tries, similarity: float) -> DataFrame:
    """Links (a, b) that connect the nodes of cells as the similar ones of their candidates would; cells with their rows' shingles as grams."""
    held = cells.sparkSession.sparkContext.broadcast(tries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cell in _whole(batches):
            grams = table.column("grams").combine_chunks()
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in grams]
            linked = list(range(len(own)))
            links = []
            pairs = [np.stack(x, axis=1) for x in _candidates(held.value, table, cell)]
            pairs = np.concatenate(pairs) if pairs else np.empty((0, 3), np.int64)
            for a, b, _ in pairs[np.argsort(pairs[:, 2], kind="stable")].tolist():
                x, y = _top(linked, a), _top(linked, b)
                if x != y and similar(own[a], own[b], similarity):
                    linked[max(x, y)] = min(x, y)
                    links.append((a, b))
            if links:
                ends = np.array(links)
                node = table.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node[ends[:, 0]]), pa.array(node[ends[:, 1]])], names=["a", "b"])

    return map_arrow(_dealt(cells, 256 << 20), run, "a long, b long")


def _top(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = x = root[root[x]]
    return x


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two ascending sets have at least that Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return both >= similarity * (len(x) + len(y) - both)


def _grams(rows: DataFrame, width: int) -> DataFrame:
    """(gram_of, grams) of rows (key, text): the shingles as 64-bit numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in ngram_lm._chunks(batch.column(1)):
                h, n = shingled(texts, width)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([h[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())], names=["gram_of", "grams"])
                at += len(texts)

    return map_arrow(rows, run, "gram_of long, grams binary")


def _joined(cells: DataFrame, rows: DataFrame, tries: Tries, width: int, similarity: float) -> DataFrame:
    """The links that cells give."""
    some = stored(_with_partners(cells, tries), "partners")
    wanted = some.select("node").distinct()
    grams = stored(_grams(rows.join(wanted, rows.key == wanted.node, "left_semi").select("key", "text"), width), "grams")
    return stored(_verified(some.join(grams, some.node == grams.gram_of).select(*some.columns, "grams"), tries, similarity), "links")


def links(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect the keys of rows (key, text) as all pairs of at least that similarity would."""
    sketches = stored(_sketched(rows, width), "sketches")
    classes = stored(sketches.groupBy("low", "high").agg(F.min("key").alias("node"), F.first("fp").alias("fp"), F.first("n").alias("n")), "classes")
    equal = sketches.join(classes, ["low", "high"]).filter("key <> node").select(F.col("key").alias("a"), F.col("node").alias("b"))
    tries = Tries.of(classes.count(), similarity)
    keyed = _keyed(classes, tries)
    # texts count more if they are long, so that a block's shingles are bounded too
    large = keyed.groupBy("trie", "value").agg(F.sum("weight").alias("weight")).filter(F.col("weight") > SPLIT)
    large = stored(large.select(F.col("trie").alias("l_trie"), F.col("value").alias("l_value"), F.ceil(F.col("weight") / SPLIT).alias("blocks")), "large")
    in_large = (F.col("trie") == F.col("l_trie")) & (F.col("value") == F.col("l_value"))
    of = lambda blocks: F.pmod(F.xxhash64("node", "trie"), blocks)
    block = F.when(F.col("blocks").isNull(), F.lit(0).cast("long")).otherwise(of(F.col("blocks")))
    cells = keyed.join(large, in_large, "left").select("trie", "value", block.alias("block"), F.lit(0).alias("side"), F.col("node").alias("root"), "node", "fp")
    found = _joined(cells, rows, tries, width, similarity).union(equal)
    if large.isEmpty():
        return found
    # of large keys: whoever is not in the largest component meets all others, block by block
    root = components(found).select(F.col("node").alias("of"), "root")
    placed = keyed.join(large, in_large).join(root, F.col("node") == F.col("of"), "left").select("trie", "value", "blocks", F.coalesce("root", "node").alias("root"), "node", "fp", "weight")
    placed = stored(placed, "placed")
    sizes = placed.groupBy("trie", "value", "root").agg(F.sum("weight").alias("weight")).groupBy("trie", "value").agg(F.max_by("root", "weight").alias("main"), F.ceil((F.sum("weight") - F.max("weight")) / SPLIT).alias("others")).filter("others > 0")
    placed = placed.join(stored(sizes.toDF("l_trie", "l_value", "main", "others"), "open"), in_large)
    number = lambda i, j: (i * F.col("others") + j).alias("block")
    ranks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    out = ["trie", "value", "block", "side", "root", "node", "fp"]
    every = placed.withColumn("j", ranks(F.col("others"))).withColumn("block", number(of(F.col("blocks")), F.col("j"))).withColumn("side", F.lit(1)).select(*out)
    other = placed.filter("root <> main").withColumn("i", ranks(F.col("blocks"))).withColumn("block", number(F.col("i"), of(F.col("others")))).withColumn("side", F.lit(2)).select(*out)
    return found.union(_joined(every.union(other), rows, tries, width, similarity))


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df, with all their columns, whose doc_id is the smallest that links lead to; rows of null doc_id link others and stay.

    Two texts are linked if the Jaccard similarity of their sets of shingles of
    width words (A-Z in lower case) is at least `similarity`; texts of fewer words are one
    shingle.  Null texts and those without words are linked with nothing; very
    long ones are read whole; repeated rows share their fate; an empty table
    gives an empty one.  Columns that begin with two underscores are the
    operator's own.
    """
    full = stored(df.withColumn("__key", F.monotonically_increasing_id()), "numbered")
    slim = full.select(F.col("__key").alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = components(links(slim.select("key", "text").filter("text is not null"), width, similarity))
    member = found.select(F.col("node").alias("key"), "root").union(found.select("root", "root")).distinct()
    member = stored(member.join(slim.select("key", "doc_id"), "key").filter("doc_id is not null"), "members")
    low = member.groupBy("root").agg(F.min("doc_id").alias("low"))
    gone = member.join(low, "root").filter("doc_id <> low").select(F.col("key").alias("__gone")).distinct()
    return full.join(gone, F.col("__key") == gone["__gone"], "left_anti").select(*quoted(df.columns))
