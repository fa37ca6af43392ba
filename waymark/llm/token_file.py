"""Token files: the ids of all documents in ascending order of doc_id, entropy-coded.

A token file is a folder of Parquet files whose rows are segments (see rans.py):
shard and segment give their order, body is the coded segment.  Spark's commit
protocol makes the write safe against lost and repeated tasks on any file
system.  A segment ends with the document that brings it to SEGMENT tokens, so
memory is bounded by that and the longest document.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm import rans
from waymark.llm._shared import map_arrow, partitions, stored
from waymark.llm.bpe import bpe

SEGMENT = 1 << 21
#: Bytes of text that are encoded at once: more of them share fragments.
AT_ONCE = 1 << 22
#: Fragments that a worker remembers.
REMEMBERED = 450_000


def write(df: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id", shards: int | None = None) -> None:
    """Encodes each whole text, adds end_id and writes a token file.

    Null and empty texts are written as the end id alone.  Rows of equal doc_id
    are all written, ordered by text; null ids come first.  Other columns are
    not read.  An empty table gives a file without segments.
    """
    n = shards or partitions(df)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = bpe(tokenizer, REMEMBERED), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        segment = 0
        docs: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, held, size, segment
            lengths = np.array([len(x) // 4 for x in held], "<u4")
            body = rans.pack(docs, lengths, np.frombuffer(b"".join(held), "<u4"))
            out = pa.RecordBatch.from_pydict({"shard": [shard], "segment": [segment], "n_docs": [len(docs)], "n_tokens": [size], "body": [body]}, pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("body", pa.binary())]))
            docs, held, size, segment = [], [], 0, segment + 1
            return out

        coming: deque[int | None] = deque()

        def texts() -> Iterator[bytes | None]:
            for batch in batches:
                coming.extend(batch.column(0).to_pylist())
                for at in range(0, batch.num_rows, 1000):
                    yield from batch.column(1).slice(at, 1000).cast(pa.binary()).to_pylist()

        for ids in coder.encode(texts(), AT_ONCE):
            docs.append(coming.popleft())
            held.append(ids + end)
            size += len(ids) // 4 + 1
            if size >= SEGMENT:
                yield flush()
        if docs:
            yield flush()

    map_arrow(rows, run, "shard int, segment int, n_docs long, n_tokens long, body binary").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Documents of a token file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; with ids=True also token_ids (binary).

    Every block's checksum is checked; a damaged one is an error.  Rows come as
    they were written: null ids, empty texts (the end id alone), texts of any length and
    repeated rows included; a file without segments gives no rows.
    """
    table = spark.read.parquet(path)
    shards = table.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row for each file
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    starts = table.select("shard", "segment", (F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_tokens")).alias("before"))
    # written down first: with its size known, so few rows go to the bodies, and not the bodies to them
    starts = stored(starts.join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("before")).alias("start")), "starts")
    rows = table.select("shard", "segment", "body").join(starts, ["shard", "segment"]).select("start", "body")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, lengths, tokens = rans.unpack(body.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = tokens.astype("<u4").tobytes()
                for k in range(0, len(docs), 2000):
                    own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends[k : k + 2000].tolist(), lengths[k : k + 2000].tolist(), strict=True)]
                    made = [pa.array(docs[k : k + 2000], pa.int64()), pa.array(at + ends[k : k + 2000] - lengths[k : k + 2000]), pa.array(lengths[k : k + 2000].astype(np.int64)), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays([*made, pa.array(own, pa.binary())] if ids else made, names=[*names, "token_ids"] if ids else names)

    return map_arrow(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids binary" * ids)
