"""The stages on a small corpus, each against what it should do to its own input."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_similar import slow as brute
from waymark.llm import bpe, mixing
from waymark.llm._shared import stored
from waymark.llm.queries import byte_bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, docs):
    before = docs.select(COLUMNS)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]
    for name, stage in pipeline.STAGES:
        after = stored(stage(spark, before, ""), name)
        a, b = before.collect(), after.collect()
        if name == "language_id":
            gone = Counter(a) - Counter(b)
            assert all(not any(c.isalpha() for c in r["text"] or "") for r in gone)
            assert all(any(c.isalpha() for c in r["text"] or "") for r in b)
        elif name == "exact_dedup":
            best = {}
            for r in a:
                best[r["text"]] = max(best.get(r["text"], -1), -1 if r["doc_id"] is None else r["doc_id"])
            assert {r["text"]: -1 if r["doc_id"] is None else r["doc_id"] for r in b} == best and len(b) == len(best)
        elif name == "simhash_near_dedup":
            stay, _ = brute([(r["doc_id"], r["text"]) for r in a if r["doc_id"] is not None])
            assert {r["doc_id"] for r in b} - {None} == stay and len(b) == len({(r["doc_id"], r["text"]) for r in b})
            assert [r["text"] for r in a if r["doc_id"] is None] == [r["text"] for r in b if r["doc_id"] is None]
            assert len(b) < len(a)
        elif name == "mixing":
            want = {r["doc_id"]: r["copies"] for r in mixing.mixture(before).collect()}
            assert Counter(r["doc_id"] for r in b) == Counter({k: v for k, v in want.items() if v})
        else:
            own = bpe.bpe(byte_bpe())
            texts = {r["doc_id"]: r["text"] for r in a}
            assert len(a) == len(b)
            for r in b:
                ids = next(iter(own.encode([(texts[r["doc_id"]] or "").encode()])))
                assert bytes(r["token_ids"]) == ids and r["n_tokens"] == len(np.frombuffer(ids, "<u4"))
        if name != "bpe":
            assert after.columns == COLUMNS
        before = after


def test_nothing_in_nothing_out(spark, empty):
    df = empty.select(COLUMNS)
    for name, stage in pipeline.STAGES:
        df = stored(stage(spark, df, ""), name)
        assert df.count() == 0


def test_no_language_named(spark, docs):
    df = docs.select(COLUMNS).withColumn("lang", F.lit(None).cast("string"))
    kept = pipeline.language_id(spark, df, "").count()
    assert kept == df.filter("text rlike '\\\\p{L}'").count()


def test_run(spark, tmp_path, docs):
    docs.select(COLUMNS).filter("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "token_ids" in out.columns
