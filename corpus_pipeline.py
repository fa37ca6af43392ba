"""From raw documents to tokens: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, exact_dedup, langid, mixing, similar
from waymark.llm._shared import quoted, stored
from waymark.llm.queries import byte_bpe

#: A text whose main language has a smaller share of its letters is rejected.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those without a main language; languages are learned from the rows that name one.

    If no row names one, only texts without letters are rejected.
    """
    model = langid.fit(docs)
    clear = docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    if not model.languages:
        return clear
    return langid.identify(clear, model, names=("__lang", "__score", "__spans")).filter(F.col("__score") >= LEAST_SHARE).select(*quoted(docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the document with the largest doc_id; null texts are empty ones. No documents in, none out, here and in all stages."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of texts linked by a similarity of 0.8 or more (shingles of five words) the document with the smallest doc_id.

    Null and wordless texts and rows of null doc_id stay; repeated rows share their fate.
    """
    return similar.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents so that sources have their target words; some go, some come more than once, those without words go."""
    return mixing.apply_mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and the digest of the text they decode to; a null text is an empty one, a very long one is encoded whole."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), byte_bpe(), decoded="decoded")
    return out.select("doc_id", "lang", "source", bpe.n_ids().alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix), ("bpe", tokens)]

#: The stages are not expressible in SQL (learned model, fingerprints, random ranks, merges); tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
