"""The operators as queries over the standard tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import lm_scoring, mixing, near_vectors, ngram_join, packing, pii, quality, token_counts, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_texts(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The byte-level BPE that the queries count and pack with, where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fitted(docs))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_mix": op1_mix,
    "op2_near_vectors": op2_near_vectors,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_counts": op4_token_counts,
    "op5_pack": op5_pack,
    "op6_lm_score": op6_lm_score,
    "op7_toxicity": op7_toxicity,
    "op8_topk": op8_topk,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
}
ORACLES: dict[str, str] = {"op1_mix": mixing.MIX_SQL, "op8_topk": topk.TOPK_SQL}
