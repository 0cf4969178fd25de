"""One query per operator over the given tables, each over whole tables and whole texts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import (
    clusters, exact, fim, langid, mixing, packing, passages, planes, quality, sharding, simhash, topk, vectors,
)
from strophe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; the folder is set by STROPHE_TOKENIZERS or found beside the library."""
    folder = os.environ.get("STROPHE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@_query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset")
    )


@_query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    found = langid.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@_query
def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    found = quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@_query
def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@_query
def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to plane files and read back."""
    docs = table(spark, sf_dir, "documents")
    files = planes.write_ids(docs, tokenizer_file("word_bpe_49k.json"), planes.fresh_folder(docs))
    return planes.read_ids(files)


@_query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed so that a source's share follows the square root of its size, and shuffled."""
    return mixing.mix(table(spark, sf_dir, "documents"))


CHECKS["op8_mixing"] = mixing.MIX_SQL


@_query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes, equal texts together."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


@_query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact-duplicate group of every document."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


CHECKS["op10_exact_dedup"] = """
with n as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h
  from documents)
select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
  doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256 from n
"""


@_query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at lines and put together with the middle last, and its text back from that."""
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restored().cast("binary"), 256).alias("restored_sha256"),
    )


CHECKS["op11_fill_in_middle"] = fim.FIM_SQL


@_query
def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows with the largest inner product for every fiftieth embedding."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


CHECKS["op12_top_k"] = topk.TOPK_SQL


@_query
def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in sixteen clusters."""
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


CHECKS["op13_clusters"] = clusters.clusters_sql()
