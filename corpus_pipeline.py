"""A corpus pipeline of the operators: language ID, exact and near dedup, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import exact, langid, mixing, packing, simhash
from strophe.llm.common import table
from strophe.llm.queries import tokenizer_file
from strophe.session import stage


def packed(docs: DataFrame, *inputs: str) -> DataFrame:
    """The columns an operator reads, and all columns as ``row``, so that none it adds can hide one of the caller's."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, *[F.col(f"`{c}`") for c in inputs])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without any letter go, also where no language could be learned.

    Null and empty texts have no letter and go. Null ids and languages are allowed;
    repeated rows are judged alike. All columns come through whatever their names;
    an empty table gives an empty one.
    """
    lettered = F.col("text").rlike(r"\p{L}")
    found = langid.detect(packed(docs, "doc_id", "text", "lang"))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) | lettered).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (after lower-casing A-Z), that with the largest id.

    Null texts count as empty, null ids come last; of repeated rows one stays. All
    columns come through; an empty table gives an empty one.
    """
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more.

    Copies are found as far as chains of fingerprints within six bits lead (README: recall).
    Of a group the smallest id stays, null ids last. Null and empty texts are alike; of
    repeated rows one stays. All columns come through; an empty table gives an empty one.
    """
    return simhash.keep_one(docs)


def mixing_of_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that a source's share follows the square root of its size, and shuffled.

    A null source is a source, a null id draws by the row's other values, repeated rows
    get equal counts. All columns come through; an empty table gives an empty one.
    """
    return mixing.mix(packed(docs, "doc_id", "source")).select("row.*")


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids placed in sequences of 2048.

    A null or empty text is the end id alone; null and repeated ids keep their pieces.
    Other columns are not read; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), with_ids=True, memo_units=60_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixing_of_sources),
    ("packing", token_packing),
]
ORACLE_SQL = None  # tokenizers and classifiers are beyond SQL; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each reading what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
