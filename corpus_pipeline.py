"""A training corpus from raw documents: quality rules, exact dedup, near-duplicate dedup, source mixing, packing.

Each stage is written as Parquet and read again as the next one's documents. Null texts and sources, repeated rows
and empty tables go through every stage; each says what becomes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm.common import discard, finished, table
from driftloom.llm.exact_dedup import drop_copies
from driftloom.llm.mixing import mixed_documents
from driftloom.llm.ngram_join import one_per_class
from driftloom.llm.packing import pack
from driftloom.llm.quality_rules import keep_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule of the strict policy. Null, empty and blank texts have too few words and go;
    repeated rows all stay; an empty table stays empty."""
    return keep_documents(docs, "strict-1")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, null ids last; a repeated row stays once."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id, null ids last. Texts without words, which no
    earlier stage lets through, would all stay."""
    return one_per_class(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighed 5, 2, 1, repeating, a null source last; a document may stand up to twice, or not at all."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 1024; a null text is its separator alone."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mixed), ("pack", packed)]
#: The tokens of the last stage are beyond SQL; the tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote on the way, and its input, if that is no given table, are
    deleted once its result is written."""
    docs, own = table(spark, sf_dir, "documents"), False
    for name, stage in STAGES:
        made = finished(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if own:
            discard(docs)
        docs, own = made, True
    return docs
