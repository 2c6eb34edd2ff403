"""Corpus pipeline: toxic documents out, one of each near-duplicate group, repeats cut, sources mixed, texts encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidlens.llm.bpe import encode, vocabulary
from bidlens.llm.common import stored, table
from bidlens.llm.minhash import keep_one
from bidlens.llm.mixing import repeated_by_weight
from bidlens.llm.suffix import without_repeats
from bidlens.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labels of the documents at hand."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest doc_id stays."""
    return keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; documents stay, even if nothing is left of them."""
    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to the limit; every document stays at least once."""
    return repeated_by_weight(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents and ``token_ids``, the ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids; repeated rows are encoded alike; an empty table stays empty.
    """
    return encode(docs, *vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffix", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]
# Trees, hashes and rank files cannot be written in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
