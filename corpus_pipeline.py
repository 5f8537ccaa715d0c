"""From documents to token ids: quality, near-duplicates, personal data, source mix, byte BPE.

Every stage takes the documents that the one before has kept, as written to Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import bpe, mixing, neardup, pii, quality
from gaugeflow.llm.queries import tokenizer_path
from gaugeflow.llm.text import cut_lineage, table

NEAR_WORDS = 5  # words of a shingle


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie below the likelihood-ratio threshold go."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return neardup.kept_documents(docs, words=NEAR_WORDS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kind; no document goes. ``n_chars`` follows the text."""
    return pii.redacted(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to two times; ``n_chars`` follows the text."""
    return mixing.mixed_texts(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens."""
    return bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_path())


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

# SQL has neither the likelihood-ratio model nor the encoder; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
