"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brassledger.llm import jaccard, language, mixing, packing, secrets
from brassledger.llm.common import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language or in too many at once: null, empty and
    letterless texts, and those without a language for 0.4 of their words."""
    return language.with_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with 5-word Jaccard similarity of 0.8 or
    more, that with the least id: SimHash search, each link verified, min-hashes
    for similar texts with distant fingerprints. Wordless texts are one group."""
    return jaccard.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets; keeps every document. Null texts stay null."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps or cuts documents so that sources meet their targets. Null
    sources are one source; wordless documents are taken no words of."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids. A null text is its end id."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_dedup", near_dedup),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, similarity of texts and tokenizers are not SQL; tests/llm has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
