"""The corpus pipeline: stages over ``documents``, each one operator of vellumix.llm.

Each stage but the last returns the columns of documents. Defined cases are those of the operators: null texts count as
empty, a null doc_id passes every filter, and empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumix.llm import bpe, decontaminate, quality, secrets, simhash
from vellumix.llm._common import prepare, read, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies above their language's threshold go."""
    return quality.filter_quality(docs, read(prepare(spark), sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are similar (0.8 over five-word shingles) stays: that with the smallest doc_id."""
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    return decontaminate.drop_leaks(docs, read(prepare(spark), sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text by a mark of their kind; all documents stay."""
    return secrets.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of what they decode to."""
    return bpe.tokenize(docs, *bpe.defaults())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]

#: Most stages can't be expressed in SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = read(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
