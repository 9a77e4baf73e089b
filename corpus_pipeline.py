"""A training corpus from `documents`: five stages, each on all that the one before it kept.

A stage is a function of (spark, docs, sf_dir). Its result is written as Parquet in the shared folder and read
again as the docs of the next. All stages but the last return the columns of documents.

Null and empty texts are scored like others; if kept they are one group of copies, have no shingles and hold no item, and
their ids are those of no bytes. Very long texts go through every stage whole. Rows that repeat id and text are one row
after exact_dedup; of equal texts the largest id stays, of linked ones the row with the least (id, hash of the row), so
ties end in one row. Extra columns, whatever their names, are carried to the last stage. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lethe.llm import quality
from lethe.llm.bpe import bpe_digests
from lethe.llm.common import stored, table
from lethe.llm.decontaminate import without_hits
from lethe.llm.exact import exact_kept
from lethe.llm.near_dup import near_dup_kept


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant scores at its cutoff or above."""
    return quality.quality_kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest doc_id."""
    return exact_kept(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the one with the least doc_id."""
    return near_dup_kept(docs, k=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of benchmark."""
    return without_hits(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document left."""
    return bpe_digests(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: No SQL expresses a fitted discriminant or byte pair merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result but the last is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
