"""The corpus pipeline: quality rules, exact dedup, near copies, mixing, encoding.

Every stage works on all rows its predecessor kept; the documents between two stages are a
Parquet table in the shared folder.  Texts go to Python in batches of a few megabytes, so that neither the
JVM nor its workers hold many at a time.  All stages but the last return the columns of documents.
A document without usable text fails the quality rules; empty tables pass through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import exact_dedup, mixing, ngram_join, piece_codec, quality_rules
from veilwork.llm.queries import PIECE_MODEL
from veilwork.llm.shared import bound_batches, written
from veilwork.session import table, tune


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    return quality_rules.reject(docs, table(bound_batches(tune(spark)), sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    bound_batches(spark)
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the smallest doc_id stays."""
    bound_batches(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at the rates that meet the domain targets."""
    return mixing.sample(docs, table(bound_batches(tune(spark)), sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and source with the token ids, packed as little-endian unsigned 32-bit integers."""
    bound_batches(spark)
    coded = piece_codec.code(docs, PIECE_MODEL)
    return coded.select("doc_id", "source", *[F.col(f"_piece_code.{c}").alias(c) for c in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")])


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near copies", near), ("mixing", mix), ("encoding", encode)]

# The likelihood ratio, the fitted rates and the encoding can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
