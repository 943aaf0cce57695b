"""The corpus pipeline: quality classifier, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import decontamination, near_dedup, packing, quality_classifier, secrets
from geoloom.llm.common import crc_remainder, materialize, read
from geoloom.session import ship

#: The stages are not expressible in SQL (a fitted classifier, a tokenizer); tests compare them with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels outside the held-out fold."""
    ship(spark)
    scored = quality_classifier.score(docs, read(spark, sf_dir, "labels"), usable=crc_remainder(F.col("doc_id"), 3) != 1, key=True)
    bad = scored.where("predicted = 0").select("doc_id", "text_hash").distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["text_hash"]), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id; shingles of five words."""
    ship(spark)
    return near_dedup.drop_near_duplicates(docs, width=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    ship(spark)
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; every document stays."""
    ship(spark)
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and offset."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality_classifier", quality), ("near_dedup", near_duplicates), ("decontamination", decontaminate), ("secret_scan", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
