"""The opN_<name> queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import decontamination, lm_scoring, near_dedup, nearest, packing, pii, quality_classifier, quality_rules, resampling, secrets, sharding, warc_revisits, whitening
from geoloom.llm.common import crc_remainder, read
from geoloom.session import shared_dir


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents")).drop("findings")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisits.resolve(warc_revisits.crawl_of(read(spark, sf_dir, "pages")))
    return found.withColumn("headers", warc_revisits.headers_text(F.col("headers")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_remainder(F.col("doc_id"), 3) == 1
    scored = quality_classifier.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), usable=~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=4)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents")).drop("findings")


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.resharded(read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/reshard-{uuid.uuid4().hex}")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secrets, op2_decontamination, op3_quality_rules, op4_lm_scoring, op5_warc_revisits, op6_quality_classifier, op7_near_dedup, op8_packing, op9_pii, op10_resharding, op11_nearest, op12_importance_resampling, op13_whitening)}
ORACLE_SQL: dict[str, str] = {"op2_decontamination": decontamination.SQL, "op5_warc_revisits": warc_revisits.SQL, "op7_near_dedup": near_dedup.SQL, "op12_importance_resampling": resampling.SQL}
