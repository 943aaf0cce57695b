"""The pipeline over the smallest tables: columns, what stays, and that nothing clean is lost."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    from geoloom.llm.common import materialize, read

    docs = read(spark, SF, "documents")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = materialize(f(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def test_stages_keep_columns_and_only_take_rows_away(steps):
    for a, b in zip(steps[:-2], steps[1:-1], strict=False):
        assert a.columns == b.columns and set(x.doc_id for x in b.select("doc_id").collect()) <= set(x.doc_id for x in a.select("doc_id").collect())


def test_decisions_take_effect(spark, steps):
    from geoloom.llm import decontamination, near_dedup, secrets

    _, good, unique, clean, redacted, packed = steps
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert good.join(labels, "doc_id").where("quality = 0").count() == 0
    assert near_dedup.near_duplicates(unique).where("not kept").count() == 0
    assert decontamination.decontaminate(clean, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
    assert secrets.scan_secrets(redacted).where("n_assign + n_access + n_hex > 0").count() == 0
    assert redacted.count() == clean.count() == packed.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
