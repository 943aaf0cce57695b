"""Queries do the whole job that their operator is for, beyond what their result shows."""

from pyspark.sql import functions as F

from geoloom import catalog_features, catalog_runs
from geoloom.operators import masking
from geoloom.sources import store
from geoloom.types import FeatureType

SF = "/root/testdata/sf0.001"


def test_save_load_stores_all_patches(spark, tmp_path):
    more = spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.col("user_id") * 20)
    more.write.parquet(str(tmp_path / "events.parquet"))
    back = store.load(spark, catalog_runs._stored(spark, str(tmp_path)), [FeatureType.DATA])
    got = {r.patch_id for r in back[FeatureType.DATA, "daily"].select("patch_id").distinct().collect()}
    want = {r.p for r in more.selectExpr("user_id div 50 AS p").distinct().collect()}
    assert got == want and max(want) > 3


def test_mask_values_calls_the_operator(spark, monkeypatch):
    calls, real = [], masking.mask_feature
    monkeypatch.setattr(masking, "mask_feature", lambda *a, **k: calls.append(a) or real(*a, **k))
    catalog_features.mask_values(spark, SF)
    assert len(calls) == 1
