"""Queries: reports of runs, file names, workflows, the store, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.bridge import EVENTS, events, images, lines, pixels, table
from geoloom.catalog import query
from geoloom.operators import filters, projection
from geoloom.patchset import PatchSet
from geoloom.plans import executor
from geoloom.plans.workflow import Input, Node, Output, Workflow
from geoloom.session import shared_dir
from geoloom.sources import files, imagery, store
from geoloom.streaming import frames as streams
from geoloom.types import FeatureType


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as nodes of runs: each user is a run, each kind of event a node."""
    return events(spark, d).select(F.col("patch_id").alias("run_group"), F.col("event_type").alias("node"), F.col("v").alias("seconds"), F.col("event_type").isin("error").alias("failed"))


@query("SELECT count(*) FILTER (WHERE event_type <> 'error') AS finished, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return executor.run_counts(runs(spark, d))


@query("SELECT event_type AS node, count(*) AS n, round(min(value), 4) AS least, round(max(value), 4) AS most, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS deviation FROM events GROUP BY ALL")
def node_durations(spark: SparkSession, d: str) -> DataFrame:
    out = executor.durations(runs(spark, d))
    return out.select("node", "n", *(F.round(c, 4).alias(c) for c in ("least", "most", "mean", "deviation")))


@query("SELECT event_type AS node, 'k' || (user_id % 3) AS origin, len(list(DISTINCT user_id)) AS runs FROM events WHERE event_type IN ('error', 'view') GROUP BY ALL")
def error_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("node"), F.concat(F.lit("k"), (F.col("user_id") % 3).cast("string")).alias("origin"), F.col("event_type").isin("error", "view").alias("failed")).distinct()
    return executor.grouped_errors(rows).select("node", "origin", F.size("runs").cast("long").alias("runs"))


@query("SELECT l_returnflag AS truth, l_linestatus AS predicted, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS value FROM lineitem GROUP BY l_returnflag, l_linestatus")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("truth"), F.col("l_linestatus").alias("predicted"))
    return executor.confusion(pairs, "truth", "predicted").withColumn("value", F.round("value", 6))


@query(f"SELECT event_id, 'scene_' || strftime(ts, '%Y%m%dT%H%M%S') || '_' || strftime(ts, '%Y') || '.tif' AS name FROM {EVENTS}")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", files.file_name("scene_*_%Y", F.col("ts")).alias("name"))


@query("SELECT l_suppkey AS patch_id, count(*) AS n, round(avg(l_discount - l_tax), 5) AS v FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def workflow_plan(spark: SparkSession, d: str) -> DataFrame:
    """A workflow of four operators that becomes one plan."""
    source = Node(Input(), name="lines")
    kept = Node(lambda df: df.where("flag <> 'N'"), [source], "keep")
    level = Node(lambda df: projection.zip_features([df], ["patch_id"], lambda b: F.array(F.element_at(b, 3) - F.element_at(b, 4))), [kept], "difference")
    mean = Node(lambda df: df.groupBy("patch_id").agg(F.count("*").alias("n"), F.round(F.avg(F.element_at("bands", 1)), 5).alias("v")), [level], "mean")
    out = Node(Output("levels"), [mean])
    return Workflow.from_ends(out).execute({source: {"value": lines(spark, d)}}).outputs["levels"]


def _stored(spark: SparkSession, d: str) -> str:
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    px = events(spark, d).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    daily = px.groupBy("patch_id", "ts", "y", "x").agg(F.array(F.round(F.avg("v"), 6)).alias("bands"))
    patches = PatchSet({(FeatureType.DATA, "daily"): daily}, frames=daily.select("patch_id", "ts").distinct())
    store.save(patches, root)
    return root


@query(f"SELECT patch_id, date_trunc('day', ts) AS ts, y, x, round(avg(v), 5) AS v FROM {EVENTS} WHERE patch_id IN (0, 2) AND ts >= TIMESTAMP '2024-01-10' GROUP BY ALL")
def save_load(spark: SparkSession, d: str) -> DataFrame:
    """Saved, then read back in part: two patches, later frames."""
    back = store.load(spark, _stored(spark, d), [FeatureType.DATA], [0, 2], F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return back[FeatureType.DATA, "daily"].select("patch_id", "ts", "y", "x", F.round(F.element_at("bands", 1), 5).alias("v"))


@query("""
SELECT CAST(p AS BIGINT) AS patch_id, TIMESTAMP '2024-01-01' + INTERVAL 5 DAY * k AS ts, (p * 37 + k * 53) % 101 / 100 AS cover, 192 AS values
FROM (SELECT unnest(range(0, 3)) AS p), (SELECT unnest(range(0, 7)) AS k) WHERE (p * 37 + k * 53) % 101 / 100 <= 0.4""")
def scene_source(spark: SparkSession, d: str) -> DataFrame:
    imagery.register(spark)
    scenes = spark.read.format("geoloom_scenes").options(start="2024-01-01", end="2024-02-01", patches="3", maxcc="0.6").load()
    return scenes.where("cover <= 0.4").select("patch_id", "ts", "cover", F.size("data").alias("values"))


@query("SELECT vec_id AS patch_id, 8 AS h, 8 AS w, 1 AS d, round(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE))), 3) AS total FROM embeddings")
def tiff_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Images as TIFF files and read again."""
    px = pixels(spark, d).select("patch_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("d"), F.col("bands").alias("data"))
    images_ = files.to_tiff(px)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            arrays = [files.tiff_array(t) for t in pdf["tiff"]]
            yield pd.DataFrame([(p, *a.shape, float(a.astype(float).sum())) for p, a in zip(pdf["patch_id"], arrays, strict=True)], columns=["patch_id", "h", "w", "d", "total"])

    return images_.mapInPandas(run, "patch_id long, h int, w int, d int, total double").withColumn("total", F.round("total", 3))


@query(f"SELECT patch_id, time_bucket(INTERVAL 1 DAY, ts) AS start, round(avg(v), 5) AS mean, count(v) AS n FROM {EVENTS} GROUP BY ALL")
def stream_window_means(spark: SparkSession, d: str) -> DataFrame:
    """Daily means of a stream of events, run until the stream has no more."""
    name = f"means_{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    rows = streams.stream_of(spark, f"{d}/events.parq*", schema)
    rows = rows.select(F.expr("user_id div 50").alias("patch_id"), "ts", F.col("value").alias("v"))
    done = streams.window_means(rows, "1 day").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.table(name).select("patch_id", F.col("start").cast("timestamp_ntz").alias("start"), F.round("mean", 5).alias("mean"), "n")


@query("SELECT vec_id AS patch_id, 8 AS height, 8 AS width FROM embeddings")
def spatial_size(spark: SparkSession, d: str) -> DataFrame:
    px = images(spark, d).select("patch_id", "y", "x", F.array("v").alias("bands"))
    return PatchSet({(FeatureType.DATA_TIMELESS, "image"): px}).spatial_size((FeatureType.DATA_TIMELESS, "image"))


@query(f"SELECT patch_id, date_trunc('day', ts) AS ts, round(avg(CAST(event_type <> 'error' AS DOUBLE)), 5) AS coverage FROM {EVENTS} GROUP BY ALL")
def frame_coverage(spark: SparkSession, d: str) -> DataFrame:
    px = events(spark, d).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return filters.coverage(px, F.col("event_type") != "error").withColumn("coverage", F.round("coverage", 5))
