"""The test tables seen as patches. Each view has the same definition in DataFrame and in DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of irregular time series: three or more patches of 5 by 10 pixels."""
    user = F.col("user_id")
    return table(spark, d, "events").select(
        "event_id", F.expr("user_id div 50").alias("patch_id"), F.expr("(user_id % 50) div 10").cast("int").alias("y"), (user % 10).cast("int").alias("x"), "ts", F.col("value").alias("v"), "event_type", "props"
    )


EVENTS = "(SELECT event_id, user_id // 50 AS patch_id, CAST((user_id % 50) // 10 AS INT) AS y, CAST(user_id % 10 AS INT) AS x, ts, value AS v, event_type, props FROM events)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Frames with four bands: a patch for each supplier, a frame for each day."""
    bands = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("patch_id"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", bands.alias("bands"), F.col("l_returnflag").alias("flag"))


LINES = "(SELECT l_suppkey AS patch_id, l_shipdate AS ts, l_orderkey, l_linenumber, [l_quantity, l_extendedprice, l_discount, l_tax] AS bands, l_returnflag AS flag FROM lineitem)"


def images(spark: SparkSession, d: str) -> DataFrame:
    """Images of 8 by 8 pixels with one value."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("patch_id"), "label", F.posexplode("embedding").alias("i", "v"))
    return rows.select("patch_id", "label", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


IMAGES = "(SELECT vec_id AS patch_id, label, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


def classes(spark: SparkSession, d: str) -> DataFrame:
    """Images of small whole numbers 0 to 3."""
    return images(spark, d).withColumn("v", F.pmod(F.floor(F.col("v") * 6), F.lit(4)).cast("int"))


CLASSES = f"(SELECT patch_id, label, y, x, CAST((CAST(floor(v * 6) AS BIGINT) % 4 + 4) % 4 AS INT) AS v FROM {IMAGES})"


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """One pixel with 64 bands for each vector."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("patch_id"), "label", F.col("embedding").cast("array<double>").alias("bands"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping rectangles of nations on a map of 6 by 6."""
    k = F.col("n_nationkey")
    x, y = (k % 5).cast("double"), F.expr("n_nationkey div 5").cast("double")
    return table(spark, d, "nation").select(F.lit(0).cast("long").alias("patch_id"), k.alias("row"), (k + 1).alias("value"), x.alias("min_x"), y.alias("min_y"), (x + 1.5).alias("max_x"), (y + 1.5).alias("max_y"))


BOXES = "(SELECT n_nationkey AS row, n_nationkey + 1 AS value, CAST(n_nationkey % 5 AS DOUBLE) AS min_x, CAST(n_nationkey // 5 AS DOUBLE) AS min_y, CAST(n_nationkey % 5 + 1.5 AS DOUBLE) AS max_x, CAST(n_nationkey // 5 + 1.5 AS DOUBLE) AS max_y FROM nation)"


def map_box(spark: SparkSession, height: int = 11, width: int = 11) -> DataFrame:
    return spark.createDataFrame([(0, 0.0, 0.0, 6.0, 6.0, height, width)], "patch_id long, min_x double, min_y double, max_x double, max_y double, height int, width int")
