"""Frames that arrive as a stream: means of time windows with a watermark, and filling of gaps with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def stream_of(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_means(frames: DataFrame, length: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Mean and number of values of each patch and window; rows later than the watermark are left out."""
    timed = frames.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    window = F.window("time", length, slide) if slide else F.window("time", length)
    grouped = timed.groupBy("patch_id", window.alias("w")).agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
    return grouped.select("patch_id", F.col("w.start").alias("start"), "mean", "n")


def sessions(frames: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Bursts of frames of a patch with no longer gap in between."""
    timed = frames.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    grouped = timed.groupBy("patch_id", F.session_window("time", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("patch_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def carry_forward(frames: DataFrame) -> DataFrame:
    """A value for every row: its own, or its pixel's last one. State is one value for each pixel.

    Rows of one micro-batch are put in time order; a row that comes in a later batch than its successors sees the last value
    there was.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for v in rows["v"]:
            last = v if v == v and v is not None else last
            out.append(last)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"patch_id": key[0], "y": key[1], "x": key[2], "ts": rows["ts"], "v": out})

    ddl = "patch_id long, y int, x int, ts timestamp, v double"
    rows = frames.select("patch_id", "y", "x", F.col("ts").cast("timestamp").alias("ts"), "v")
    return rows.groupBy("patch_id", "y", "x").applyInPandasWithState(run, ddl, "v double", "append", GroupStateTimeout.NoTimeout)
