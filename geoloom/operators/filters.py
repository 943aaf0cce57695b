"""Filters over frames, timestamps, values and boxes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.operators.skew import join_by
from geoloom.patchset import PatchSet
from geoloom.session import discard, materialize

FRAME = ["patch_id", "ts"]


def as_ntz(value: str | datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")


def kept_frames(feature: DataFrame, predicate: Column) -> DataFrame:
    """Frames whose aggregate over the feature's rows satisfies the predicate, e.g. F.avg(...) > 0.5."""
    return feature.groupBy(*FRAME).agg(predicate.alias("_keep")).where("_keep").select(*FRAME)


def keep_frames(df: DataFrame, frames: DataFrame, time: str = "ts") -> DataFrame:
    """Rows of those frames: a left semi join."""
    return df.join(frames.select("patch_id", F.col("ts").alias(time)), ["patch_id", time], "left_semi")


def filter_patch_set(patches: PatchSet, frames: DataFrame, features: object = ...) -> PatchSet:
    """All temporal features, vectors included, and the frame table cut to those frames; timeless features stay."""
    from geoloom.spec import Spec

    found = Spec(features).resolve(patches.features)
    out = {}
    for kind, old, new in found:
        df = patches.features[kind, old]
        time = "TIMESTAMP" if kind.is_vector() and "TIMESTAMP" in df.columns else "ts"
        out[kind, new] = keep_frames(df, frames, time) if kind.is_temporal() and time in df.columns else df
    return PatchSet(out, patches.boxes, None if patches.frames is None else keep_frames(patches.frames, frames))


def between_dates(df: DataFrame, start: str | datetime, end: str | datetime, time: str = "ts") -> DataFrame:
    """Both ends included; reaches the scan as a pushed filter."""
    return df.where(F.col(time).between(as_ntz(start), as_ntz(end)))


def at_times(df: DataFrame, times: Sequence[str | datetime]) -> DataFrame:
    return df.where(F.col("ts").isin(*(as_ntz(t) for t in times)) if times else F.lit(False))


def frame_index(df: DataFrame) -> DataFrame:
    """df with t_idx, the number of its frame in the patch from 0."""
    frames = df.select(*FRAME).distinct()
    ranked = frames.withColumn("t_idx", F.row_number().over(Window.partitionBy("patch_id").orderBy("ts")) - 1)
    return df.join(ranked, FRAME)


def at_indices(df: DataFrame, indices: Sequence[int]) -> DataFrame:
    return frame_index(df).where(F.col("t_idx").isin(*indices) if indices else F.lit(False)).drop("t_idx")


def by_times(frames: DataFrame, f: Callable[[list], list]) -> DataFrame:
    """Frames for which f, called with each patch's sorted timestamps, gives True. Groups are the frames of a patch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        return pdf[pd.Series(f([t.to_pydatetime() for t in pdf["ts"]]), index=pdf.index).astype(bool)]

    return frames.select(*FRAME).distinct().groupBy("patch_id").applyInPandas(run, "patch_id long, ts timestamp_ntz")


def removed_frames(df: DataFrame, keep: DataFrame) -> DataFrame:
    """Frames of df that are not to be kept."""
    return df.select(*FRAME).distinct().join(keep.select(*FRAME), FRAME, "left_anti")


def coverage(df: DataFrame, valid: Column) -> DataFrame:
    """patch_id, ts, coverage: the share of valid rows of each frame."""
    return df.groupBy(*FRAME).agg(F.avg(valid.cast("double")).alias("coverage"))


#: Frames of a patch that are followed in one row; longer series go by pointer doubling.
SHORT_SERIES = 16_384


#: Microseconds of ts since 1970, whatever the session's time zone.
MICROS = "date_diff(ts, date'1970-01-01') * 86400000000L + cast((hour(ts) * 3600 + minute(ts) * 60 + extract(SECOND FROM ts)) * 1000000 AS bigint)"


def spaced(frames: DataFrame, seconds: float, short: int = SHORT_SERIES) -> DataFrame:
    """Frames of a patch such that each is more than so many seconds after the last one kept: greedy, in time order.

    Patches of at most `short` frames are folded in one row each. For longer ones every frame finds its successor, the first frame
    more than so many seconds later, and the chain from the first frame is followed by pointer doubling: no row holds a patch.
    Frames without a patch or a time are left out; repeated ones count once.
    """
    if seconds < 0:
        raise ValueError("seconds must not be negative")
    gap = round(seconds * 1_000_000)
    times = frames.select("patch_id", F.expr(MICROS).alias("t")).where("patch_id IS NOT NULL AND t IS NOT NULL").distinct()
    times = materialize(times, "spaced-times")
    long = times.groupBy("patch_id").agg(F.count("*").alias("n")).where(F.col("n") > short).select("patch_id")
    series = times.join(long, "patch_id", "left_anti").groupBy("patch_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    follow = lambda kept, t: F.when((F.size(kept) == 0) | (t > F.element_at(kept, -1) + gap), F.array_append(kept, t)).otherwise(kept)
    kept = series.select("patch_id", F.explode(F.aggregate("ts", F.array().cast("array<bigint>"), follow)).alias("t"))
    if not long.isEmpty():
        kept = kept.unionByName(chains(successors(times.join(long, "patch_id", "left_semi"), gap)))
    back = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(cast(t AS decimal(20, 0)) / 1000000 AS decimal(18, 6)))")
    return kept.select("patch_id", back.alias("ts"))


def successors(times: DataFrame, gap: int) -> DataFrame:
    """patch_id, t, after: the first t of the patch that lies more than gap later, null where there is none.

    A frame looks into the bucket of time, gap long, that t + gap falls in, else at the first frame of the next bucket that has
    any: windows hold the frames of a bucket, or one row for each bucket of a patch.
    """
    size = max(gap, 1)
    bucket = lambda c: F.expr(f"floor({c} / {size})").cast("long")
    probes = times.select("patch_id", (F.col("t") + gap).alias("at"), F.col("t").alias("asks"), F.lit(None).cast("long").alias("t"))
    rows = times.select("patch_id", F.col("t").alias("at"), F.lit(None).cast("long").alias("asks"), "t").unionByName(probes)
    rows = rows.withColumn("bucket", bucket("at"))
    later = Window.partitionBy("patch_id", "bucket").orderBy(F.desc("at"), F.col("asks").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("after", F.last("t", ignorenulls=True).over(later)).where("asks IS NOT NULL")
    firsts = rows.select("patch_id", "bucket", F.lit(None).cast("long").alias("first")).unionByName(times.select("patch_id", bucket("t").alias("bucket"), F.col("t").alias("first")))
    firsts = firsts.groupBy("patch_id", "bucket").agg(F.min("first").alias("first"))
    following = Window.partitionBy("patch_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("patch_id", "bucket", F.last("first", ignorenulls=True).over(following).alias("next"))
    found = rows.where("after IS NOT NULL").select("patch_id", F.col("asks").alias("t"), "after")
    rest = join_by(rows.where("after IS NULL").drop("after"), firsts, ["patch_id", "bucket"], how="left")
    return found.unionByName(rest.select("patch_id", F.col("asks").alias("t"), F.col("next").alias("after")))


def chains(after: DataFrame) -> DataFrame:
    """patch_id, t of the frames that each patch's first frame leads to. Rounds grow with the logarithm of the longest chain.

    After k rounds the frames reached are the first 2^k of the chain, and a jump leads 2^k frames on.
    """
    jumps = materialize(after, "spaced-jumps")
    reached = materialize(jumps.groupBy("patch_id").agg(F.min("t").alias("t")), "spaced-reached")
    count = reached.count()
    while True:
        new = reached.join(jumps, ["patch_id", "t"]).where("after IS NOT NULL").select("patch_id", F.col("after").alias("t"))
        grown = materialize(reached.unionByName(new).distinct(), "spaced-reached")
        discard(reached)
        reached, before, count = grown, count, grown.count()
        if count == before:
            discard(jumps)
            return reached
        ends = jumps.select("patch_id", F.col("t").alias("after"), F.col("after").alias("then"))
        longer = materialize(join_by(jumps, ends, ["patch_id", "after"], how="left").select("patch_id", "t", F.col("then").alias("after")), "spaced-jumps")
        discard(jumps)
        jumps = longer


def with_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def boxes_meet(a: str, b: str) -> Column:
    """Whether the boxes with prefixes a and b (columns a_min_x, ...) share a point."""
    c = lambda p, n: F.col(f"{p}{n}")
    return (c(a, "min_x") <= c(b, "max_x")) & (c(b, "min_x") <= c(a, "max_x")) & (c(a, "min_y") <= c(b, "max_y")) & (c(b, "min_y") <= c(a, "max_y"))


def in_box(df: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Geometries whose own box meets this one; a range predicate that is pushed down."""
    return df.where((F.col("min_x") <= max_x) & (F.col("max_x") >= min_x) & (F.col("min_y") <= max_y) & (F.col("max_y") >= min_y))


def within_time(scenes: DataFrame, requests: DataFrame, seconds: int) -> DataFrame:
    """Scenes and requests of a patch at most so far apart: a range join with a time bucket as equi-key."""
    bucket = lambda t: F.floor(F.unix_seconds(F.col(t).cast("timestamp")) / seconds)
    left = scenes.withColumn("_b", bucket("ts"))
    right = requests.withColumnRenamed("ts", "request_ts").withColumn("_b", F.explode(F.array(*(bucket("request_ts") + k for k in (-1, 0, 1)))))
    near = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("request_ts").cast("timestamp"))) <= seconds * 1_000_000
    return left.join(right, ["patch_id", "_b"]).where(near).drop("_b")
