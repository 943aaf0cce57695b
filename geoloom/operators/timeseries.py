"""Time series of pixels: gaps, resampling, percentiles. Window expressions wherever a window can say it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions import curves
from geoloom.layout import bands_to_rows, rows_to_bands
from geoloom.operators import long_series
from geoloom.operators.filters import as_ntz
from geoloom.operators.projection import number
from geoloom.patchset import PatchSet
from geoloom.session import materialize
from geoloom.spec import Spec, one_feature

PIXEL = ["patch_id", "y", "x"]


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def deduped(df: DataFrame, keys: Sequence[str] = (*PIXEL, "ts")) -> DataFrame:
    """Mean of the values that share a key; NaN doesn't count."""
    return df.groupBy(*keys).agg(F.avg(number(F.col("v"))).alias("v"))


def scaled_time(df: DataFrame, scale: float = 3600.0, series: Sequence[str] = ("patch_id",)) -> DataFrame:
    """df with t: time since the first frame of the patch in units of `scale` seconds, rounded half to even."""
    first = F.min("ts").over(Window.partitionBy(*series))
    return df.withColumn("t", F.bround((micros(F.col("ts")) - micros(first)) / 1e6 / scale).cast("long"))


def masked(df: DataFrame, valid: Column) -> DataFrame:
    return df.withColumn("v", F.when(valid, number(F.col("v"))))


def line(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    return F.when(t0 == t1, v0).otherwise(v0 + (v1 - v0) * (t - t0) / (t1 - t0))


def neighbours(df: DataFrame, series: Sequence[str]) -> DataFrame:
    """df with the last valid value at or before each row (t0, v0) and the first at or after it (t1, v1).

    One sort by series and time serves both windows.
    """
    order = Window.partitionBy(*series).orderBy("ts")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("v").isNotNull(), F.struct(micros(F.col("ts")).alias("t"), "v"))
    df = df.withColumns({"_0": F.last(point, ignorenulls=True).over(back), "_1": F.first(point, ignorenulls=True).over(ahead)})
    return df.withColumns({"t0": F.col("_0.t"), "v0": F.col("_0.v"), "t1": F.col("_1.t"), "v1": F.col("_1.v")}).drop("_0", "_1")


def fill_linear(df: DataFrame, series: Sequence[str] = PIXEL) -> DataFrame:
    """Missing values by straight lines between valid neighbours in time; outside the first and last valid they stay missing."""
    df = neighbours(df.withColumn("v", number(F.col("v"))), series)
    filled = F.coalesce("v", line(micros(F.col("ts")), F.col("t0"), F.col("v0"), F.col("t1"), F.col("v1")))
    return df.withColumn("v", filled).drop("t0", "v0", "t1", "v1")


def edge_gaps(df: DataFrame, series: Sequence[str] = PIXEL) -> DataFrame:
    """df with `edge`: whether a row lies before the first or after the last valid value of its series."""
    df = neighbours(df.withColumn("v", number(F.col("v"))), series)
    return df.withColumn("edge", F.col("t0").isNull() | F.col("t1").isNull()).drop("t0", "v0", "t1", "v1")


def grid_of(series: DataFrame, start: str | datetime, end: str | datetime, days: int) -> DataFrame:
    """series with ts on a grid of so many days, the end excluded."""
    steps = F.sequence(as_ntz(start), as_ntz(end), F.make_dt_interval(F.lit(days)))
    return series.select("*", F.explode(steps).alias("ts")).where(F.col("ts") < as_ntz(end))


def times_of(series: DataFrame, times: Sequence[str | datetime]) -> DataFrame:
    return series.select("*", F.explode(F.array(*(as_ntz(t) for t in times))).alias("ts"))


def resample(df: DataFrame, targets: DataFrame, kind: str = "linear", series: Sequence[str] = PIXEL) -> DataFrame:
    """Values at the targets' times. kind: linear, nearest (ties to the earlier), previous or next.

    Targets enter the series as rows without a value, so one sort finds each target's neighbours; no range join.
    """
    rows = df.select(*series, "ts", number(F.col("v")).alias("v"), F.lit(False).alias("_target"))
    rows = rows.unionByName(targets.select(*series, "ts", F.lit(None).cast("double").alias("v"), F.lit(True).alias("_target")))
    order = Window.partitionBy(*series).orderBy("ts")
    point = F.when(F.col("v").isNotNull(), F.struct(micros(F.col("ts")).alias("t"), "v"))
    found = rows.withColumns(
        {
            "_a": F.last(point, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0)),
            "_b": F.first(point, ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing)),
        }
    ).where("_target")
    t = micros(F.col("ts"))
    a, b = F.col("_a"), F.col("_b")
    value = {
        "linear": line(t, a["t"], a["v"], b["t"], b["v"]),
        "nearest": F.when(a.isNotNull() & b.isNotNull(), F.when(t - a["t"] <= b["t"] - t, a["v"]).otherwise(b["v"])),
        "previous": a["v"],
        "next": b["v"],
    }[kind]
    return found.select(*series, "ts", value.alias("v"))


def clipped(v: Column, low: float, high: float, unknown: float | None = None) -> Column:
    """v within low and high; the unknown value where it is missing."""
    inside = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))
    return inside if unknown is None else F.coalesce(inside, F.lit(float(unknown)))


def percentile(df: DataFrame, p: float, keys: Sequence[str] = PIXEL, method: str = "linear") -> DataFrame:
    """The p-th percentile of each key's values, 0 to 100; NaN doesn't count. method: linear, nearest, lower or higher."""
    v = number(F.col("v"))
    if method == "linear":
        return df.groupBy(*keys).agg(F.percentile(v, p / 100).alias("v"))
    rounding = {"nearest": F.bround, "lower": F.floor, "higher": F.ceil}[method]
    values = df.groupBy(*keys).agg(F.array_sort(F.collect_list(v)).alias("all"))
    at = rounding(F.lit(p / 100) * (F.size("all") - 1)).cast("int")
    return values.select(*keys, F.get("all", at).alias("v"))


def interpolate(patches: PatchSet, feature: object, kind: str = "linear", mask: object = None, targets: DataFrame | None = None, clip: tuple[float, float] | None = None, unknown: float | None = None, copy: object = ()) -> PatchSet:
    """A patch set with the feature (type, name[, new name]) interpolated over time, and the features to copy.

    In turn: rows that share a time are averaged; values where the mask (a MASK, MASK_TIMELESS or LABEL feature; not zero is
    valid) is zero go; missing values are filled, or values at targets (patch_id, ts) worked out; they are clipped; what is
    still missing takes the unknown value. kind: linear, or with targets nearest, previous, next; or a fitted curve. Copied
    features must not bear the new name.
    """
    kind_of, old, new = one_feature(feature, patches.features)
    copies = Spec(copy).resolve(patches.features)
    if any((k, n) == (kind_of, new) for k, _, n in copies) or len({(k, n) for k, _, n in copies}) < len(copies):
        raise ValueError(f"features to copy clash with {(kind_of, new)} or with each other")
    series = [*PIXEL, "b"]
    rows = bands_to_rows(patches.features[kind_of, old])
    rows = deduped(rows.withColumn("v", F.col("v").cast("double")), [*series, "ts"])
    if mask is not None:
        mask_kind, name, _ = one_feature(mask, patches.features)
        flags = patches.features[mask_kind, name].withColumn("_ok", F.element_at("bands", 1).cast("int") != 0).select(*mask_kind.keys(), "_ok")
        rows = masked(rows.join(flags, mask_kind.keys(), "left"), F.coalesce("_ok", F.lit(False))).drop("_ok")
    if targets is not None:
        targets = rows.select(*series).distinct().join(targets.select("patch_id", "ts").distinct(), "patch_id")
    if kind in curves.KINDS or kind == "akima":
        out = fill_with(rows, kind, targets, series)
    else:
        out = fill_linear(rows, series) if targets is None else resample(rows, targets, kind, series)
    if clip is not None or unknown is not None:
        out = out.withColumn("v", clipped(F.col("v"), *(clip or (float("-inf"), float("inf"))), unknown))
    frames = out.select("patch_id", "ts").distinct()
    return PatchSet({(kind_of, new): rows_to_bands(out), **{(k, n): patches.features[k, o] for k, o, n in copies}}, patches.boxes, frames)


def fill_with(df: DataFrame, kind: str, targets: DataFrame | None = None, series: Sequence[str] = PIXEL, part: int = long_series.PART, **options) -> DataFrame:
    """Values from a fitted curve of each series, at its own rows or at the targets' times; missing outside its valid range.

    kind: cubic, spline, akima or kriging. Values that share a time are averaged. Akima's curve takes windows only. A series of
    up to 2 * part points is a group of its own for the others; longer ones are cut into parts (operators.long_series), but for a
    spline with smoothing, which takes memory in proportion to the series.
    """
    keys, in_place = list(series), targets is None
    t = (micros(F.col("ts")) / 86_400e6).alias("t")
    points = df.where(number(F.col("v")).isNotNull()).groupBy(*keys, "ts").agg(F.avg(number(F.col("v"))).alias("v")).select(*keys, t, "v")
    wanted = df.select(*keys, "ts", t, number(F.col("v")).alias("own")) if in_place else targets.select(*keys, "ts", t, F.lit(None).cast("double").alias("own"))
    if kind == "akima":
        # a lone point's series has no curve: in place its own value stays
        out = long_series.akima(points, wanted, keys)
        return out.select(*keys, "ts", F.coalesce("curve", "own").alias("v"))
    fit = curves.KINDS[kind]
    rows = points.select(*keys, "t", "v", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("double").alias("own"), F.lit(False).alias("asked"))
    rows = rows.unionByName(wanted.withColumns({"v": F.lit(None).cast("double"), "asked": F.lit(True)}))
    names = [*keys, "ts", "v"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known, want = pdf[~pdf["asked"]].sort_values("t"), pdf[pdf["asked"]].copy()
        x, y, at = known["t"].to_numpy(), known["v"].to_numpy(), want["t"].to_numpy()
        if len(x) < 2:
            want["v"] = want["own"].to_numpy()
        elif len(at):
            inside = (at >= x[0]) & (at <= x[-1])
            new = np.full(len(at), np.nan)
            new[inside] = fit(x, y, at[inside], **options)
            want["v"] = new
        want["v"] = want["v"].astype(object).where(want["v"].notna(), None)
        return want[names]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(names).schema)
    if kind == "spline" and options.get("smoothing"):  # its penalty is found over the whole series
        return rows.groupBy(*keys).applyInPandas(run, schema)
    far = materialize(long_series.long_keys(points, keys, 2 * part), "long-series")
    if far.isEmpty():
        return rows.groupBy(*keys).applyInPandas(run, schema)
    short = long_series.same_series(rows, far, keys, "left_anti").groupBy(*keys).applyInPandas(run, schema)
    cut = lambda a: long_series.same_series(a, far, keys, "left_semi")
    if kind == "kriging":
        long = long_series.kriged(cut(points), cut(wanted), keys, part, **options)
    else:
        long = long_series.banded_curve(cut(points), cut(wanted), keys, kind, part, **{k: v for k, v in options.items() if k != "smoothing"})
    return short.unionByName(long.select(*keys, "ts", F.col("curve").alias("v")))
