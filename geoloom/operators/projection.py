"""Operators that rearrange bands and pixels: column expressions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """v, or null where it is NaN or infinite."""
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def number(v: Column) -> Column:
    """v, or null where it is NaN."""
    return F.nanvl(v.cast("double"), F.lit(None))


def gathered(bands: Column | str, at: Sequence[int]) -> Column:
    """The bands at these places; a place that doesn't exist is an error."""
    return F.array(*(F.element_at(bands, i + 1) for i in at))


def extract_bands(df: DataFrame, at: Sequence[int], out: str = "bands") -> DataFrame:
    return df.withColumn(out, gathered("bands", at))


def explode_bands(df: DataFrame, outputs: dict[str, int | Sequence[int]]) -> dict[str, DataFrame]:
    """One feature for each name, with the band or bands given for it."""
    return {name: extract_bands(df, [at] if isinstance(at, int) else list(at)) for name, at in outputs.items()}


def aligned(features: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Features side by side as columns bands0, bands1, ...: an equi-join on the pixels' keys."""
    named = [df.select(*keys, F.col("bands").alias(f"bands{i}")) for i, df in enumerate(features)]
    return reduce(lambda a, b: a.join(b, list(keys)), named)


def zip_features(features: Sequence[DataFrame], keys: Sequence[str], f: Callable[..., Column]) -> DataFrame:
    """One feature from several: f gets each feature's bands."""
    both = aligned(features, keys)
    return both.select(*keys, f(*(F.col(f"bands{i}") for i in range(len(features)))).alias("bands"))


def map_bands(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn("bands", F.transform("bands", f))


def merge_bands(features: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Bands of all features one after the other."""
    return zip_features(features, keys, lambda *b: F.concat(*b))


def merge_frames(features: Sequence[DataFrame]) -> DataFrame:
    """Frames of all features."""
    return reduce(DataFrame.unionByName, features)


def merge_space(features: Sequence[DataFrame], axis: str, sizes: Sequence[int]) -> DataFrame:
    """Features beside each other along y or x; sizes are their extents on that axis."""
    at, out = 0, []
    for df, size in zip(features, sizes, strict=True):
        out.append(df.withColumn(axis, F.col(axis) + at))
        at += size
    return merge_frames(out)


def initialize(spark: SparkSession, patches: DataFrame, height: int, width: int, bands: int, value: float = 0, frames: DataFrame | None = None, dtype: str = "int") -> DataFrame:
    """A constant feature: a pixel grid for each patch (and frame), made by sequences, not by a join."""
    base = patches.select("patch_id") if frames is None else frames.select("patch_id", "ts")
    grid = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(height * width - 1))).alias("i"))
    keys = base.columns
    return grid.select(*keys, F.expr(f"i div {width}").cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), F.array_repeat(F.lit(value).cast(dtype), bands).alias("bands"))


def initialize_like(df: DataFrame, value: float = 0, dtype: str = "int") -> DataFrame:
    return df.withColumn("bands", F.transform("bands", lambda _: F.lit(value).cast(dtype)))


def normalized_difference(a: Column, b: Column, constant: float = 0.0, undefined: float | None = None) -> Column:
    """(a - b + c) / (a + b + c); where that isn't finite, the undefined value (null stands for missing)."""
    ratio = finite(F.try_divide(a - b + constant, a + b + constant))
    return ratio if undefined is None else F.coalesce(ratio, F.lit(float(undefined)))


def ndi(df: DataFrame, bands: tuple[int, int], constant: float = 0.0, undefined: float | None = None) -> DataFrame:
    a, b = (F.element_at("bands", i + 1).cast("double") for i in bands)
    return df.withColumn("bands", F.array(normalized_difference(a, b, constant, undefined)))


def cast_within(v: Column, low: int, high: int, dtype: str) -> Column:
    """v rounded half to even and clipped to the range of whole numbers."""
    return F.least(F.greatest(F.bround(v), F.lit(float(low))), F.lit(float(high))).cast(dtype)


def bands_to_channels(df: DataFrame) -> DataFrame:
    """Image channels of a temporal feature: frame after frame, band after band. Keys stay; channel = t_idx * d + b."""
    from pyspark.sql.window import Window

    t = F.dense_rank().over(Window.partitionBy("patch_id").orderBy("ts")) - 1
    rows = df.withColumn("t_idx", t).select("patch_id", "t_idx", *(c for c in ("y", "x") if c in df.columns), F.size("bands").alias("d"), F.posexplode("bands").alias("b", "v"))
    return rows.withColumn("channel", F.col("t_idx") * F.col("d") + F.col("b")).drop("t_idx", "d", "b")


def channels_to_bands(df: DataFrame, bands: int) -> DataFrame:
    """The frame index and band of each image channel; the number of channels must be a multiple of bands."""
    return df.select("*", F.expr(f"channel div {bands}").alias("t_idx"), (F.col("channel") % bands).alias("b")).drop("channel")


def rgb(df: DataFrame, bands: Sequence[int] = (2, 1, 0), gain: float = 3.5) -> DataFrame:
    """Bands for display: scaled and clipped to 0 to 1."""
    return df.withColumn("bands", F.transform(gathered("bands", bands), lambda v: F.least(F.greatest(v * gain, F.lit(0.0)), F.lit(1.0))))
