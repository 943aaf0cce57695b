"""Masks: applying, joining and making them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.projection import normalized_difference, zip_features

JOINS: dict[str, Callable[[Column, Column], Column]] = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b}


def mask_feature(data: DataFrame, mask: DataFrame, keys: Sequence[str], values: Sequence[int], no_data: float | None = None) -> DataFrame:
    """data with no_data where the mask is one of values.

    A mask has as many bands as the data, or one for all. keys are the columns both have: for a timeless mask over temporal
    data they leave out ts, so each mask pixel serves all frames; timeless data can't take a temporal mask.
    """
    if "ts" in mask.columns and "ts" not in data.columns:
        raise ValueError("a temporal mask can't be put over timeless data")
    both = data.join(mask.select(*keys, F.col("bands").alias("_mask")), list(keys))
    hit = lambda i: F.when(F.size("_mask") == 1, F.element_at("_mask", 1)).otherwise(F.get("_mask", i)).isin(*values)
    return both.withColumn("bands", F.transform("bands", lambda v, i: F.when(hit(i), F.lit(no_data).cast("double")).otherwise(v))).drop("_mask")


def join_masks(masks: Sequence[DataFrame], keys: Sequence[str], how: str | Callable[[Column, Column], Column] = "and") -> DataFrame:
    """One mask: a fold over the masks' bands, from the left."""
    if isinstance(how, str) and how not in JOINS:
        raise ValueError(f"unknown way to join masks: {how}")
    f = JOINS[how] if isinstance(how, str) else how
    as_flag = (lambda v: v.cast("boolean")) if isinstance(how, str) else (lambda v: v)
    return zip_features(masks, keys, lambda *b: reduce(lambda x, y: F.zip_with(x, y, f), [F.transform(m, as_flag) for m in b]))


def snow(green: Column, red: Column, nir: Column, swir: Column, ndsi_least: float = 0.4, brightness_least: float = 0.3, undefined: bool = False) -> Column:
    """Snow by normalised snow and vegetation indices and the brightness of the green band; undefined where an index is."""
    ndsi, ndvi = normalized_difference(green, swir), normalized_difference(nir, red)
    return F.coalesce(((ndsi >= ndsi_least) | (F.abs(ndvi - 0.1) < 0.05)) & (green >= brightness_least), F.lit(undefined))


def snow_mask(pixels: DataFrame, bands: Sequence[int], dilation: int = 0, **thresholds) -> DataFrame:
    """keys, v: 1 where pixels (band numbers: green, red, near and short-wave infrared) show snow, grown by a disk of radius `dilation`."""
    from geoloom.operators.neighbourhood import disk, morphology

    flags = pixels.withColumn("v", snow(*(F.element_at("bands", b + 1).cast("double") for b in bands), **thresholds).cast("int")).drop("bands")
    return morphology(flags, disk(2 * dilation + 1), "dilation") if dilation > 0 else flags


def cloud_mask(data: DataFrame, scorer: Callable[[pd.Series], pd.Series] | Column, valid: Column | None = None, bands: Sequence[int] | None = None, average_over: int = 4, threshold: float = 0.4, dilation: int = 2) -> DataFrame:
    """keys, probability and cloud of each pixel.

    scorer gives the probability of cloud from a Series of band arrays (any trained model), or is a column of data that holds it; it is averaged over a disk,
    compared with the threshold, dilated, and false where a pixel isn't valid.
    """
    from geoloom.operators.neighbourhood import disk, focal, morphology
    from geoloom.operators.projection import gathered

    use = F.col("bands") if bands is None else gathered("bands", bands)
    score = scorer.cast("double") if isinstance(scorer, Column) else F.pandas_udf(scorer, "double")(use)
    rows = data.withColumn("v", score).withColumn("_ok", valid if valid is not None else F.lit(True)).drop("bands")
    keys = ["patch_id", "ts", "y", "x"]
    averaged = focal(rows, disk(average_over), "avg") if average_over > 1 else rows
    flags = averaged.withColumns({"probability": F.col("v"), "v": (F.col("v") >= threshold).cast("int")})
    grown = morphology(flags.select(*keys, "v"), disk(dilation), "dilation") if dilation > 1 else flags.select(*keys, "v")
    out = grown.join(flags.select(*keys, "probability"), keys).join(rows.select(*keys, "_ok"), keys)
    return out.select(*keys, F.when(F.col("_ok"), F.col("probability")).otherwise(0.0).alias("probability"), ((F.col("v") == 1) & F.col("_ok")).alias("cloud"))
