"""Operators over neighbouring pixels. Rows are keys (patch_id, ts if temporal, y, x, b if banded) and v.

Morphology, means over an element, erosion of labels and resizing work on tiles that exchange their borders (operators.tiles).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.operators import tiles
from geoloom.operators.projection import cast_within, number
from geoloom.operators.tiles import Offsets
from geoloom.types import INTEGER_RANGES


def ellipse(rows: int, cols: int) -> Offsets:
    """Offsets (dy, dx) of an elliptic element with its anchor in the middle."""
    r, c = rows // 2, cols // 2
    out = []
    for i in range(rows):
        dy = i - r
        dx = round(c * (((r * r - dy * dy) / (r * r)) ** 0.5)) if r else c
        out += [(dy, j - c) for j in range(max(c - dx, 0), min(c + dx + 1, cols))]
    return out


def disk(size: int) -> Offsets:
    """An ellipse `size` pixels high and wide (so 1 is the pixel itself and 3 a plus)."""
    return ellipse(size, size)


def rectangle(width: int, height: int) -> Offsets:
    """`width` rows of `height` columns."""
    return [(i - width // 2, j - height // 2) for i in range(width) for j in range(height)]


def square(size: int) -> Offsets:
    return rectangle(size, size)


def focal(df: DataFrame, offsets: Offsets, how: str) -> DataFrame:
    """Each pixel's max, min or avg over the pixels at the offsets around it; what lies outside the image doesn't count."""
    if how not in ("max", "min", "avg"):
        raise ValueError(f"unknown aggregate: {how}")
    if how == "avg":
        return tiles.tile_map(df.withColumn("v", F.col("v").cast("double")), tiles.reach_of(offsets), lambda v, there, known: tiles.mean(v, known, offsets))
    return tiles.tile_map(df, tiles.reach_of(offsets), lambda v, there, known: tiles.extreme(v, known, offsets, how == "max"))


def morphology(df: DataFrame, offsets: Offsets | None = None, how: str = "dilation") -> DataFrame:
    """Grey-scale dilation, erosion, opening or closing; 3 by 3 without an element. Opening and closing exchange borders once."""
    offsets = square(3) if offsets is None else offsets
    steps = {"dilation": [True], "erosion": [False], "opening": [False, True], "closing": [True, False]}
    if how not in steps:
        raise ValueError(f"unknown operation: {how}")

    def kernel(v, there, known):
        for largest in steps[how]:
            v, known = tiles.extreme(v, known, offsets, largest)
            known = known & there
        return v, known

    return tiles.tile_map(df, len(steps[how]) * tiles.reach_of(offsets), kernel)


def erode_labels(df: DataFrame, disk_size: int = 1, labels: Sequence[int] | None = None, no_data: int = 0) -> DataFrame:
    """Pixels of the labels (all but no_data without a list) become no_data unless the whole disk around has their label."""
    if not isinstance(disk_size, int) or disk_size < 1:
        raise ValueError("the disk's size is a whole number from 1")
    offsets = disk(disk_size)

    def kernel(v, there, known):
        low, high = (tiles.extreme(v, known, offsets, largest)[0] for largest in (False, True))
        chosen = v != no_data if labels is None else np.isin(v, list(labels))
        return np.where(chosen & (low != high), v.dtype.type(no_data), v), known

    return tiles.tile_map(df, tiles.reach_of(offsets), kernel)


def gradient(df: DataFrame) -> DataFrame:
    """Half the absolute 3 by 3 Sobel gradients along x and y, edges repeated by mirroring without the edge pixel."""
    keys = [c for c in df.columns if c not in ("y", "x", "v")]
    sizes = df.groupBy(*keys).agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    weights = [(dy, dx, dx * (2 - abs(dy)), dy * (2 - abs(dx))) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    mirrored = lambda at, last: F.when(at < 0, -at).when(at > last, 2 * last - at).otherwise(at)
    wants = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(gx).alias("gx"), F.lit(gy).alias("gy")) for dy, dx, gx, gy in weights))
    asked = df.join(sizes, keys).select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), "_h", "_w", F.explode(wants).alias("s"))
    asked = asked.select(*keys, "_y", "_x", "s", mirrored(F.col("_y") + F.col("s.dy"), F.col("_h")).alias("y"), mirrored(F.col("_x") + F.col("s.dx"), F.col("_w")).alias("x"))
    sums = asked.join(df, [*keys, "y", "x"]).groupBy(*keys, "_y", "_x").agg(F.sum(F.col("v") * F.col("s.gx")).alias("gx"), F.sum(F.col("v") * F.col("s.gy")).alias("gy"))
    return sums.select(*keys, F.col("_y").alias("y"), F.col("_x").alias("x"), (0.5 * F.abs("gx") + 0.5 * F.abs("gy")).alias("v"))


def padding(size: Column, multiple: int, rule: str) -> tuple[Column, Column]:
    """Pixels before and after that make the size a multiple; `even` puts an odd one after."""
    more = F.pmod(-size, F.lit(multiple))
    before = {"even": F.floor(more / 2).cast("int"), "up": more, "left": more, "down": F.lit(0), "right": F.lit(0)}[rule]
    return before, more - before


def pad(df: DataFrame, multiple_of: tuple[int, int], up_down: str = "even", left_right: str = "even", value: float = 0) -> DataFrame:
    """Images whose height and width are multiples; new pixels have the value."""
    keys = [c for c in df.columns if c not in ("y", "x", "v")]
    sizes = df.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    top, bottom = padding(F.col("h"), multiple_of[0], up_down)
    left, right = padding(F.col("w"), multiple_of[1], left_right)
    sizes = sizes.select(*keys, top.alias("top"), left.alias("left"), (F.col("h") + top + bottom).alias("h"), (F.col("w") + left + right).alias("w"))
    grid = sizes.select(*keys, "w", F.explode(F.sequence(F.lit(0), (F.col("h") * F.col("w") - 1).cast("int"))).alias("i"))
    grid = grid.select(*keys, F.expr("i div w").cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"))
    moved = df.join(sizes.drop("h", "w"), keys).withColumns({"y": (F.col("y") + F.col("top")).cast("int"), "x": (F.col("x") + F.col("left")).cast("int")}).drop("top", "left")
    return grid.join(moved, [*keys, "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(value)))


def resize(df: DataFrame, height: int | Column, width: int | Column, method: str = "linear") -> DataFrame:
    """Images of the new size. nearest: the pixel under the new pixel's corner; linear: four neighbours of its centre; cubic: sixteen.

    height and width may be Columns over the keys, h and w (the old size). Old tiles send new ones what they need.
    """
    if method not in ("nearest", "linear", "cubic"):
        raise ValueError(f"unknown method: {method}")
    height, width = (F.lit(v) if isinstance(v, int) else v for v in (height, width))
    return tiles.resized(df, lambda sizes: sizes.withColumns({"new_h": height, "new_w": width}), method)


def resize_to(df: DataFrame, *, size: tuple[int, int] | None = None, scale: tuple[float, float] | float | None = None, resolution: float | str | None = None, boxes: DataFrame | None = None, method: str = "linear", dtype: str | None = None) -> DataFrame:
    """Images of a new size (height, width), scaled by a factor, or with pixels of a resolution (boxes tell the extent).

    Exactly one of size, scale and resolution is given. dtype: tinyint, smallint, int or bigint round half to even and clip to
    their range; a float dtype is a cast.
    """
    if sum(x is not None for x in (size, scale, resolution)) != 1:
        raise ValueError("give one of size, scale and resolution")
    if size is not None:
        out = resize(df, *size, method=method)
    elif scale is not None:
        sy, sx = scale if isinstance(scale, tuple) else (scale, scale)
        out = resize(df, scaled_size(F.col("h"), sy), scaled_size(F.col("w"), sx), method)
    else:
        if boxes is None:
            raise ValueError("a resolution needs boxes")
        r = parsed_resolution(resolution)
        with_size = df.join(boxes.select("patch_id", size_for_resolution(F.col("min_y"), F.col("max_y"), r).alias("_h"), size_for_resolution(F.col("min_x"), F.col("max_x"), r).alias("_w")), "patch_id")
        out = resize(with_size, F.col("_h"), F.col("_w"), method).drop("_h", "_w")
    if dtype in INTEGER_RANGES:
        return out.withColumn("v", cast_within(F.col("v"), *INTEGER_RANGES[dtype], dtype))
    return out if dtype is None else out.withColumn("v", F.col("v").cast(dtype))


def parsed_resolution(resolution: float | str) -> float:
    """Metres (or units) a pixel, from a number or from text such as `60m`."""
    if not isinstance(resolution, str):
        return float(resolution)
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*m?\s*", resolution)
    if not m:
        raise ValueError(f"not a resolution: {resolution!r}")
    return float(m[1])


def scaled_size(size: Column, factor: float) -> Column:
    return F.bround(size * factor).cast("int")


def size_for_resolution(low: Column, high: Column, resolution: float) -> Column:
    return F.bround((high - low) / resolution).cast("int")


def otsu(df: DataFrame, keys: Sequence[str], bins: int = 16, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """keys and the threshold that separates each frame's values best: the bin edge with most variance between its sides."""
    width = (high - low) / bins
    bin_ = F.least(F.greatest(F.floor((number(F.col("v")) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n")).where("bin is not null")
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    s = F.col("bin") * F.col("n")
    rows = counts.select(*keys, "bin", F.sum("n").over(upto).alias("n0"), F.sum(s).over(upto).alias("s0"), F.sum("n").over(all_).alias("n"), F.sum(s).over(all_).alias("s"))
    n1, s1 = F.col("n") - F.col("n0"), F.col("s") - F.col("s0")
    gap = F.try_divide(F.col("s0").cast("double"), F.col("n0")) - F.try_divide(s1.cast("double"), n1)
    rows = rows.withColumn("between", F.coalesce(F.col("n0") * n1 * gap * gap, F.lit(0.0)))
    best = rows.groupBy(*keys).agg(F.max_by("bin", F.struct(F.round("between", 6), -F.col("bin"))).alias("bin"))
    return best.select(*keys, (F.lit(low) + (F.col("bin") + 1) * width).alias("threshold"))
