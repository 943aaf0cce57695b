"""Pixel layout (a row for each pixel) and frame layout (a row for each frame, values flat in row, column, band order)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def frames_to_pixels(frames: DataFrame) -> DataFrame:
    """keys, h, w, d, data -> keys, y, x, bands."""
    keys = [c for c in frames.columns if c not in ("h", "w", "d", "data")]
    at = frames.select(*keys, "w", "d", "data", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("i"))
    return at.select(*keys, F.expr("i div w").cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), F.expr("slice(data, i * d + 1, d)").alias("bands"))


def pixels_to_frames(pixels: DataFrame) -> DataFrame:
    """keys, y, x, bands -> keys, h, w, d, data; every pixel of a frame must be there once."""
    keys = [c for c in pixels.columns if c not in ("y", "x", "bands")]
    rows = pixels.groupBy(*keys).agg(
        (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.max(F.size("bands")).alias("d"), F.array_sort(F.collect_list(F.struct("y", "x", "bands"))).alias("p")
    )
    return rows.select(*keys, "h", "w", "d", F.flatten(F.transform("p", lambda p: p["bands"])).alias("data"))


#: Pixels of an image along each side at most, and buckets in which images are numbered.
SIDE_BITS, BUCKETS = 14, 4096


def with_image_numbers(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with _image, a number for each image (values of keys, nulls too). Images are numbered inside buckets of a hash, so no task sees all of them."""
    images = rows.select(*keys).distinct().withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)).cast("long") - 1
    images = images.withColumn("_image", place * BUCKETS + F.col("_bucket")).drop("_bucket")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return rows.join(images.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_image"), same).drop(*(f"_of_{k}" for k in keys))


def with_pixel_numbers(pixels: DataFrame, keys: Sequence[str], name: str = "node") -> DataFrame:
    """pixels with a number for each pixel of each image, in row order within an image; different pixels never share one."""
    both = with_image_numbers(pixels, keys)
    fits = F.col("y").between(0, (1 << SIDE_BITS) - 1) & F.col("x").between(0, (1 << SIDE_BITS) - 1)
    number = (F.col("_image") * (1 << SIDE_BITS) + F.col("y")) * (1 << SIDE_BITS) + F.col("x")
    return both.withColumn(name, F.when(fits, number).otherwise(F.raise_error(F.lit("an image is too large")))).drop("_image")


def bands_to_rows(pixels: DataFrame) -> DataFrame:
    """keys, bands -> keys, b, v: a row for each band."""
    keys = [c for c in pixels.columns if c != "bands"]
    return pixels.select(*keys, F.posexplode("bands").alias("b", "v"))


def rows_to_bands(rows: DataFrame) -> DataFrame:
    """keys, b, v -> keys, bands."""
    keys = [c for c in rows.columns if c not in ("b", "v")]
    own = F.array_sort(F.collect_list(F.struct("b", "v")))
    return rows.groupBy(*keys).agg(F.transform(own, lambda p: p["v"]).alias("bands"))
