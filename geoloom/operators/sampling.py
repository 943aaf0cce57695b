"""Sampling of pixels and blocks. The choice comes from a hash of the seed and the pixel, so it survives retries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Multipliers of the pixels' hash and its modulus (fixed values; DuckDB can compute the same).
MIX = (7919, 104_729, 1_299_709, 15_485_863)
MODULUS = 1_000_003


def draw(seed: int, patch: Column | str = "patch_id", y: Column | str = "y", x: Column | str = "x") -> Column:
    """A number below MODULUS for each pixel, from arithmetic that any SQL engine shares."""
    a = F.pmod(F.lit(seed) * MIX[0] + F.col(patch).cast("long") * MIX[1] + F.col(y).cast("long") * MIX[2] + F.col(x).cast("long") * MIX[3], F.lit(MODULUS))
    return F.pmod(a * a + a * 31 + 17, F.lit(MODULUS))


def sample_by_values(image: DataFrame, amounts: dict[int, int] | Column, seed: int = 0, value: str = "v", keys: Sequence[str] = ("patch_id",)) -> DataFrame:
    """Pixels of each patch and value: as many as amounts says for the value (a dict, or a column), without replacement."""
    if isinstance(amounts, dict):
        pairs = [F.lit(z) for kv in amounts.items() for z in kv]
        amounts = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(value)), F.lit(0)) if pairs else F.lit(0)
    order = Window.partitionBy(*keys, value).orderBy(draw(seed), "y", "x")
    return image.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= amounts).drop("_r")


def sample_with_replacement(image: DataFrame, amount: Column | int, seed: int = 0, value: str = "v", keys: Sequence[str] = ("patch_id",)) -> DataFrame:
    """`amount` draws from the pixels of each patch and value (a column: its greatest value there); pixels may come again."""
    group = [*keys, value]
    ranked = image.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("y", "x")) - 1)
    amount = F.lit(amount) if isinstance(amount, int) else amount
    sizes = image.groupBy(*group).agg(F.count("*").alias("_n"), F.max(amount).cast("int").alias("_amount")).where("_amount > 0")
    draws = sizes.select(*group, "_n", F.explode(F.sequence(F.lit(1), "_amount")).alias("draw"))
    draws = draws.withColumn("_r", F.pmod(F.xxhash64(F.lit(seed), *group, "draw"), F.col("_n")).cast("int"))
    return draws.drop("_n").join(ranked, [*group, "_r"]).drop("_r")


def class_counts(image: DataFrame, keys: Sequence[str] = ("patch_id",), value: str = "v") -> DataFrame:
    return image.groupBy(*keys, value).agg(F.count("*").alias("n"))


def fraction_amounts(image: DataFrame, fraction: float | dict[int, float], exclude: Sequence[int] = (), keys: Sequence[str] = ("patch_id",), value: str = "v") -> DataFrame:
    """How many pixels of each value to take: round half to even of count * fraction."""
    if isinstance(fraction, dict):
        if any(not f >= 0 for f in fraction.values()):
            raise ValueError("fractions are at least 0")
        share = F.coalesce(F.try_element_at(F.create_map(*(F.lit(z) for kv in fraction.items() for z in kv)), F.col(value)), F.lit(0.0))
    else:
        if not 0 <= fraction:
            raise ValueError("a fraction is at least 0")
        share = F.lit(float(fraction))
    counts = class_counts(image, keys, value)
    counts = counts.where(~F.col(value).isin(*exclude)) if exclude else counts
    return counts.withColumn("amount", F.bround(F.col("n") * share).cast("int"))


def fraction_sample(image: DataFrame, fraction: float | dict[int, float], exclude: Sequence[int] = (), seed: int = 0, replace: bool = False, keys: Sequence[str] = ("patch_id",), value: str = "v") -> DataFrame:
    """A stratified sample: the same share of each value's pixels."""
    amounts = fraction_amounts(image, fraction, exclude, keys, value)
    joined = image.join(amounts.select(*keys, value, "amount"), [*keys, value])
    if replace:
        return sample_with_replacement(joined, F.col("amount"), seed, value, keys).drop("amount")
    return sample_by_values(joined, F.col("amount"), seed, value, keys).drop("amount")


def expand_to_grids(anchors: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel of the block below and right of each anchor; dy and dx say where in the block."""
    rows = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(height * width - 1))).alias("_i"))
    rows = rows.withColumns({"dy": F.expr(f"_i div {width}").cast("int"), "dx": (F.col("_i") % width).cast("int")}).drop("_i")
    return rows.withColumns({"y": F.col("y") + F.col("dy"), "x": F.col("x") + F.col("dx")})


def block_anchors(sizes: DataFrame, height: int, width: int) -> DataFrame:
    """Every place of a block inside the patch. sizes: patch_id, height, width."""
    fits = sizes.where((F.col("height") >= height) & (F.col("width") >= width))
    h, w = F.col("height") - height + 1, F.col("width") - width + 1
    rows = fits.select("patch_id", w.alias("_w"), F.explode(F.sequence(F.lit(0), h * w - 1)).alias("_i"))
    return rows.select("patch_id", F.expr("_i div _w").cast("int").alias("y"), (F.col("_i") % F.col("_w")).cast("int").alias("x"))


def block_sample(sizes: DataFrame, amount: int | float, height: int = 1, width: int = 1, seed: int = 0) -> DataFrame:
    """Anchors of randomly chosen blocks: a number of them (int) or a share of all places (float)."""
    anchors = block_anchors(sizes, height, width).withColumn("v", F.lit(0))
    if isinstance(amount, int):
        return sample_by_values(anchors, {0: amount}, seed).drop("v")
    return fraction_sample(anchors, amount, seed=seed).drop("v")


def grid_sample(df: DataFrame, height: int = 1, width: int = 1, stride_y: int = 1, stride_x: int = 1) -> DataFrame:
    """Pixels of a regular grid of blocks that lie in the patch whole, with the block's anchor."""
    sizes = df.groupBy("patch_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    anchors = block_anchors(sizes, height, width).where((F.col("y") % stride_y == 0) & (F.col("x") % stride_x == 0))
    places = expand_to_grids(anchors.select("patch_id", "y", "x", F.col("y").alias("anchor_y"), F.col("x").alias("anchor_x")), height, width).drop("dy", "dx")
    return df.join(places, ["patch_id", "y", "x"])


def apply_sample(feature: DataFrame, places: DataFrame) -> DataFrame:
    """The feature's rows at the sampled pixels, once for each time a pixel was drawn."""
    return feature.join(places, ["patch_id", "y", "x"])


def mask_of_samples(grid: DataFrame, places: DataFrame) -> DataFrame:
    """How often each pixel of the grid was drawn."""
    drawn = places.groupBy("patch_id", "y", "x").agg(F.count("*").alias("n"))
    return grid.select("patch_id", "y", "x").join(drawn, ["patch_id", "y", "x"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def point_in_triangle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, r1: Column, r2: Column) -> tuple[Column, Column]:
    """The point of a triangle that two numbers between 0 and 1 choose, uniformly."""
    s = F.sqrt(r1)
    return (1 - s) * ax + s * (1 - r2) * bx + s * r2 * cx, (1 - s) * ay + s * (1 - r2) * by + s * r2 * cy
