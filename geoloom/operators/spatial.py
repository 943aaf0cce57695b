"""A spatial join of boxes as equi-joins.

A box lives at the level whose square cells are just larger than it, in the one to four cells that it touches, so small and large
boxes never share a grid. It also looks into the cells that it touches at every coarser level that has boxes. Two boxes meet in a
cell of the larger one's level; of the up to four cells that both touch, the one that holds the lower left corner of what they
share reports them, so no pair comes twice. The work follows the boxes and the pairs of boxes of like places, not all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("min_x", "min_y", "max_x", "max_y")
#: Levels: cells of level k have 2^-k of the side of all boxes' square.
DEEPEST = 30


def cell(v: Column, origin: float, span: float, level: Column) -> Column:
    """Number of the cell along an axis; halving cells halves numbers exactly, as only powers of two are multiplied."""
    return F.floor((v - F.lit(origin)) / F.lit(span) * F.pow(F.lit(2.0), level)).cast("long")


def at_levels(boxes: DataFrame, levels: Column, origin: tuple[float, float], span: float) -> DataFrame:
    """boxes with a row for each of the levels and cells (cx, cy) that they touch."""
    rows = boxes.select("*", F.explode(levels).alias("at"))
    for c, o in zip("xy", origin, strict=True):
        rows = rows.withColumn(f"c{c}", F.explode(F.sequence(cell(F.col(f"min_{c}"), o, span, F.col("at")), cell(F.col(f"max_{c}"), o, span, F.col("at")))))
    return rows


def boxes_that_meet(a: DataFrame, b: DataFrame | None = None, keys: Sequence[str] = (), row: str = "row") -> DataFrame:
    """keys, a and b: the rows of a and of b whose boxes share a point, borders included, and whose keys are equal.

    a and b: keys, row, min_x, min_y, max_x, max_y. Without b the pairs of a with itself, the smaller row as a. Boxes with null,
    NaN or infinite sides, or whose sides are in the wrong order, meet nothing, nor do rows without a row number.
    """
    own = lambda df: df.select(*keys, F.col(row).alias("row"), *(F.col(c).cast("double").alias(c) for c in BOX)).where(" and ".join(f"abs({c}) < double('infinity')" for c in BOX) + " and min_x <= max_x and min_y <= max_y and row is not null")
    sides = [own(a), *([own(b)] if b is not None else [])]
    whole = sides[0] if b is None else sides[0].unionByName(sides[1])
    low_x, low_y, high_x, high_y = whole.agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
    out = [*keys, "a", "b"]
    if low_x is None:
        kind = a.schema[row].dataType
        return whole.select(*keys, F.col("row").cast(kind).alias("a"), F.col("row").cast(kind).alias("b"))
    span, origin = max(high_x - low_x, high_y - low_y) or 1.0, (low_x, low_y)
    size = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    level = F.least(F.when(size > 0, F.floor(F.log2(F.lit(span) / size))).otherwise(DEEPEST), F.lit(DEEPEST)).cast("int")
    sides = [s.withColumn("level", F.greatest(level, F.lit(0))) for s in sides]
    levels = sorted(r[0] for r in (sides[0] if b is None else sides[0].unionByName(sides[1])).select("level").distinct().collect())  # DEEPEST + 1 at most
    coarser = F.filter(F.array(*(F.lit(k) for k in levels)), lambda k: k <= F.col("level"))

    def met(home: DataFrame, guests: DataFrame, also: Column) -> DataFrame:
        """Pairs of a home box (a) and a guest (b) of its level or finer."""
        one = at_levels(home, F.array("level"), origin, span).select(*keys, "at", "cx", "cy", F.col("row").alias("a"), F.col("level").alias("_level"), *(F.col(c).alias(f"_{c}") for c in BOX))
        two = at_levels(guests, coarser, origin, span).withColumnRenamed("row", "b")
        both = one.join(two, [*keys, "at", "cx", "cy"])
        share = (F.col("_min_x") <= F.col("max_x")) & (F.col("min_x") <= F.col("_max_x")) & (F.col("_min_y") <= F.col("max_y")) & (F.col("min_y") <= F.col("_max_y"))
        corner = [cell(F.greatest(f"_min_{c}", f"min_{c}"), o, span, F.col("at")) == F.col(f"c{c}") for c, o in zip("xy", origin, strict=True)]
        return both.where(share & corner[0] & corner[1] & also).select(out)

    finer, equal = F.col("level") > F.col("_level"), F.col("level") == F.col("_level")
    if b is None:
        found = met(sides[0], sides[0], (F.col("a") != F.col("b")) & (finer | equal & (F.col("a") < F.col("b"))))
        return found.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    turned = met(sides[1], sides[0], finer).select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    return met(sides[0], sides[1], finer | equal).unionByName(turned)
