"""Vectors: rasterising, vectorising, clipping and reprojecting. A geometry is a row with `ring`, an array of {x, y} points
(the first isn't repeated), and its box in min_x, min_y, max_x, max_y. A column `holes`, an array of rings, and a column `open`,
true where the ring is a line (or a point, which needs no mark), may follow.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def with_box(df: DataFrame) -> DataFrame:
    """df with the box of its rings."""
    c = lambda f, n: f(F.transform("ring", lambda p: p[n]))
    return df.withColumns({"min_x": c(F.array_min, "x"), "min_y": c(F.array_min, "y"), "max_x": c(F.array_max, "x"), "max_y": c(F.array_max, "y")})


def total_box(df: DataFrame, keys: Sequence[str] = ("patch_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def box_ring(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(min_x, min_y), p(max_x, min_y), p(max_x, max_y), p(min_x, max_y))


SIDES = "array<struct<x:double,y:double,dx:double,dy:double,end_y:double,square:double>>"


def sides_of(ring: Column, is_open: Column | None = None) -> Column:
    """The sides of a ring, with their squared lengths. A line (is_open) has no side from its last point to its first."""
    n = F.size(ring)

    def side(a: Column, i: Column) -> Column:
        b = F.get(ring, F.pmod(i + 1, n))
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        return F.struct(a["x"].alias("x"), a["y"].alias("y"), dx.alias("dx"), dy.alias("dy"), b["y"].alias("end_y"), (dx * dx + dy * dy).alias("square"))

    sides = F.transform(ring, side)
    return sides if is_open is None else F.when(F.coalesce(is_open, F.lit(False)) & (n > 1), F.slice(sides, 1, n - 1)).otherwise(sides)


def near_sides(px: Column, py: Column, sides: Column, distance: float) -> Column:
    """Whether a side lies at most so far from the point."""

    def near(s: Column) -> Column:
        along = (px - s["x"]) * s["dx"] + (py - s["y"]) * s["dy"]
        part = F.when(along <= 0, 0.0).when(along >= s["square"], 1.0).otherwise(along / s["square"])  # a side without length is a point
        gx, gy = px - s["x"] - part * s["dx"], py - s["y"] - part * s["dy"]
        return gx * gx + gy * gy <= distance * distance

    return F.exists(sides, near)


def within_sides(px: Column, py: Column, sides: Column) -> Column:
    """Whether the point lies inside: an odd number of sides to its right are crossed."""
    crossed = lambda s: ((s["y"] > py) != (s["end_y"] > py)) & (px < s["dx"] * (py - s["y"]) / s["dy"] + s["x"])
    return F.size(F.filter(sides, crossed)) % 2 == 1


def covers(px: Column, py: Column, buffer: float = 0.0) -> Column:
    """Whether the geometry with columns _sides and _holes (sides of its ring and of all its holes) and _line, grown by a buffer
    (shrunk by a negative one), covers the point.

    Sides that cross count by the even-odd rule, so rings need no repair: a bow tie is its two triangles. A grown geometry
    is the points inside or at most the buffer away from a side, so its corners are round; a shrunk one the points inside and farther
    from each side. Lines and points cover what the buffer reaches. Holes don't overlap each other.
    """
    sides, holes = F.col("_sides"), F.col("_holes")
    at = ~F.col("_line") & within_sides(px, py, sides) & ~within_sides(px, py, holes)
    if not buffer:
        return at
    near = near_sides(px, py, sides, abs(buffer)) | near_sides(px, py, holes, abs(buffer))
    return at | near if buffer > 0 else at & ~near


def covered_pixels(vectors: DataFrame, boxes: DataFrame, buffer: float = 0.0) -> DataFrame:
    """vectors with y, x: a row for each pixel of its patch whose centre the geometry covers, after growing it by the buffer.

    boxes: patch_id, min_x ... max_y, height, width. A ring only visits the pixels of its own box, so the work follows the
    area covered; there is no join of rings and pixels.
    """
    grown = max(buffer, 0.0)
    box = boxes.select("patch_id", F.struct(*(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y", "height", "width"))).alias("_box"))
    is_open = F.coalesce("open", F.lit(False)) if "open" in vectors.columns else F.lit(False)
    holes = F.flatten(F.transform(F.coalesce("holes", F.array().cast(f"array<{RING}>")), lambda r: sides_of(r))) if "holes" in vectors.columns else F.array().cast(SIDES)
    rows = vectors.withColumns({"_sides": sides_of(F.col("ring"), is_open), "_holes": holes, "_line": is_open}).join(box, "patch_id")
    dx, dy = (F.col("_box.max_x") - F.col("_box.min_x")) / F.col("_box.width"), (F.col("_box.max_y") - F.col("_box.min_y")) / F.col("_box.height")
    rows = rows.withColumns({"_dx": dx, "_dy": dy})
    clip = lambda v, top: F.least(F.greatest(v, F.lit(0)), F.col(top) - 1).cast("int")
    rows = rows.withColumns(
        {
            "_x0": clip(F.floor((F.col("min_x") - grown - F.col("_box.min_x")) / F.col("_dx")), "_box.width"), "_x1": clip(F.floor((F.col("max_x") + grown - F.col("_box.min_x")) / F.col("_dx")), "_box.width"),
            "_y0": clip(F.floor((F.col("_box.max_y") - F.col("max_y") - grown) / F.col("_dy")), "_box.height"), "_y1": clip(F.floor((F.col("_box.max_y") - F.col("min_y") + grown) / F.col("_dy")), "_box.height"),
        }
    )
    # the centres come out of the explosion, once for each row and column, rather than out of the test of every side
    py = lambda y: F.col("_box.max_y") - (y + 0.5) * (F.col("_box.max_y") - F.col("_box.min_y")) / F.col("_box.height")
    px = lambda x: F.col("_box.min_x") + (x + 0.5) * (F.col("_box.max_x") - F.col("_box.min_x")) / F.col("_box.width")
    rows = rows.withColumn("_y", F.explode(F.transform(F.sequence("_y0", "_y1"), lambda y: F.struct(y.alias("at"), py(y).alias("p")))))
    rows = rows.withColumn("_x", F.explode(F.transform(F.sequence("_x0", "_x1"), lambda x: F.struct(x.alias("at"), px(x).alias("p")))))
    rows = rows.where(covers(F.col("_x.p"), F.col("_y.p"), buffer)).withColumns({"y": F.col("_y.at"), "x": F.col("_x.at")})
    return rows.drop("_sides", "_holes", "_line", "_box", "_dx", "_dy", "_x0", "_x1", "_y0", "_y1", "_x", "_y")


def rasterize(vectors: DataFrame, boxes: DataFrame, grid: DataFrame, value: str = "value", order: str = "row", no_data: float = 0, overlap: float | None = None, existing: DataFrame | None = None, keys: Sequence[str] = ("patch_id",), buffer: float = 0.0) -> DataFrame:
    """keys, y, x, v for each pixel of the grid: the last geometry by `order` that covers it wins.

    buffer: the distance by which geometries grow, or shrink if negative. overlap: the value of pixels covered by different values; existing: a raster (v) that shows where nothing covers.
    """
    hit = covered_pixels(vectors, boxes, buffer).groupBy(*keys, "y", "x").agg(F.max_by(value, order).alias("_last"), F.count_distinct(value).alias("_n"))
    base = grid if existing is None else existing.withColumnRenamed("v", "_old")
    out = base.join(hit, [*keys, "y", "x"], "left")
    v = F.col("_last") if overlap is None else F.when(F.col("_n") > 1, F.lit(overlap)).otherwise(F.col("_last"))
    return out.select(*keys, "y", "x", F.coalesce(v, F.lit(no_data) if existing is None else F.col("_old")).alias("v"))


def clip_ring(ring: Column, min_x: float, min_y: float, max_x: float, max_y: float) -> Column:
    """The part of a convex or simple ring inside the box: it is cut at each side of the box in turn."""
    for axis, bound, sign in (("x", min_x, 1), ("x", max_x, -1), ("y", min_y, 1), ("y", max_y, -1)):
        ring = cut(ring, axis, float(bound), sign)
    return ring


def cut(ring: Column, axis: str, bound: float, sign: int) -> Column:
    other = "y" if axis == "x" else "x"

    def step(a: Column, b: Column) -> Column:
        in_a, in_b = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
        at = a[other] + (b[other] - a[other]) * (F.lit(bound) - a[axis]) / (b[axis] - a[axis])
        new = {axis: F.lit(bound), other: at}
        meet = F.struct(new["x"].alias("x"), new["y"].alias("y"))
        end = F.struct(b["x"].alias("x"), b["y"].alias("y"))
        return F.when(in_a & in_b, F.array(end)).when(in_a, F.array(meet)).when(in_b, F.array(meet, end)).otherwise(F.array().cast(RING))

    def sides(r: Column) -> Column:
        following = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
        return F.flatten(F.zip_with(r, following, step))

    return F.get(F.transform(F.array(ring), sides), F.lit(0))  # the one-element array names the ring, so that it is made once


EARTH = 6_378_137.0


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return F.radians(lon) * EARTH, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """EPSG:4326 to a zone of UTM, by the series of the transverse Mercator projection up to the sixth power."""
    a, f, k0 = EARTH, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    p, d = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    n = a / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    t, c, q = F.tan(p) * F.tan(p), ep * F.cos(p) * F.cos(p), d * F.cos(p)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * p) - (35 * e2**3 / 3072) * F.sin(6 * p))
    east = k0 * n * (q + (1 - t + c) * F.pow(q, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(q, 5) / 120) + 500_000
    north = k0 * (m + n * F.tan(p) * (q * q / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(q, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(q, 6) / 720))
    return east, north + (10_000_000 if south else 0)


def reproject(df: DataFrame, source: int, target: int) -> DataFrame:
    """df with its rings in another system: WGS 84, Web Mercator and the zones of UTM (as a target)."""
    if source == target:
        return df

    def point(p: Column) -> Column:
        x, y = (p["x"], p["y"]) if source == 4326 else from_web_mercator(p["x"], p["y"])
        if target == 3857:
            x, y = to_web_mercator(x, y)
        elif target != 4326:
            x, y = to_utm(x, y, target % 100, target >= 32_700)
        return F.struct(x.alias("x"), y.alias("y"))

    known = lambda c: c in (4326, 3857) or c // 100 in (326, 327) and 1 <= c % 100 <= 60
    if source not in (4326, 3857) or not known(target):
        raise ValueError(f"can't reproject from {source} to {target}")
    return with_box(df.withColumn("ring", F.transform("ring", point)))
