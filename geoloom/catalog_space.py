"""Queries: sampling, neighbourhoods, vectors and rasters, clustering, registration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.bridge import BOXES, CLASSES, EVENTS, IMAGES, boxes, classes, events, images, map_box, pixels, table
from geoloom.catalog import query
from geoloom.layout import SIDE_BITS
from geoloom.operators import areas as connected
from geoloom.operators import clustering, filters, geometry, masking, registration, sampling, spatial, warping
from geoloom.operators import neighbourhood as near

PIX = "patch_id, y, x"
KEY = ["patch_id", "y", "x"]


def image(spark: SparkSession, d: str) -> DataFrame:
    return images(spark, d).select(*KEY, "v")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return classes(spark, d).select(*KEY, "v")


@query(f"SELECT {PIX}, v, (y // 3) * 3 AS anchor_y, (x // 3) * 3 AS anchor_x FROM {IMAGES} WHERE y % 3 < 2 AND x % 3 < 2 AND (y // 3) * 3 <= 6 AND (x // 3) * 3 <= 6")
def grid_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.grid_sample(image(spark, d), 2, 2, 3, 3)


@query("SELECT CAST(n_nationkey AS BIGINT) AS patch_id, CAST(n_nationkey // 5 + i // 3 AS INT) AS y, CAST(n_nationkey % 5 + i % 3 AS INT) AS x FROM nation, (SELECT unnest(range(0, 6)) AS i)")
def block_expand(spark: SparkSession, d: str) -> DataFrame:
    at = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("patch_id"), F.expr("n_nationkey div 5").cast("int").alias("y"), (F.col("n_nationkey") % 5).cast("int").alias("x"))
    return sampling.expand_to_grids(at, 2, 3).select(*KEY)


@query(f"SELECT patch_id, v, count(*) AS n FROM {CLASSES} GROUP BY ALL")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return sampling.class_counts(labels(spark, d))


@query(f"SELECT patch_id, v, count(*) AS n, CAST(round_even(count(*) * 0.25, 0) AS INT) AS amount FROM {CLASSES} WHERE v <> 3 GROUP BY ALL")
def stratified_counts(spark: SparkSession, d: str) -> DataFrame:
    return sampling.fraction_amounts(labels(spark, d), 0.25, exclude=[3])


A = "((11 * 7919 + patch_id * 104729 + y * 1299709 + CAST(x AS BIGINT) * 15485863) % 1000003)"
DRAW = f"(({A} * {A} + {A} * 31 + 17) % 1000003)"


@query(f"SELECT {PIX}, v FROM (SELECT *, row_number() OVER (PARTITION BY patch_id, v ORDER BY {DRAW}, y, x) AS r, count(*) OVER (PARTITION BY patch_id, v) AS n FROM {CLASSES}) WHERE r <= round_even(n * CASE v WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0 END, 0)")
def fraction_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.fraction_sample(labels(spark, d), {1: 0.5, 2: 0.25}, seed=11).select(*KEY, "v")


@query(f"SELECT {PIX}, v FROM (SELECT *, row_number() OVER (PARTITION BY patch_id, v ORDER BY {DRAW}, y, x) AS r FROM {CLASSES}) WHERE r <= CASE v WHEN 0 THEN 3 WHEN 3 THEN 1 ELSE 0 END")
def sample_by_values(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_by_values(labels(spark, d), {0: 3, 3: 1}, seed=11)


@query("SELECT vec_id AS patch_id, CAST(12 AS BIGINT) AS n, CAST(3 AS BIGINT) AS blocks FROM embeddings")
def block_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three blocks of two by two pixels in every patch."""
    sizes = table(spark, d, "embeddings").select(F.col("vec_id").alias("patch_id"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    anchors = sampling.block_sample(sizes, 3, 2, 2, seed=5)
    places = sampling.expand_to_grids(anchors.withColumns({"ay": F.col("y"), "ax": F.col("x")}), 2, 2)
    return sampling.apply_sample(image(spark, d), places).groupBy("patch_id").agg(F.count("*").alias("n"), F.count_distinct("ay", "ax").alias("blocks"))


@query(f"SELECT {PIX}, CAST((y % 4 < 2)::INT * (x % 4 < 2)::INT * 2 AS BIGINT) AS n FROM {IMAGES}")
def sample_mask(spark: SparkSession, d: str) -> DataFrame:
    px = image(spark, d)
    places = sampling.grid_sample(px, 2, 2, 4, 4).select(*KEY)
    return sampling.mask_of_samples(px, places.unionByName(places))


@query()
def sample_replacement(spark: SparkSession, d: str) -> DataFrame:
    return sampling.fraction_sample(labels(spark, d), 0.5, seed=3, replace=True).select(*KEY, "v")


@query("SELECT vec_id AS patch_id, round((1 - sqrt(r1)) * 0 + sqrt(r1) * (1 - r2) * 4 + sqrt(r1) * r2 * 1, 4) AS px, round(sqrt(r1) * r2 * 3, 4) AS py FROM (SELECT vec_id, (vec_id * 37 % 101) / 101.0 AS r1, (vec_id * 53 % 103) / 103.0 AS r2 FROM embeddings)")
def triangle_points(spark: SparkSession, d: str) -> DataFrame:
    r1, r2 = (F.col("vec_id") * 37 % 101) / 101.0, (F.col("vec_id") * 53 % 103) / 103.0
    n = lambda v: F.lit(float(v))
    x, y = sampling.point_in_triangle(n(0), n(0), n(4), n(0), n(1), n(3), r1, r2)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("patch_id"), F.round(x, 4).alias("px"), F.round(y, 4).alias("py"))


def _around(f: str, source: str = IMAGES, r: int = 1) -> str:
    return f"(SELECT a.patch_id, a.y, a.x, {f}(b.v) AS v FROM {source} a JOIN {source} b ON a.patch_id = b.patch_id AND abs(a.y - b.y) <= {r} AND abs(a.x - b.x) <= {r} GROUP BY ALL)"


@query(f"SELECT * FROM {_around('max')}")
def dilate(spark: SparkSession, d: str) -> DataFrame:
    return near.morphology(image(spark, d), how="dilation")


@query(f"SELECT * FROM {_around('min')}")
def erode(spark: SparkSession, d: str) -> DataFrame:
    return near.morphology(image(spark, d), how="erosion")


@query(f"SELECT * FROM {_around('max', _around('min'))}")
def opening(spark: SparkSession, d: str) -> DataFrame:
    return near.morphology(image(spark, d), how="opening")


@query(f"SELECT * FROM {_around('min', _around('max'))}")
def closing(spark: SparkSession, d: str) -> DataFrame:
    return near.morphology(image(spark, d), how="closing")


@query(f"SELECT a.patch_id, a.y, a.x, max(b.v) AS v FROM {IMAGES} a JOIN {IMAGES} b ON a.patch_id = b.patch_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY ALL")
def dilate_disk(spark: SparkSession, d: str) -> DataFrame:
    return near.morphology(image(spark, d), near.disk(3), "dilation")


@query(f"""
SELECT a.patch_id, a.y, a.x, CASE WHEN any_value(a.v) IN (1, 2) AND min(b.v) <> max(b.v) THEN 0 ELSE any_value(a.v) END AS v
FROM {CLASSES} a JOIN {CLASSES} b ON a.patch_id = b.patch_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY a.patch_id, a.y, a.x""")
def erode_labels(spark: SparkSession, d: str) -> DataFrame:
    return near.erode_labels(labels(spark, d), 3, [1, 2])


@query(f"SELECT g.patch_id, g.y, g.x, coalesce(i.v, -1) AS v FROM (SELECT vec_id AS patch_id, CAST(k // 9 AS INT) AS y, CAST(k % 9 AS INT) AS x FROM embeddings, (SELECT unnest(range(0, 90)) AS k)) g LEFT JOIN {IMAGES} i ON g.patch_id = i.patch_id AND g.y = i.y + 1 AND g.x = i.x")
def pad_even(spark: SparkSession, d: str) -> DataFrame:
    """8 by 8 becomes 10 by 9: one row above and below, the odd column at the right."""
    return near.pad(image(spark, d), (5, 3), value=-1.0)


@query(f"SELECT g.patch_id, g.ny AS y, g.nx AS x, i.v FROM (SELECT vec_id AS patch_id, CAST(k // 5 AS INT) AS ny, CAST(k % 5 AS INT) AS nx FROM embeddings, (SELECT unnest(range(0, 60)) AS k)) g JOIN {IMAGES} i ON g.patch_id = i.patch_id AND i.y = g.ny * 8 // 12 AND i.x = g.nx * 8 // 5")
def resize_nearest(spark: SparkSession, d: str) -> DataFrame:
    return near.resize(image(spark, d), 12, 5, "nearest")


@query(f"""
WITH g AS (SELECT vec_id AS patch_id, CAST(k // 5 AS INT) AS ny, CAST(k % 5 AS INT) AS nx, least(greatest((k // 5 + 0.5) * 8.0 / 12 - 0.5, 0), 7) AS cy, least(greatest((k % 5 + 0.5) * 8.0 / 5 - 0.5, 0), 7) AS cx FROM embeddings, (SELECT unnest(range(0, 60)) AS k))
SELECT g.patch_id, ny AS y, nx AS x, round(sum(i.v * (1 - abs(i.y - cy)) * (1 - abs(i.x - cx))), 4) AS v FROM g JOIN {IMAGES} i ON g.patch_id = i.patch_id AND abs(i.y - cy) < 1 AND abs(i.x - cx) < 1 GROUP BY ALL""")
def resize_linear(spark: SparkSession, d: str) -> DataFrame:
    return near.resize(image(spark, d), 12, 5).withColumn("v", F.round("v", 4))


@query(f"""
WITH s AS (SELECT a.patch_id, a.y, a.x, sum(b.v * dx * (2 - abs(dy))) AS gx, sum(b.v * dy * (2 - abs(dx))) AS gy
  FROM {IMAGES} a, (SELECT i // 3 - 1 AS dy, i % 3 - 1 AS dx FROM (SELECT unnest(range(0, 9)) AS i)) JOIN {IMAGES} b ON b.patch_id = a.patch_id AND b.y = CASE a.y + dy WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE a.y + dy END AND b.x = CASE a.x + dx WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE a.x + dx END GROUP BY ALL)
SELECT {PIX}, round(0.5 * abs(gx) + 0.5 * abs(gy), 4) AS v FROM s""")
def sobel_gradient(spark: SparkSession, d: str) -> DataFrame:
    return near.gradient(image(spark, d)).withColumn("v", F.round("v", 4))


@query(f"""
WITH h AS (SELECT patch_id, least(greatest(CAST(floor((v + 3) / 0.375) AS INT), 0), 15) AS bin, count(*) AS n FROM {IMAGES} GROUP BY ALL),
c AS (SELECT patch_id, bin, sum(n) OVER w AS n0, sum(bin * n) OVER w AS s0, sum(n) OVER (PARTITION BY patch_id) AS n, sum(bin * n) OVER (PARTITION BY patch_id) AS s FROM h WINDOW w AS (PARTITION BY patch_id ORDER BY bin)),
b AS (SELECT *, CASE WHEN n > n0 THEN n0 * (n - n0) * (s0 / n0 - (s - s0) / (n - n0)) ^ 2 ELSE 0 END AS between_ FROM c)
SELECT patch_id, CAST(round(-3 + (bin + 1) * 0.375, 5) AS DOUBLE) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY round(between_, 6) DESC, bin) AS r FROM b) WHERE r = 1""")
def otsu_per_frame(spark: SparkSession, d: str) -> DataFrame:
    return near.otsu(image(spark, d), ["patch_id"], 16, -3.0, 3.0).withColumn("threshold", F.round("threshold", 5))


RASTER = f"""
WITH g AS (SELECT CAST(k // 11 AS INT) AS y, CAST(k % 11 AS INT) AS x, 6 - (k // 11 + 0.5) * 6 / 11 AS cy, (k % 11 + 0.5) * 6 / 11 AS cx FROM (SELECT unnest(range(0, 121)) AS k)),
h AS (SELECT y, x, arg_max(value, row) AS last, count(DISTINCT value) AS n FROM g JOIN {BOXES} b ON cx >= min_x AND cx < max_x AND cy >= min_y AND cy < max_y GROUP BY ALL)
SELECT CAST(0 AS BIGINT) AS patch_id, g.y, g.x, CAST(VALUE AS INT) AS v FROM g LEFT JOIN h USING (y, x)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(n) for n in ("min_x", "min_y", "max_x", "max_y")]
    return boxes(spark, d).withColumn("ring", geometry.box_ring(*c))


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(121).select(F.lit(0).cast("long").alias("patch_id"), F.expr("id div 11").cast("int").alias("y"), (F.col("id") % 11).cast("int").alias("x"))


@query(RASTER.replace("VALUE", "coalesce(last, 0)"))
def rasterize(spark: SparkSession, d: str) -> DataFrame:
    return geometry.rasterize(_vectors(spark, d), map_box(spark), _grid(spark)).withColumn("v", F.col("v").cast("int"))


@query(RASTER.replace("VALUE", "coalesce(CASE WHEN n > 1 THEN 99 ELSE last END, 0)"))
def rasterize_overlap(spark: SparkSession, d: str) -> DataFrame:
    return geometry.rasterize(_vectors(spark, d), map_box(spark), _grid(spark), overlap=99).withColumn("v", F.col("v").cast("int"))


@query(RASTER.replace("VALUE", "coalesce(last, 100 + g.x)"))
def rasterize_existing(spark: SparkSession, d: str) -> DataFrame:
    old = _grid(spark).withColumn("v", 100 + F.col("x"))
    return geometry.rasterize(_vectors(spark, d), map_box(spark), _grid(spark), existing=old).withColumn("v", F.col("v").cast("int"))


#: A frame for each order on a map of its customer: a rectangle with a hole a quarter from each side.
PLOTS = "(SELECT o_custkey AS patch_id, o_orderkey AS row, o_orderkey % 9 + 1 AS value, (o_orderkey * 7 % 256) / 32 AS min_x, (o_orderkey * 11 % 256) / 32 AS min_y, (o_orderkey * 7 % 256) / 32 + 1 + o_orderkey % 3 AS max_x, (o_orderkey * 11 % 256) / 32 + 1 + o_orderkey % 2 AS max_y FROM orders)"


@query(f"""
WITH plot AS {PLOTS}, g AS (SELECT patch_id, i // 8 AS y, i % 8 AS x, i % 8 + 0.5 AS px, 7.5 - i // 8 AS py FROM (SELECT DISTINCT patch_id FROM plot), (SELECT unnest(range(0, 64)) AS i)),
hit AS (SELECT g.patch_id, y, x, arg_max(value, row) AS v FROM g JOIN plot ON g.patch_id = plot.patch_id
  AND pow(greatest(min_x - px, px - max_x, 0), 2) + pow(greatest(min_y - py, py - max_y, 0), 2) <= 0.0625
  AND NOT least(px - min_x, max_x - px) - (max_x - min_x) / 4 > 0.25 OR g.patch_id = plot.patch_id
  AND pow(greatest(min_x - px, px - max_x, 0), 2) + pow(greatest(min_y - py, py - max_y, 0), 2) <= 0.0625
  AND NOT least(py - min_y, max_y - py) - (max_y - min_y) / 4 > 0.25 GROUP BY ALL)
SELECT patch_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(coalesce(v, 0) AS INT) AS v FROM g LEFT JOIN hit USING (patch_id, y, x)""")
def rasterize_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles with holes, grown by 0.25 to both sides of their rings, of a table that grows."""
    key = F.col("o_orderkey")
    x, y, w, h = key * 7 % 256 / 32, key * 11 % 256 / 32, 1 + key % 3, 1 + key % 2
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("patch_id"), key.alias("row"), (key % 9 + 1).alias("value"), x.alias("min_x"), y.alias("min_y"), (x + w).alias("max_x"), (y + h).alias("max_y"), w.alias("w"), h.alias("h"))
    hole = geometry.box_ring(F.col("min_x") + F.col("w") / 4, F.col("min_y") + F.col("h") / 4, F.col("max_x") - F.col("w") / 4, F.col("max_y") - F.col("h") / 4)
    plots = orders.withColumns({"ring": geometry.box_ring(*map(F.col, ("min_x", "min_y", "max_x", "max_y"))), "holes": F.array(hole)}).drop("w", "h")
    patches = plots.select("patch_id").distinct()
    maps = patches.select("patch_id", *(F.lit(v).alias(c) for c, v in (("min_x", 0.0), ("min_y", 0.0), ("max_x", 8.0), ("max_y", 8.0), ("height", 8), ("width", 8))))
    grid = patches.select("patch_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select("patch_id", F.expr("cast(i div 8 AS int)").alias("y"), F.expr("i % 8").alias("x"))
    return geometry.rasterize(plots, maps, grid, buffer=0.25).withColumn("v", F.col("v").cast("int"))


@query(f"""
WITH RECURSIVE px AS (SELECT patch_id, y, x, v, patch_id * 64 + y * 8 + x AS id FROM {CLASSES} WHERE patch_id < 1000000), e AS (
  SELECT a.id AS a, b.id AS b FROM px a JOIN px b ON a.patch_id = b.patch_id AND a.v = b.v AND abs(a.y - b.y) + abs(a.x - b.x) = 1
), r AS (SELECT id AS a, id AS b FROM px UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), root AS (SELECT a, min(b) AS root FROM r GROUP BY a),
s AS (SELECT px.patch_id, px.v AS value, root, count(*) AS pixels FROM px JOIN root ON px.id = root.a GROUP BY ALL)
SELECT patch_id, value, pixels, count(*) AS areas FROM s GROUP BY ALL""")
def areas(spark: SparkSession, d: str) -> DataFrame:
    """Connected areas of equal value: how many of each size."""
    found = connected.labelled(labels(spark, d), ["patch_id"])
    sizes = found.groupBy("patch_id", F.col("v").alias("value"), "component").agg(F.count("*").alias("pixels"))
    return sizes.groupBy("patch_id", "value", "pixels").agg(F.count("*").alias("areas"))


@query(f"""
WITH RECURSIVE px AS (SELECT patch_id, y, x, v, y * 8 + x AS i FROM {CLASSES}), link AS (
  SELECT a.patch_id, a.i AS a, b.i AS b FROM px a JOIN px b ON a.patch_id = b.patch_id AND a.v = b.v AND abs(a.y - b.y) + abs(a.x - b.x) = 1
), reach AS (SELECT patch_id, i AS a, i AS b FROM px UNION SELECT reach.patch_id, reach.a, link.b FROM reach JOIN link ON link.patch_id = reach.patch_id AND link.a = reach.b
), area AS (SELECT px.*, root FROM px JOIN (SELECT patch_id, a AS i, min(b) AS root FROM reach GROUP BY ALL) USING (patch_id, i)
), four AS (  -- the pixels of an area around each corner: 1 upper left, 2 upper right, 4 lower left, 8 lower right
  SELECT patch_id, root, y + dy AS cy, x + dx AS cx, sum(CASE WHEN dy = 0 THEN CASE WHEN dx = 0 THEN 8 ELSE 4 END ELSE CASE WHEN dx = 0 THEN 2 ELSE 1 END END) AS k
  FROM area, (SELECT unnest([0, 0, 1, 1]) AS dy, unnest([0, 1, 0, 1]) AS dx) GROUP BY ALL
), turn AS (SELECT patch_id, root, sum(CASE WHEN k IN (1, 2, 4, 8) THEN 1 WHEN k IN (6, 9) THEN 2 ELSE 0 END) AS convex, sum(CASE WHEN k IN (7, 11, 13, 14) THEN 1 ELSE 0 END) AS concave,
  min(cy * 100 + cx) FILTER (WHERE k NOT IN (3, 5, 10, 12, 15)) AS corner FROM four GROUP BY ALL
) SELECT patch_id, root, any_value(v) AS value, count(*) AS pixels, CAST(count(*) AS DOUBLE) AS area, CAST(any_value(convex + concave) AS BIGINT) AS corners, CAST(any_value(2 - (convex - concave) // 4) AS BIGINT) AS rings, CAST(any_value(corner) AS BIGINT) AS corner
FROM area JOIN turn USING (patch_id, root) GROUP BY ALL""")
def vectorize(spark: SparkSession, d: str) -> DataFrame:
    """Polygons of areas: signed area of all rings, number of corners and rings, smallest corner (by row), and the first pixel."""
    shapes = connected.vectorize(labels(spark, d), ["patch_id"])
    following = lambda ring, i: F.get(ring, F.pmod(i + 1, F.size(ring)))
    size = lambda ring: F.aggregate(F.transform(ring, lambda p, i: p["x"] * following(ring, i)["y"] - following(ring, i)["x"] * p["y"]), F.lit(0.0), lambda a, v: a + v) / 2
    rings = F.concat(F.array("ring"), F.col("holes"))
    total = F.aggregate(F.transform(rings, size), F.lit(0.0), lambda a, v: a + v)
    corners = F.aggregate(F.transform(rings, F.size), F.lit(0), lambda a, v: a + v).cast("long")
    corner = F.array_min(F.transform("ring", lambda p: p["y"] * 100 + p["x"])).cast("long")
    bits = (1 << SIDE_BITS) - 1
    root = (F.shiftright("component", SIDE_BITS).bitwiseAND(bits) * 8 + F.col("component").bitwiseAND(bits)).cast("int")
    return shapes.select("patch_id", root.alias("root"), "value", "pixels", total.alias("area"), corners.alias("corners"), F.size(rings).cast("long").alias("rings"), corner.alias("corner"))


#: A rectangle for each event: from its time (in days) on and around its user; a few are hundreds of times as large as most.
SPANS = "(SELECT event_id AS row, epoch_us(ts) / 86400e6 AS min_x, user_id + (event_id % 7) * 0.125 AS min_y, epoch_us(ts) / 86400e6 + CASE WHEN event_id % 1000 = 0 THEN 8 ELSE (1 + event_id % 10) * 0.0078125 END AS max_x, user_id + (event_id % 7) * 0.125 + CASE WHEN event_id % 1000 = 0 THEN 16 ELSE (event_id % 3) * 0.5 END AS max_y FROM events)"


@query(f"SELECT a.row AS a, b.row AS b FROM {SPANS} a JOIN {SPANS} b ON a.row < b.row AND a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y")
def boxes_meet(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rectangles that meet, of a table that grows."""
    x, y = F.unix_micros(F.col("ts").cast("timestamp")) / 86_400e6, F.col("user_id") + (F.col("event_id") % 7) * F.lit(0.125)
    large = F.col("event_id") % 1000 == 0
    w, h = F.when(large, 8.0).otherwise((1 + F.col("event_id") % 10) * F.lit(0.0078125)), F.when(large, 16.0).otherwise((F.col("event_id") % 3) * F.lit(0.5))
    spans = table(spark, d, "events").select(F.col("event_id").alias("row"), x.alias("min_x"), y.alias("min_y"), (x + w).alias("max_x"), (y + h).alias("max_y"))
    return spatial.boxes_that_meet(spans)


@query(f"SELECT row, round(greatest(min_x, 1.25), 5) AS min_x, round(greatest(min_y, 0.5), 5) AS min_y, round(least(max_x, 4.5), 5) AS max_x, round(least(max_y, 4.75), 5) AS max_y FROM {BOXES} WHERE max_x > 1.25 AND min_x < 4.5 AND max_y > 0.5 AND min_y < 4.75")
def clip_to_box(spark: SparkSession, d: str) -> DataFrame:
    box = (1.25, 0.5, 4.5, 4.75)
    near_ = filters.in_box(_vectors(spark, d), *box)
    cut = near_.withColumn("ring", geometry.clip_ring(F.col("ring"), *box)).where(F.size("ring") > 2)
    out = geometry.with_box(cut).where("max_x > min_x and max_y > min_y")
    return out.select("row", *(F.round(c, 5).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


@query(f"SELECT min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, CAST(0 AS BIGINT) AS patch_id FROM {BOXES}")
def total_box(spark: SparkSession, d: str) -> DataFrame:
    return geometry.total_box(boxes(spark, d))


@query("SELECT n_nationkey, round(radians(lon) * 6378137, 2) AS mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 2) AS my, CAST(round(lon, 6) AS DOUBLE) AS lon, CAST(round(lat, 6) AS DOUBLE) AS lat FROM (SELECT n_nationkey, n_nationkey * 13.7 - 170 AS lon, n_nationkey * 5.3 - 60 AS lat FROM nation)")
def web_mercator(spark: SparkSession, d: str) -> DataFrame:
    px = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 13.7 - 170).alias("lon"), (F.col("n_nationkey") * 5.3 - 60).alias("lat"))
    x, y = geometry.to_web_mercator(F.col("lon"), F.col("lat"))
    back = geometry.from_web_mercator(x, y)
    return px.select("n_nationkey", F.round(x, 2).alias("mx"), F.round(y, 2).alias("my"), F.round(back[0], 6).alias("lon"), F.round(back[1], 6).alias("lat"))


@query(f"SELECT row, CAST(round_even((max_x - min_x) / 0.4, 0) AS INT) AS width, CAST(round_even((max_y - min_y) / 0.7, 0) AS INT) AS height FROM {BOXES}")
def size_for_resolution(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return boxes(spark, d).select("row", near.size_for_resolution(c("min_x"), c("max_x"), 0.4).alias("width"), near.size_for_resolution(c("min_y"), c("max_y"), 0.7).alias("height"))


@query(f"""
WITH RECURSIVE px AS (SELECT patch_id, y, x, v, y * 8 + x AS i FROM {IMAGES}), link AS (
  SELECT a.patch_id, a.i AS a, b.i AS b FROM px a JOIN px b ON a.patch_id = b.patch_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND sqrt((a.v - b.v) * (a.v - b.v)) <= 0.05
), reach AS (SELECT patch_id, i AS a, i AS b FROM px UNION SELECT reach.patch_id, reach.a, link.b FROM reach JOIN link ON link.patch_id = reach.patch_id AND link.a = reach.b
), root AS (SELECT patch_id, a AS i, min(b) AS root FROM reach GROUP BY ALL), kept AS (
  SELECT patch_id, root, row_number() OVER (PARTITION BY patch_id ORDER BY root) - 1 AS c FROM (SELECT patch_id, root FROM root GROUP BY ALL HAVING count(*) >= 2)
) SELECT patch_id, y, x, CAST(coalesce(c, -1) AS INT) AS cluster FROM px JOIN root USING (patch_id, i) LEFT JOIN kept USING (patch_id, root)""")
def cluster_single_link(spark: SparkSession, d: str) -> DataFrame:
    px = images(spark, d).select(*KEY, F.array("v").alias("bands"))
    return clustering.cluster(px, 0.05, "euclidean", remove_small=2)


#: Links between pixels beside each other, numbered by row.
GRID = f"""px AS (SELECT patch_id, y, x, v, y * 8 + x AS i FROM {IMAGES}), link AS (
  SELECT a.patch_id, a.i AS a, b.i AS b, {{distance}} AS d FROM px a JOIN px b ON a.patch_id = b.patch_id AND (b.i = a.i + 8 OR b.i = a.i + 1 AND b.y = a.y))"""


@query(f"""
WITH RECURSIVE {GRID.format(distance="sqrt((a.v - b.v) * (a.v - b.v))")}, step AS (  -- the two nearest clusters of each patch merge
  SELECT 0 AS k, patch_id, i, i AS c FROM px
  UNION ALL
  SELECT s.k + 1, s.patch_id, s.i, CASE WHEN s.c = m.b THEN m.a ELSE s.c END FROM step s JOIN (
    SELECT patch_id, a, b FROM (
      SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY h) AS place FROM (
        SELECT l.patch_id, least(p.c, q.c) AS a, greatest(p.c, q.c) AS b, max({{'d': l.d, 'a': l.a, 'b': l.b}}) AS h
        FROM link l JOIN step p ON p.patch_id = l.patch_id AND p.i = l.a JOIN step q ON q.patch_id = l.patch_id AND q.i = l.b WHERE p.c <> q.c GROUP BY ALL
      ) WHERE h.d <= 0.25) WHERE place = 1) m ON m.patch_id = s.patch_id
), done AS (SELECT patch_id, i, arg_max(c, k) AS root FROM step GROUP BY ALL), named AS (
  SELECT patch_id, root, row_number() OVER (PARTITION BY patch_id ORDER BY root) - 1 AS cluster FROM done GROUP BY patch_id, root
) SELECT patch_id, y, x, CAST(cluster AS INT) AS cluster FROM px JOIN done USING (patch_id, i) JOIN named USING (patch_id, root)""")
def cluster_complete(spark: SparkSession, d: str) -> DataFrame:
    px = images(spark, d).select(*KEY, F.array("v").alias("bands"))
    return clustering.cluster(px, 0.25, "euclidean", linkage="complete")


@query(f"""
WITH RECURSIVE {GRID.format(distance="abs(a.v - b.v)")}, ranked AS (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY d, a, b) AS k FROM link), walk AS (  -- links by distance
  SELECT patch_id, CAST(0 AS BIGINT) AS k, list(i ORDER BY i) AS c, count(*) AS n FROM px GROUP BY patch_id
  UNION ALL
  SELECT w.patch_id, w.k + 1, CASE WHEN w.n > 6 THEN list_transform(w.c, lambda e: CASE WHEN e = greatest(w.c[r.a + 1], w.c[r.b + 1]) THEN least(w.c[r.a + 1], w.c[r.b + 1]) ELSE e END) ELSE w.c END,
    CASE WHEN w.n > 6 AND w.c[r.a + 1] <> w.c[r.b + 1] THEN w.n - 1 ELSE w.n END
  FROM walk w JOIN ranked r ON r.patch_id = w.patch_id AND r.k = w.k + 1
), done AS (SELECT patch_id, unnest(range(0, 64)) AS i, unnest(c) AS root FROM (SELECT patch_id, arg_max(c, k) AS c FROM walk GROUP BY patch_id)), named AS (
  SELECT patch_id, root, row_number() OVER (PARTITION BY patch_id ORDER BY root) - 1 AS cluster FROM done GROUP BY patch_id, root
) SELECT patch_id, y, x, CAST(cluster AS INT) AS cluster FROM px JOIN done USING (patch_id, i) JOIN named USING (patch_id, root)""")
def cluster_n(spark: SparkSession, d: str) -> DataFrame:
    """Six clusters of each image by single linkage."""
    px = images(spark, d).select(*KEY, F.array("v").alias("bands"))
    return clustering.cluster(px, affinity="manhattan", n_clusters=6)


def _movie(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each image as a reference, and frames of it that are shifted in a circle."""
    px = images(spark, d).select(*KEY, F.array("v").alias("bands"))
    shifts = [(0, 0), (1, 2), (-2, 1)]
    frames = px.select("patch_id", "y", "x", "bands", F.posexplode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in shifts))).alias("k", "s"))
    ts = F.timestamp_add("DAY", F.col("k"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return px, frames.select("patch_id", ts.alias("ts"), F.pmod(F.col("y") + F.col("s.a"), F.lit(8)).alias("y"), F.pmod(F.col("x") + F.col("s.b"), F.lit(8)).alias("x"), "bands")


@query("SELECT vec_id AS patch_id, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * k AS ts, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE 2 END AS BIGINT) AS dy, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN -2 ELSE -1 END AS BIGINT) AS dx FROM embeddings, (SELECT unnest(range(0, 3)) AS k)")
def register_translation(spark: SparkSession, d: str) -> DataFrame:
    reference, frames = _movie(spark, d)
    found = registration.estimate_shifts(frames, reference)
    return found.select("patch_id", "ts", F.round("dy").cast("long").alias("dy"), F.round("dx").cast("long").alias("dx"))


@query(f"""
WITH s AS (SELECT unnest([0, 1, 2]) AS k, unnest([0, 1, -2]) AS a, unnest([0, 2, 1]) AS b), placed AS (
  SELECT patch_id, k, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * k AS ts, y, x, v, a, b FROM {IMAGES}, s
) SELECT patch_id, ts, y, x, CASE WHEN y + a BETWEEN 0 AND 7 AND x + b BETWEEN 0 AND 7 THEN v END AS v FROM placed""")
def register_move(spark: SparkSession, d: str) -> DataFrame:
    reference, frames = _movie(spark, d)
    return registration.move(frames, registration.estimate_shifts(frames, reference)).select("patch_id", "ts", "y", "x", F.element_at("bands", 1).alias("v"))


#: The warp planted in each image, by its number: a stretch, a shear and a shift.
PLANT = {"m00": "1 + (vec_id % 5 - 2) * 0.01", "m01": "(vec_id % 3 - 1) * 0.02", "m02": "(vec_id % 7 - 3) * 0.5", "m10": "(vec_id % 4 - 1) * -0.01", "m11": "1 - (vec_id % 3) * 0.01", "m12": "(vec_id % 6 - 2) * 0.4"}


def _planted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A smooth image of 28 by 28 pixels for each vector, waves whose strengths are its numbers, and a frame of it through its warp.

    The frame is the same sum of waves at the warp's inverse, brighter and with more contrast, so nothing is interpolated.
    """
    m = {k: F.expr(v) for k, v in PLANT.items()}
    grid = table(spark, d, "embeddings").select(F.col("vec_id").alias("patch_id"), "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(28 * 28 - 1))).alias("i"))
    grid = grid.withColumns({"y": F.expr("i div 28").cast("int"), "x": (F.col("i") % 28).cast("int"), **m}).drop("i")
    wave = lambda k, y, x: F.get("embedding", F.lit(k)).cast("double") * F.cos((y * (k % 3 - 1) + x * (1 + k // 3 % 2) + 2 * k) * 0.23)
    scene = lambda y, x: sum((wave(k, y, x) for k in range(1, 9)), wave(0, y, x))
    dx, dy, det = F.col("x") - F.col("m02"), F.col("y") - F.col("m12"), F.col("m00") * F.col("m11") - F.col("m01") * F.col("m10")
    there = scene((F.col("m00") * dy - F.col("m10") * dx) / det, (F.col("m11") * dx - F.col("m01") * dy) / det)
    fixed = grid.select("patch_id", "y", "x", F.array(scene(F.col("y"), F.col("x"))).alias("bands"))
    return fixed, grid.select("patch_id", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), "y", "x", F.array(1.5 * there + 2).alias("bands"))


@query(f"SELECT vec_id AS patch_id, TRUE AS found, TRUE AS shape, TRUE AS shift FROM embeddings WHERE abs({PLANT['m00']}) > 0")
def register_affine(spark: SparkSession, d: str) -> DataFrame:
    """Planted affine warps are found: their shape to 0.02 and their shift to a quarter of a pixel."""
    fixed, frames = _planted(spark, d)
    out = warping.estimate_warps(frames, fixed, "affine", max_translation=8.0).withColumn("vec_id", F.col("patch_id"))
    gap = lambda k, name: F.abs(F.get("matrix", F.lit(k)) - F.expr(PLANT[name]))
    shape = F.greatest(gap(0, "m00"), gap(1, "m01"), gap(3, "m10"), gap(4, "m11"))
    return out.select("patch_id", "found", (shape < 0.02).alias("shape"), (F.greatest(gap(2, "m02"), gap(5, "m12")) < 0.25).alias("shift"))


def brightness(bands: pd.Series) -> pd.Series:
    """Stands for a trained model: the brighter, the more likely a cloud."""
    return pd.Series(np.clip(np.stack(bands.to_list())[:, 0] / 100, 0, 1) if len(bands) else np.empty(0))


@query(f"""
WITH px AS (SELECT patch_id, date_trunc('day', ts) AS ts, y, x, least(greatest(avg(v) / 100, 0), 1) AS p FROM {EVENTS} GROUP BY ALL),
mean AS (SELECT a.patch_id, a.ts, a.y, a.x, avg(b.p) AS q FROM px a JOIN px b ON a.patch_id = b.patch_id AND a.ts = b.ts AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY ALL)
SELECT a.patch_id, a.ts, a.y, a.x, round(any_value(a.q), 10) AS probability, bool_or(b.q >= 0.5) AS cloud
FROM mean a JOIN mean b ON a.patch_id = b.patch_id AND a.ts = b.ts AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY a.patch_id, a.ts, a.y, a.x""")
def cloud_hook(spark: SparkSession, d: str) -> DataFrame:
    px = events(spark, d).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz")).groupBy("patch_id", "ts", "y", "x").agg(F.array(F.avg("v")).alias("bands"))
    return masking.cloud_mask(px, brightness, average_over=3, threshold=0.5, dilation=3).withColumn("probability", F.round("probability", 10))


@query("SELECT vec_id AS patch_id, round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 4) AS distance FROM (SELECT vec_id, CAST(embedding[i] AS DOUBLE) AS a, CAST(embedding[i + 32] AS DOUBLE) AS b FROM embeddings, (SELECT unnest(range(1, 33)) AS i)) GROUP BY vec_id")
def cosine_distances(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    a, b = F.slice("bands", 1, 32), F.slice("bands", 33, 32)
    return px.select("patch_id", F.round(clustering.cosine_distance(a, b), 4).alias("distance"))
