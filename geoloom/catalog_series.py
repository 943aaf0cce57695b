"""Queries: time series and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.bridge import EVENTS, IMAGES, events, images
from geoloom.catalog import query
from geoloom.operators import timeseries
from geoloom.operators.projection import number

PIX = "patch_id, y, x"
W0 = f"OVER (PARTITION BY {PIX} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
W1 = f"OVER (PARTITION BY {PIX} ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def series(spark: SparkSession, d: str) -> DataFrame:
    """One value for each pixel and time; values of failed captures are missing."""
    px = events(spark, d).withColumn("v", F.when(F.col("event_type") != "error", F.col("v")))
    return timeseries.deduped(px)


SERIES = f"(SELECT patch_id, y, x, ts, avg(CASE WHEN event_type <> 'error' THEN v END) AS v FROM {EVENTS} GROUP BY ALL)"
NEAR = f"""(SELECT *, epoch_us(ts) AS t, last_value(CASE WHEN v IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) {W0} AS t0, last_value(v IGNORE NULLS) {W0} AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) {W1} AS t1, first_value(v IGNORE NULLS) {W1} AS v1 FROM {SERIES})"""
LINE = "CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END"


@query(f"SELECT patch_id, y, x, date_trunc('day', ts) AS ts, round(avg(v), 5) AS v FROM {EVENTS} GROUP BY ALL")
def dedupe_time_mean(spark: SparkSession, d: str) -> DataFrame:
    px = events(spark, d).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return timeseries.deduped(px).withColumn("v", F.round("v", 5))


@query(f"SELECT event_id, CAST(round_even((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY patch_id)) / 1e6 / 3600, 0) AS BIGINT) AS t FROM {EVENTS}")
def scaled_time(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.scaled_time(events(spark, d)).select("event_id", "t")


@query(f"SELECT {PIX}, ts, round({LINE}, 3) AS v FROM {NEAR}")
def interp_linear(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.fill_linear(series(spark, d)).withColumn("v", F.round("v", 3))


@query(f"SELECT {PIX}, ts, round({LINE}, 3) AS v FROM {NEAR.replace('THEN v END) AS v', 'AND v > 20 THEN v END) AS v')}")
def interp_masked(spark: SparkSession, d: str) -> DataFrame:
    """Values that a mask takes away are filled like missing ones."""
    px = timeseries.masked(events(spark, d), (F.col("event_type") != "error") & (F.col("v") > 20))
    return timeseries.fill_linear(timeseries.deduped(px)).withColumn("v", F.round("v", 3))


@query(f"SELECT {PIX}, ts, t0 IS NULL OR t1 IS NULL AS edge FROM {NEAR}")
def edge_gaps(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.edge_gaps(series(spark, d)).select("patch_id", "y", "x", "ts", "edge")


TARGETS = f"(SELECT DISTINCT patch_id, y, x, g AS ts FROM {EVENTS}, (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-28', INTERVAL 3 DAY)) AS g))"
AROUND = f"""(SELECT k.*, epoch_us(k.ts) AS t, epoch_us(p.ts) AS t0, p.v AS v0, epoch_us(n.ts) AS t1, n.v AS v1 FROM {TARGETS} k
  ASOF LEFT JOIN (SELECT * FROM {SERIES} WHERE v IS NOT NULL) p ON k.patch_id = p.patch_id AND k.y = p.y AND k.x = p.x AND k.ts >= p.ts
  ASOF LEFT JOIN (SELECT * FROM {SERIES} WHERE v IS NOT NULL) n ON k.patch_id = n.patch_id AND k.y = n.y AND k.x = n.x AND k.ts <= n.ts)"""


def _targets(px: DataFrame) -> DataFrame:
    return timeseries.grid_of(px.select("patch_id", "y", "x").distinct(), "2024-01-02", "2024-01-29", 3)


@query(f"SELECT {PIX}, ts, round({LINE}, 3) AS v FROM {AROUND}")
def interp_resample_grid(spark: SparkSession, d: str) -> DataFrame:
    px = series(spark, d)
    return timeseries.resample(px, _targets(px)).withColumn("v", F.round("v", 3))


@query(f"SELECT {PIX}, ts, round(CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN CASE WHEN t - t0 <= t1 - t THEN v0 ELSE v1 END END, 5) AS v FROM {AROUND}")
def resample_nearest(spark: SparkSession, d: str) -> DataFrame:
    px = series(spark, d)
    return timeseries.resample(px, _targets(px), "nearest").withColumn("v", F.round("v", 5))


@query(f"SELECT {PIX}, ts, round(v0, 5) AS v FROM {AROUND}")
def resample_previous(spark: SparkSession, d: str) -> DataFrame:
    px = series(spark, d)
    return timeseries.resample(px, _targets(px), "previous").withColumn("v", F.round("v", 5))


@query(f"SELECT {PIX}, ts, coalesce(round(CASE WHEN v IS NOT NULL THEN least(greatest(v, 10), 60) END, 5), -1) AS v FROM {SERIES}")
def interp_clip_fill(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).withColumn("v", F.round(timeseries.clipped(F.col("v"), 10, 60, -1), 5))


@query(f"SELECT {PIX}, round(quantile_cont(v, 0.8), 3) AS v FROM {EVENTS} GROUP BY ALL")
def percentile_linear(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.percentile(events(spark, d), 80).withColumn("v", F.round("v", 3))


@query(f"SELECT {PIX}, s[CAST(round_even(0.8 * (len(s) - 1), 0) AS BIGINT) + 1] AS v FROM (SELECT patch_id, y, x, list_sort(list(v)) AS s FROM {EVENTS} GROUP BY ALL)")
def percentile_nearest(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.percentile(events(spark, d), 80, method="nearest")


@query(f"SELECT {PIX}, CASE WHEN count(v) > 0 THEN max(v) END AS most, count(v) AS n FROM (SELECT patch_id, y, x, CASE WHEN event_type <> 'view' THEN v END AS v FROM {EVENTS}) GROUP BY ALL")
def ignoring_nan(spark: SparkSession, d: str) -> DataFrame:
    """NaN counts as missing in reductions."""
    px = events(spark, d).withColumn("v", F.when(F.col("event_type") != "view", F.col("v")).otherwise(float("nan")))
    return px.groupBy("patch_id", "y", "x").agg(F.max(number(F.col("v"))).alias("most"), F.count(number(F.col("v"))).alias("n"))


def _curve(spark: SparkSession, d: str, kind: str, **options) -> DataFrame:
    px = series(spark, d)
    return timeseries.fill_with(px, kind, _targets(px), **options)


KNOTS = f"""p AS (SELECT {PIX}, ts, epoch_us(ts) / 86400e6 AS t, v, lead(epoch_us(ts) / 86400e6) OVER s AS t1, lead(v) OVER s AS v1, lag(epoch_us(ts) / 86400e6) OVER s AS t0, lag(v) OVER s AS v0,
  row_number() OVER s AS i, count(*) OVER (PARTITION BY {PIX}) AS n FROM {SERIES} WHERE v IS NOT NULL WINDOW s AS (PARTITION BY {PIX} ORDER BY ts))"""
AT_KNOT = "ASOF LEFT JOIN c ON k.patch_id = c.patch_id AND k.y = c.y AND k.x = c.x AND k.ts >= c.ts"


@query(f"""
WITH RECURSIVE {KNOTS}, down AS (  -- elimination in the tridiagonal system of second derivatives, all series at once
  SELECT {PIX}, i, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM p WHERE i = 1
  UNION ALL SELECT p.patch_id, p.y, p.x, p.i, (p.t1 - p.t) / (2 * (p.t1 - p.t0) - (p.t - p.t0) * d.a), (6 * ((p.v1 - p.v) / (p.t1 - p.t) - (p.v - p.v0) / (p.t - p.t0)) - (p.t - p.t0) * d.b) / (2 * (p.t1 - p.t0) - (p.t - p.t0) * d.a)
  FROM down d JOIN p ON p.patch_id = d.patch_id AND p.y = d.y AND p.x = d.x AND p.i = d.i + 1 WHERE p.i < p.n
), up AS (
  SELECT {PIX}, i, CAST(0 AS DOUBLE) AS m FROM p WHERE i = n
  UNION ALL SELECT d.patch_id, d.y, d.x, d.i, d.b - d.a * u.m FROM up u JOIN down d ON d.patch_id = u.patch_id AND d.y = u.y AND d.x = u.x AND d.i = u.i - 1
), c AS (SELECT p.*, u.m, lead(u.m) OVER (PARTITION BY p.patch_id, p.y, p.x ORDER BY p.i) AS m1 FROM p JOIN up u USING (patch_id, y, x, i)
), k AS (SELECT *, epoch_us(ts) / 86400e6 AS g FROM {TARGETS})
SELECT k.patch_id, k.y, k.x, k.ts, round(CASE WHEN n < 2 THEN NULL WHEN g = t THEN v ELSE
  (m * (t1 - g) ^ 3 + m1 * (g - t) ^ 3) / (6 * (t1 - t)) + (v / (t1 - t) - m * (t1 - t) / 6) * (t1 - g) + (v1 / (t1 - t) - m1 * (t1 - t) / 6) * (g - t) END, 4) + 0.0 AS v FROM k {AT_KNOT}""")
def interp_cubic(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d, "cubic").withColumn("v", F.round("v", 4) + 0.0)


@query()
def interp_spline(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d, "spline", degree=3)


@query(f"""
WITH {KNOTS}, s AS (SELECT *, (v1 - v) / (t1 - t) AS m FROM p), e AS (  -- two slopes before and after each point, extrapolated at the ends
  SELECT *, lag(m) OVER w AS b, lag(m, 2) OVER w AS bb, lead(m) OVER w AS f FROM s WINDOW w AS (PARTITION BY {PIX} ORDER BY i)
), g AS (SELECT *, CASE WHEN i = 1 THEN 3 * m - 2 * f WHEN i = 2 THEN 2 * b - CASE WHEN n = 2 THEN b ELSE m END ELSE bb END AS m0, CASE WHEN i = 1 THEN 2 * m - f ELSE b END AS m1,
  CASE WHEN i = n THEN 2 * b - bb ELSE m END AS m2, CASE WHEN i = n THEN 3 * b - 2 * bb WHEN i = n - 1 THEN 2 * m - b ELSE f END AS m3 FROM e
), o AS (SELECT *, CASE WHEN n = 2 THEN coalesce(m, b) WHEN abs(m3 - m2) + abs(m1 - m0) < 1e-12 THEN (m1 + m2) / 2 ELSE (abs(m3 - m2) * m1 + abs(m1 - m0) * m2) / (abs(m3 - m2) + abs(m1 - m0)) END AS d FROM g
), c AS (SELECT *, lead(d) OVER (PARTITION BY {PIX} ORDER BY i) AS d1 FROM o), k AS (SELECT *, epoch_us(ts) / 86400e6 AS q FROM {TARGETS})
SELECT k.patch_id, k.y, k.x, k.ts, round(CASE WHEN n < 2 THEN NULL WHEN q = t THEN v ELSE
  v + (q - t) * (d + (q - t) * ((3 * m - 2 * d - d1) / (t1 - t) + (q - t) * (d + d1 - 2 * m) / (t1 - t) ^ 2)) END, 4) + 0.0 AS v FROM k {AT_KNOT}""")
def interp_akima(spark: SparkSession, d: str) -> DataFrame:
    """Windows only: neither a UDF nor a group for each series."""
    return _curve(spark, d, "akima").withColumn("v", F.round("v", 4) + 0.0)


@query()
def interp_kriging(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d, "kriging")


@query(f"SELECT label, patch_id, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS deviation FROM {IMAGES} GROUP BY ALL")
def image_means(spark: SparkSession, d: str) -> DataFrame:
    return images(spark, d).groupBy("label", "patch_id").agg(F.round(F.avg("v"), 5).alias("mean"), F.round(F.stddev_pop("v"), 5).alias("deviation"))
