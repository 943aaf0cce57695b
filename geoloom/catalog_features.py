"""Queries: projections, filters, masks, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.bridge import CLASSES, EVENTS, IMAGES, LINES, classes, events, images, lines, pixels, table
from geoloom.catalog import query
from geoloom.operators import filters, masking, merge, projection
from geoloom.patchset import PatchSet
from geoloom.session import materialize
from geoloom.types import FeatureType

KEY = ["patch_id", "ts", "l_orderkey", "l_linenumber"]
KEYS = ", ".join(KEY)
FRAME = ["patch_id", "ts"]


def rounded(c, digits: int = 5):
    return F.round(c, digits)


def day(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))


@query(f"""
WITH px AS (SELECT *, (bands[2] / 1000 - bands[1]) / (bands[2] / 1000 + bands[1]) AS idx, flag <> 'R' AS valid FROM {LINES}),
frames AS (SELECT patch_id, ts FROM px GROUP BY patch_id, ts HAVING avg(CAST(valid AS DOUBLE)) >= 0.5)
SELECT patch_id, ts, count(*) FILTER (WHERE valid) AS n_valid, round(avg(idx) FILTER (WHERE valid), 5) AS level
FROM px JOIN frames USING (patch_id, ts) GROUP BY patch_id, ts""")
def water_level(spark: SparkSession, d: str) -> DataFrame:
    """Index, valid mask, frames with enough valid pixels, mean level of each frame."""
    px = lines(spark, d).withColumn("valid", F.col("flag") != "R")
    scaled = px.withColumn("bands", F.array(F.element_at("bands", 2) / 1000, F.element_at("bands", 1)))
    index = projection.ndi(scaled, (0, 1))
    frames = filters.kept_frames(index, F.avg(F.col("valid").cast("double")) >= 0.5)
    kept = filters.keep_frames(index, frames)
    return kept.groupBy(*FRAME).agg(F.count_if("valid").alias("n_valid"), rounded(F.avg(F.when(F.col("valid"), F.element_at("bands", 1)))).alias("level"))


@query(f"SELECT {KEYS}, round(CASE WHEN bands[3] + bands[4] <> 0 THEN (bands[3] - bands[4]) / (bands[3] + bands[4]) END, 6) AS ndi FROM {LINES}")
def ndi(spark: SparkSession, d: str) -> DataFrame:
    return projection.ndi(lines(spark, d), (2, 3)).select(*KEY, rounded(F.element_at("bands", 1), 6).alias("ndi"))


@query(f"SELECT {KEYS}, round(CASE WHEN p + q - 5 <> 0 THEN (p - q - 5) / (p + q - 5) ELSE -9 END, 4) + 0.0 AS ndi FROM (SELECT *, round(bands[3] * 100) AS p, round(bands[4] * 100) AS q FROM {LINES})")
def ndi_constant(spark: SparkSession, d: str) -> DataFrame:
    """Of whole per cents, so that a sum of zero is exactly zero and takes the undefined value."""
    px = lines(spark, d).withColumn("bands", F.transform("bands", lambda v: F.round(v * 100)))
    return projection.ndi(px, (2, 3), constant=-5, undefined=-9).select(*KEY, rounded(F.element_at("bands", 1), 4).alias("ndi"))


@query(f"SELECT {KEYS}, bands[4] AS b0, bands[1] AS b1 FROM {LINES}")
def extract_bands(spark: SparkSession, d: str) -> DataFrame:
    return projection.extract_bands(lines(spark, d), [3, 0]).select(*KEY, F.get("bands", F.lit(0)).alias("b0"), F.get("bands", F.lit(1)).alias("b1"))


@query(f"SELECT {KEYS}, 'one' AS feature, 0 AS b, bands[3] AS v FROM {LINES} UNION ALL SELECT {KEYS}, 'two', 0, bands[1] FROM {LINES} UNION ALL SELECT {KEYS}, 'two', 1, bands[2] FROM {LINES}")
def explode_bands(spark: SparkSession, d: str) -> DataFrame:
    out = projection.explode_bands(lines(spark, d), {"one": 2, "two": [0, 1]})
    parts = [df.select(*KEY, F.lit(n).alias("feature"), F.posexplode("bands").alias("b", "v")) for n, df in out.items()]
    return projection.merge_frames(parts)


@query("SELECT vec_id AS patch_id, b - 1 AS b, CAST(embedding[CASE WHEN b <= 3 THEN b ELSE b + 7 END] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 6)) AS b)")
def merge_bands(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    a, b = projection.extract_bands(px, [0, 1, 2]), projection.extract_bands(px, [10, 11])
    return projection.merge_bands([a, b], ["patch_id"]).select("patch_id", F.posexplode("bands").alias("b", "v"))


@query("SELECT vec_id AS patch_id, 64 AS n, 7 AS least, 7 AS most FROM embeddings")
def initialize_like(spark: SparkSession, d: str) -> DataFrame:
    return projection.initialize_like(pixels(spark, d), 7).select("patch_id", F.size("bands").alias("n"), F.array_min("bands").alias("least"), F.array_max("bands").alias("most"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS patch_id, i // 4 AS y, i % 4 AS x, 2 AS n_bands, 5 AS v FROM nation, (SELECT CAST(unnest(range(0, 12)) AS INT) AS i)")
def initialize_grid(spark: SparkSession, d: str) -> DataFrame:
    patches = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("patch_id"))
    return projection.initialize(spark, patches, 3, 4, 2, 5).select("patch_id", "y", "x", F.size("bands").alias("n_bands"), F.element_at("bands", 2).alias("v"))


@query(f"SELECT 'copy' AS feature, patch_id, y, x, v FROM {IMAGES} UNION ALL SELECT 'new', patch_id, y, x, v FROM {IMAGES}")
def rename_duplicate_remove(spark: SparkSession, d: str) -> DataFrame:
    """The registry's operations; none of them touches rows."""
    image = images(spark, d).select("patch_id", "y", "x", F.array("v").alias("bands"))
    kind = FeatureType.DATA_TIMELESS
    patches = PatchSet({(kind, "old"): image, (kind, "gone"): image}).duplicate((kind, "old", "copy")).rename((kind, "old", "new")).without((kind, "gone"))
    return projection.merge_frames([df.select(F.lit(n).alias("feature"), "patch_id", "y", "x", F.element_at("bands", 1).alias("v")) for (_, n), df in patches.features.items()])


@query(f"SELECT {KEYS}, b - 1 AS b, round(bands[b] * 2 + 1, 4) AS v FROM {LINES}, (SELECT unnest(range(1, 5)) AS b)")
def map_scale(spark: SparkSession, d: str) -> DataFrame:
    return projection.map_bands(lines(spark, d), lambda v: v * 2 + 1).select(*KEY, F.posexplode("bands").alias("b", "v")).withColumn("v", rounded(F.col("v"), 4))


@query("SELECT a.vec_id AS patch_id, b - 1 AS b, round(CASE WHEN abs(a.embedding[b]) > 0.01 THEN CAST(a.embedding[b + 8] AS DOUBLE) / CAST(a.embedding[b] AS DOUBLE) END, 3) AS v FROM embeddings a, (SELECT unnest(range(1, 9)) AS b)")
def zip_ratio(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    a, b = projection.extract_bands(px, range(8)), projection.extract_bands(px, range(8, 16))
    ratio = projection.zip_features([a, b], ["patch_id"], lambda p, q: F.zip_with(p, q, lambda u, v: F.when(F.abs(u) > F.lit(0.01).cast("float"), v / u)))
    return ratio.select("patch_id", F.posexplode("bands").alias("b", "v")).withColumn("v", rounded(F.col("v"), 3))


@query(f"SELECT patch_id, y, x, v FROM {IMAGES} UNION ALL SELECT patch_id, y, x + 8, v FROM {IMAGES} UNION ALL SELECT patch_id, y, x + 16, v FROM {IMAGES}")
def merge_space(spark: SparkSession, d: str) -> DataFrame:
    image = images(spark, d).select("patch_id", "y", "x", "v")
    return projection.merge_space([image] * 3, "x", [8, 8, 8])


@query(f"SELECT patch_id, y, x, round(least(greatest(v * 3.5, 0), 1), 5) AS v FROM {IMAGES}")
def rgb_prepare(spark: SparkSession, d: str) -> DataFrame:
    px = images(spark, d).withColumn("bands", F.array("v", "v", "v"))
    return projection.rgb(px).select("patch_id", "y", "x", rounded(F.element_at("bands", 1)).alias("v"))


@query(f"SELECT patch_id, y, x, CAST(least(greatest(round_even(v * 100, 0), -5), 5) AS SMALLINT) AS v FROM {IMAGES}")
def cast_within(spark: SparkSession, d: str) -> DataFrame:
    return images(spark, d).select("patch_id", "y", "x", projection.cast_within(F.col("v") * 100, -5, 5, "smallint").alias("v"))


@query(f"SELECT patch_id, (dense_rank() OVER (PARTITION BY patch_id ORDER BY ts) - 1) * 4 + b - 1 AS channel, bands[b] AS v FROM {LINES}, (SELECT unnest(range(1, 5)) AS b)")
def bands_to_channels(spark: SparkSession, d: str) -> DataFrame:
    return projection.bands_to_channels(lines(spark, d)).select("patch_id", F.col("channel").cast("long").alias("channel"), "v")


@query("SELECT vec_id AS patch_id, (i - 1) // 16 AS t_idx, (i - 1) % 16 AS b, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)")
def channels_to_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = pixels(spark, d).select("patch_id", F.posexplode("bands").alias("channel", "v"))
    return projection.channels_to_bands(rows, 16).select("patch_id", F.col("t_idx").cast("long").alias("t_idx"), F.col("b").cast("long").alias("b"), "v")


@query(f"SELECT event_id, patch_id, y, x, ts, v FROM {EVENTS} WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'")
def filter_dates(spark: SparkSession, d: str) -> DataFrame:
    return filters.between_dates(events(spark, d), "2024-01-05", "2024-01-12 12:00:00").select("event_id", "patch_id", "y", "x", "ts", "v")


@query(f"SELECT event_id, patch_id, ts FROM (SELECT event_id, patch_id, date_trunc('day', ts) AS ts, dense_rank() OVER (PARTITION BY patch_id ORDER BY date_trunc('day', ts)) - 1 AS t FROM {EVENTS}) WHERE t IN (0, 2, 5)")
def temporal_subset_indices(spark: SparkSession, d: str) -> DataFrame:
    return filters.at_indices(day(events(spark, d)), [5, 0, 2]).select("event_id", "patch_id", "ts")


@query(f"SELECT event_id, patch_id, date_trunc('day', ts) AS ts FROM {EVENTS} WHERE date_trunc('day', ts) IN (TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-20')")
def temporal_subset_list(spark: SparkSession, d: str) -> DataFrame:
    return filters.at_times(day(events(spark, d)), ["2024-01-03", "2024-01-20", "2031-01-01"]).select("event_id", "patch_id", "ts")


@query(f"SELECT event_id, patch_id, date_trunc('day', ts) AS ts FROM {EVENTS} WHERE dayofmonth(ts) % 7 = 1")
def temporal_subset_function(spark: SparkSession, d: str) -> DataFrame:
    px = day(events(spark, d))
    return filters.keep_frames(px, filters.by_times(px, lambda ts: [t.day % 7 == 1 for t in ts])).select("event_id", "patch_id", "ts")


@query(f"""
WITH px AS (SELECT *, date_trunc('day', ts) AS day FROM {EVENTS}), kept AS (SELECT patch_id, day FROM px GROUP BY patch_id, day HAVING avg(CAST(event_type <> 'error' AS DOUBLE)) >= 0.8)
SELECT event_id, patch_id, day AS ts FROM px SEMI JOIN kept USING (patch_id, day)""")
def filter_coverage(spark: SparkSession, d: str) -> DataFrame:
    px = day(events(spark, d))
    kept = filters.coverage(px, F.col("event_type") != "error").where("coverage >= 0.8")
    return filters.keep_frames(px, kept).select("event_id", "patch_id", "ts")


@query(f"SELECT DISTINCT patch_id, date_trunc('day', ts) AS ts FROM {EVENTS} WHERE dayofmonth(ts) > 20")
def removed_frames(spark: SparkSession, d: str) -> DataFrame:
    px = day(events(spark, d))
    return filters.removed_frames(px, px.where(F.dayofmonth("ts") <= 20))


@query(f"SELECT event_id, patch_id, ts, event_type FROM {EVENTS} WHERE event_type IN ('click', 'purchase')")
def filter_values(spark: SparkSession, d: str) -> DataFrame:
    return filters.with_values(events(spark, d), "event_type", ["click", "purchase"]).select("event_id", "patch_id", "ts", "event_type")


@query(f"SELECT e.event_id, e.patch_id, e.ts FROM {EVENTS} e SEMI JOIN (SELECT DISTINCT patch_id, ts FROM {EVENTS} WHERE v > 90) k ON e.patch_id = k.patch_id AND e.ts = k.ts")
def vector_to_frames(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and frames of a patch set cut to the same frames."""
    px = events(spark, d)
    vectors = px.withColumnRenamed("ts", "TIMESTAMP").select("event_id", "patch_id", "TIMESTAMP")
    kept = filters.filter_patch_set(PatchSet({(FeatureType.VECTOR, "events"): vectors}), px.where("v > 90").select("patch_id", "ts").distinct())
    return kept[FeatureType.VECTOR, "events"].withColumnRenamed("TIMESTAMP", "ts").select("event_id", "patch_id", "ts")


@query(f"SELECT a.event_id, b.event_id AS request_id, a.patch_id FROM {EVENTS} a JOIN (SELECT * FROM {EVENTS} WHERE event_type = 'signup') b ON a.patch_id = b.patch_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600 * 1000000")
def within_time(spark: SparkSession, d: str) -> DataFrame:
    px = events(spark, d)
    wanted = px.where("event_type = 'signup'").select("patch_id", "ts", F.col("event_id").alias("request_id"))
    return filters.within_time(px, wanted, 600).select("event_id", "request_id", "patch_id")


@query(f"""
WITH RECURSIVE f AS (SELECT DISTINCT patch_id, ts FROM {EVENTS}), kept AS (
  SELECT patch_id, min(ts) AS ts FROM f GROUP BY patch_id
  UNION ALL
  SELECT patch_id, ts FROM (SELECT kept.patch_id, (SELECT min(f.ts) FROM f WHERE f.patch_id = kept.patch_id AND f.ts > kept.ts + INTERVAL 6 HOUR) AS ts FROM kept) WHERE ts IS NOT NULL
) SELECT patch_id, ts FROM kept""")
def spaced_frames(spark: SparkSession, d: str) -> DataFrame:
    return filters.spaced(events(spark, d), 6 * 3600)


@query(f"SELECT {KEYS}, b - 1 AS b, CASE WHEN flag IN ('R', 'A') THEN -1 ELSE bands[b] END AS v FROM {LINES}, (SELECT unnest(range(1, 5)) AS b)")
def mask_values(spark: SparkSession, d: str) -> DataFrame:
    """A one-band mask over four bands. Frames of this table may repeat a key, so pixels are numbered and the mask goes by number."""
    px = materialize(lines(spark, d).withColumn("pixel", F.monotonically_increasing_id()), "mask-pixels")
    code = F.when(F.col("flag") == "R", 1).when(F.col("flag") == "A", 2).otherwise(0)
    out = masking.mask_feature(px, px.select("pixel", F.array(code).alias("bands")), ["pixel"], (1, 2), -1.0)
    return out.select(*KEY, F.posexplode("bands").alias("b", "v"))


@query(f"SELECT e.event_id, e.patch_id, e.ts, CASE WHEN (y + x) % 3 = 0 THEN NULL ELSE v END AS v FROM {EVENTS} e")
def mask_timeless(spark: SparkSession, d: str) -> DataFrame:
    """A timeless mask over all frames."""
    px = events(spark, d).withColumn("bands", F.array("v"))
    mask = px.select("patch_id", "y", "x").distinct().withColumn("bands", F.array(((F.col("y") + F.col("x")) % 3).cast("int")))
    return masking.mask_feature(px, mask, ["patch_id", "y", "x"], [0]).select("event_id", "patch_id", "ts", F.element_at("bands", 1).alias("v"))


MASKS = f"(SELECT patch_id, y, x, v > 0 AS a, v % 2 = 1 AS b, v = 3 AS c FROM {CLASSES})"


def _masks(spark: SparkSession, d: str) -> list[DataFrame]:
    px = classes(spark, d)
    return [px.select("patch_id", "y", "x", F.array(c).alias("bands")) for c in (F.col("v") > 0, F.col("v") % 2 == 1, F.col("v") == 3)]


def _joined(spark: SparkSession, d: str, how) -> DataFrame:
    return masking.join_masks(_masks(spark, d), ["patch_id", "y", "x"], how).select("patch_id", "y", "x", F.element_at("bands", 1).alias("v"))


@query(f"SELECT patch_id, y, x, a AND b AND c AS v FROM {MASKS}")
def join_masks_and(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, "and")


@query(f"SELECT patch_id, y, x, a OR b OR c AS v FROM {MASKS}")
def join_masks_or(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, "or")


@query(f"SELECT patch_id, y, x, (a <> b) <> c AS v FROM {MASKS}")
def join_masks_xor(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, "xor")


@query(f"SELECT patch_id, y, x, a AND NOT b AND NOT c AS v FROM {MASKS}")
def join_masks_function(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, lambda a, b: a & ~b)


@query(f"""
SELECT {KEYS}, coalesce((n >= 0.1 OR abs(m - 0.1) < 0.05) AND g >= 0.04, FALSE) AS snow FROM (
  SELECT *, CASE WHEN bands[3] + bands[4] <> 0 THEN (bands[3] - bands[4]) / (bands[3] + bands[4]) END AS n, (bands[2] / 1000 - bands[1]) / (bands[2] / 1000 + bands[1]) AS m, bands[3] AS g FROM {LINES})""")
def snow_rule(spark: SparkSession, d: str) -> DataFrame:
    b = lambda i: F.element_at("bands", i)
    return lines(spark, d).select(*KEY, masking.snow(b(3), b(1), b(2) / 1000, b(4), 0.1, 0.04).alias("snow"))


PARTS = f"(SELECT patch_id, y, x, date_trunc('day', ts) AS ts, v, event_id % 2 AS part FROM {EVENTS})"


def _parts(spark: SparkSession, d: str) -> list[DataFrame]:
    px = day(events(spark, d))
    return [px.where(F.col("event_id") % 2 == k).select("patch_id", "ts", "y", "x", "v") for k in (0, 1)]


def _merged(spark: SparkSession, d: str, how) -> DataFrame:
    return merge.merge_values(_parts(spark, d), ["patch_id", "ts", "y", "x"], how).withColumn("v", rounded(F.col("v")))


def _merge_sql(f: str) -> str:
    return f"SELECT patch_id, ts, y, x, round({f}(v), 5) AS v FROM {PARTS} GROUP BY patch_id, ts, y, x"


@query(_merge_sql("min"))
def merge_min(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "min")


@query(_merge_sql("max"))
def merge_max(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "max")


@query(_merge_sql("avg"))
def merge_mean(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "mean")


@query(_merge_sql("median"))
def merge_median(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "median")


@query(f"SELECT patch_id, y, x, v FROM {IMAGES}")
def merge_equal(spark: SparkSession, d: str) -> DataFrame:
    """Without an operation values that meet must be equal; each image is given twice."""
    px = images(spark, d).select("patch_id", "y", "x", "v")
    return merge.merge_values([px, px.where("patch_id % 2 = 0")], ["patch_id", "y", "x"])


@query(_merge_sql("max(v) - min"))
def merge_function(spark: SparkSession, d: str) -> DataFrame:
    """Merging by a function of one's own: the spread of the values that meet."""
    return _merged(spark, d, lambda v: v.max() - v.min())


@query(f"SELECT patch_id, ts, y, x, v, CAST(part AS INT) AS source FROM {PARTS}")
def merge_concat_frames(spark: SparkSession, d: str) -> DataFrame:
    return merge.concat_frames(_parts(spark, d))


@query("SELECT vec_id AS patch_id, b - 1 AS b, CAST(embedding[CASE b WHEN 1 THEN 6 WHEN 2 THEN 1 ELSE 2 END] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 4)) AS b)")
def merge_concat_bands(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    parts = [projection.extract_bands(px, at) for at in ([5], [0, 1])]
    return merge.concat_bands(parts, ["patch_id"]).select("patch_id", F.posexplode("bands").alias("b", "v"))


@query(f"SELECT DISTINCT patch_id, date_trunc('day', ts) AS ts, event_type FROM {EVENTS}")
def merge_vectors(spark: SparkSession, d: str) -> DataFrame:
    px = day(events(spark, d))
    return merge.merge_vectors([px.where(F.col("event_id") % 3 == k).select("patch_id", "ts", "event_type") for k in range(3)])


@query(f"SELECT patch_id, 'k' AS name, arg_min(props, part) AS value, count(DISTINCT props) > 1 AS conflict FROM (SELECT patch_id, event_id % 3 AS part, arg_min(props, event_id) AS props FROM {EVENTS} GROUP BY ALL) GROUP BY patch_id")
def merge_meta(spark: SparkSession, d: str) -> DataFrame:
    px = events(spark, d)
    parts = [px.where(F.col("event_id") % 3 == k).groupBy("patch_id").agg(F.min_by("props", "event_id").alias("value")).withColumn("name", F.lit("k")) for k in range(3)]
    return merge.merge_meta(parts)


@query(f"SELECT DISTINCT patch_id, date_trunc('hour', ts) AS ts FROM {EVENTS} WHERE event_type IN ('view', 'error')")
def merge_timestamps(spark: SparkSession, d: str) -> DataFrame:
    px = events(spark, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return merge.merge_timestamps([px.where(F.col("event_type") == t) for t in ("view", "error")])


@query(f"SELECT patch_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM {EVENTS} GROUP BY ALL")
def meta_from_json(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("patch_id", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))
