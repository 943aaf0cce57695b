"""The patch store, and importers and exporters of single files."""

import gzip
import io
import json
import os
import sqlite3
import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.patchset import PatchSet
from geoloom.session import ROOT, shared_dir
from geoloom.sources import files, imagery, store, synthetic
from geoloom.types import FeatureType, MissingFeatureError, OverwritePermission

T = FeatureType
DAYS = [datetime(2024, 1, d) for d in (1, 2, 3)]


def cube(spark, days=DAYS, value=0.0):
    rows = [(p, t, y, x, [value + 10 * p + k]) for p in range(3) for k, t in enumerate(days) for y in range(2) for x in range(2)]
    return spark.createDataFrame(rows, "patch_id long, ts timestamp_ntz, y int, x int, bands array<double>")


@pytest.fixture
def patches(spark):
    boxes = spark.createDataFrame([(p, 0.0, 0.0, 2.0, 2.0, 32633) for p in range(3)], "patch_id long, min_x double, min_y double, max_x double, max_y double, crs int")
    frames = spark.createDataFrame([(p, t) for p in range(3) for t in DAYS], "patch_id long, ts timestamp_ntz")
    meta = spark.createDataFrame([(0, "who", '"me"')], "patch_id long, name string, value string")
    return PatchSet({(T.DATA, "bands"): cube(spark), (T.META_INFO, "info"): meta}, boxes, frames)


def test_permissions_and_names(spark, patches, tmp_path):
    root = str(tmp_path / "store")
    store.save(patches, root)
    assert store.exists(spark, root) and not store.exists(spark, root + "x") and store.children(spark, root + "x") == []
    assert store.stored(spark, root) == [(T.DATA, "bands"), (T.META_INFO, "info")] and store.stored(spark, root, [T.MASK]) == []
    assert store.load(spark, root).equals(patches)
    with pytest.raises(ValueError, match="already"):
        store.save(patches, root)
    with pytest.raises(OSError, match="letter case"):
        store.save(patches.rename((T.DATA, "bands", "BANDS")), root, (T.DATA, "BANDS"), "OVERWRITE_FEATURES")
    store.save(PatchSet({(T.DATA, "bands"): cube(spark, value=100.0).where("patch_id = 1")}), root, permission="overwrite_features")
    back = store.load(spark, root, [T.DATA])[T.DATA, "bands"]
    assert {r.patch_id: r.v for r in back.groupBy("patch_id").agg(F.min(F.col("bands")[0]).alias("v")).collect()} == {0: 0.0, 1: 110.0, 2: 20.0}
    store.save(PatchSet({(T.DATA, "other"): cube(spark)}), root, permission=OverwritePermission.OVERWRITE_PATCH)
    assert store.stored(spark, root) == [(T.DATA, "other")]
    store.save(PatchSet(), str(tmp_path / "nothing"))
    with pytest.raises(MissingFeatureError):
        store.load(spark, root, (T.DATA, "bands"))


def test_partial_loads_and_frames(spark, patches, tmp_path):
    root = str(tmp_path / "store")
    store.save(patches, root)
    days = lambda times: sorted({r.ts.day for r in store.load(spark, root, times=times)[T.DATA, "bands"].collect()})
    assert days(F.col("ts") > F.lit(DAYS[0])) == [2, 3] and days([DAYS[1]]) == [2] and days([0, 2]) == [1, 3] and days(lambda ts: [t.day == 3 for t in ts]) == [3]
    assert {r.patch_id for r in store.load(spark, root, patch_ids=[1])[T.DATA, "bands"].collect()} == {1}
    later = PatchSet({(T.DATA, "bands"): cube(spark, [DAYS[2]], 500.0)}, frames=patches.frames.where(F.col("ts") == DAYS[2]))
    assert store.infer_times(later, root).count() == 3
    store.save(PatchSet({(T.DATA, "bands"): cube(spark, value=500.0)}), root, times=F.col("ts") == DAYS[2])
    assert {r.ts.day: r.v for r in store.load(spark, root)[T.DATA, "bands"].where("patch_id = 0").groupBy("ts").agg(F.max(F.col("bands")[0]).alias("v")).collect()} == {1: 0.0, 2: 1.0, 3: 502.0}
    with pytest.raises(ValueError, match="lacks"):
        store.infer_times(PatchSet({}, frames=spark.createDataFrame([(0, datetime(2030, 1, 1))], "patch_id long, ts timestamp_ntz")), root)
    plain = str(tmp_path / "plain")
    store.save(PatchSet({(T.META_INFO, "info"): patches[T.META_INFO, "info"]}), plain)
    with pytest.raises(MissingFeatureError):
        store.load(spark, plain, times=[0])


def parts(root, name="DATA/bands"):
    """Data files of a feature in the folder, whether they belong to its state or not."""
    from pathlib import Path

    return sorted(p.name for p in Path(root, *name.lower().split("/")).rglob("part-*.parquet"))


def test_files_hold_many_frames_and_are_picked_by_range(spark, tmp_path):
    root, days = str(tmp_path / "store"), [datetime(2024, 1, d) for d in range(1, 31)]
    rows = spark.range(40 * 30 * 4).select((F.col("id") % 40).alias("patch_id"), F.timestamp_add("DAY", F.expr("id div 40 % 30").cast("int"), F.lit(days[0]).cast("timestamp_ntz")).alias("ts"), F.expr("id div 1200").cast("int").alias("y"), F.lit(0).alias("x"), F.array(F.col("id").cast("double")).alias("bands"))
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.save(PatchSet({(T.DATA, "bands"): rows}, frames=rows.select("patch_id", "ts").distinct()), root)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    at = f"{root}/data/bands"
    schema, files = store.manifest(spark, at)
    assert 1 < len(files) <= 8 and sum(f["rows"] for f in files) == 4800 and len(parts(root)) == len(files) and schema == rows.schema
    assert all(a["patch_to"] <= b["patch_from"] for a, b in zip(files, files[1:]))
    one = store.load(spark, root, [T.DATA], [3])[T.DATA, "bands"]
    assert len(one.inputFiles()) < len(files) and one.count() == 120
    assert store.load(spark, root, [T.DATA], [3], [days[4]])[T.DATA, "bands"].count() == 4
    assert store.load(spark, root, [T.DATA], [99])[T.DATA, "bands"].count() == 0
    # one frame of one patch goes: only the files that may hold it are written anew
    new = rows.where("patch_id = 3 and y < 2").withColumn("bands", F.array(F.lit(-1.0)))
    store.save(PatchSet({(T.DATA, "bands"): new}), root, times=F.col("ts") == F.lit(days[4]).cast("timestamp_ntz"))
    after = store.manifest(spark, at)[1]
    assert len({f["path"] for f in files} & {f["path"] for f in after}) >= len(files) - 2 and sum(f["rows"] for f in after) == 4798
    back = store.load(spark, root)[T.DATA, "bands"]
    assert back.where("patch_id = 3 and bands[0] = -1").count() == 2 and back.where("bands[0] >= 0").count() == 4796


def test_a_failed_write_leaves_the_old_state(spark, patches, tmp_path):
    root = str(tmp_path / "store")
    store.save(patches, root)
    bad = cube(spark).withColumn("bands", F.when(F.col("patch_id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("bands")))
    fine = PatchSet({(T.DATA, "bands"): cube(spark, value=9.0), (T.DATA, "broken"): bad})
    with pytest.raises(Exception, match="broken"):
        store.save(fine, root, permission="OVERWRITE_PATCH")
    assert store.stored(spark, root) == [(T.DATA, "bands"), (T.META_INFO, "info")] and store.load(spark, root).equals(patches)
    store.save(PatchSet({(T.DATA, "broken"): cube(spark)}), root)
    assert (T.DATA, "broken") in store.stored(spark, root)


def test_readers_keep_their_state_and_old_files_go(spark, tmp_path):
    root = str(tmp_path / "store")
    store.save(PatchSet({(T.DATA, "bands"): cube(spark)}), root)
    first = store.load(spark, root)
    assert first[T.DATA, "bands"].count() == 36
    grown = PatchSet({(T.DATA, "bands"): first[T.DATA, "bands"].withColumn("bands", F.transform("bands", lambda v: v + 100))})
    store.save(grown, root, permission="overwrite_features")  # reads what it replaces
    assert first[T.DATA, "bands"].agg(F.max(F.col("bands")[0])).first()[0] == 22.0
    assert store.load(spark, root)[T.DATA, "bands"].agg(F.min(F.col("bands")[0])).first()[0] == 100.0
    two = len(parts(root))
    for k in range(3):
        store.save(PatchSet({(T.DATA, "bands"): cube(spark, value=float(k))}), root, permission="overwrite_features")
    assert len(parts(root)) <= two and len(store.versions(spark, f"{root}/data/bands")) == 2
    schema, files = store.manifest(spark, f"{root}/data/bands")
    with pytest.raises(OSError, match="another job"):
        store.publish(spark, f"{root}/data/bands", schema, files, store.versions(spark, f"{root}/data/bands")[-1] - 1)


def test_arrays_round_trip(spark, tmp_path):
    a, b = np.arange(24.0).reshape(2, 3, 2, 2), np.arange(6.0).reshape(2, 3)
    np.save(tmp_path / "a.npy", a)
    with gzip.open(tmp_path / "b.npy.gz", "wb") as f:
        np.save(f, b)
    rows = {(r.path.rsplit("/", 1)[1], r.ts_idx): (r.h, r.w, r.d, r.data) for r in files.read_arrays(spark, str(tmp_path)).collect()}
    assert rows["a.npy", 1] == (3, 2, 2, a[1].ravel().tolist()) and rows["b.npy.gz", 0] == (1, 1, 3, [0.0, 1.0, 2.0]) and len(rows) == 4
    flat = files.read_arrays(spark, str(tmp_path / "a.npy"), temporal=False) if False else files.read_arrays(spark, str(tmp_path), temporal=True)
    out = flat.where("path like '%a.npy'").select(F.lit(7).cast("long").alias("patch_id"), F.timestamp_add("DAY", "ts_idx", F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"), "h", "w", "d", "data")
    root = str(tmp_path / "out")
    assert [r.path for r in files.write_files(files.array_files(out, "x"), root).collect()] == ["7/x.npy.gz"]
    assert np.array_equal(np.load(io.BytesIO(gzip.decompress((tmp_path / "out/7/x.npy.gz").read_bytes()))), a)
    back = files.read_arrays(spark, root)
    assert sorted((r.ts_idx, r.data) for r in back.collect()) == [(k, a[k].ravel().tolist()) for k in range(2)]


def test_json_files(spark, tmp_path):
    at = tmp_path / "p1" / "meta_info"
    at.mkdir(parents=True)
    (tmp_path / "p1/timestamps.json").write_text(json.dumps(["2015-07-11T10:00:08", "2015-07-31T10:00:09Z", "2015-08-20T10:07:28+02:00"]))
    box = {"type": "Polygon", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32633"}}, "coordinates": [[[465181.0, 5079244.0], [465181.0, 5080254.0], [466180.0, 5080254.0], [466180.0, 5079244.0], [465181.0, 5079244.0]]]}
    (tmp_path / "p1/bbox.geojson").write_text(json.dumps(box))
    (at / "size_x.json").write_text("101")
    (at / "who.json").write_text('{"a": [1, 2]}')
    assert [r.ts for r in files.read_timestamps(spark, str(tmp_path)).orderBy("ts_idx").collect()] == [datetime(2015, 7, 11, 10, 0, 8), datetime(2015, 7, 31, 10, 0, 9), datetime(2015, 8, 20, 10, 7, 28)]
    r = files.read_boxes(spark, str(tmp_path)).first()
    assert (r.min_x, r.min_y, r.max_x, r.max_y, r.crs) == (465181.0, 5079244.0, 466180.0, 5080254.0, 32633)
    assert sorted((r.name, r.value) for r in files.read_meta(spark, str(tmp_path)).collect()) == [("size_x", "101"), ("who", '{"a": [1, 2]}')]
    assert files.as_json({"t": datetime(2024, 1, 2)}) == '{"t": "2024-01-02T00:00:00"}'
    with pytest.raises(TypeError):
        files.as_json(object())


def wkb(*rings, kind=3):
    body = b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)
    return struct.pack("<BII", 1, kind, len(rings)) + body


def test_geopackages(spark, tmp_path):
    square, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]
    multi = struct.pack("<BII", 1, 6, 2) + wkb(square) + wkb(hole)
    db = sqlite3.connect(tmp_path / "v.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('areas', 'geom')")
    db.execute("CREATE TABLE areas (fid INTEGER, geom BLOB, TIMESTAMP TEXT, VALUE REAL)")
    head = b"GP\0" + bytes([1]) + struct.pack("<i", 32633)
    enveloped = b"GP\0" + bytes([3]) + struct.pack("<i", 32633) + struct.pack("<4d", 0, 4, 0, 4)
    db.executemany("INSERT INTO areas VALUES (?, ?, ?, ?)", [(1, head + wkb(square, hole), "2024-01-02T03:04:05Z", 1.5), (2, enveloped + multi, None, None), (3, None, "2024-01-02", 2.0)])
    db.commit()
    db.close()
    rows = {json.loads(r.attributes)["fid"]: r for r in files.decoded(files.read_geopackage(spark, str(tmp_path))).collect()}
    points = lambda r: [[(p.x, p.y) for p in ring] for ring in r.rings]
    assert points(rows[1]) == points(rows[2]) == [square[:-1], hole[:-1]] and points(rows[3]) == []
    assert rows[1].ts == datetime(2024, 1, 2, 3, 4, 5) and rows[2].ts is None and rows[1].table == "areas" and json.loads(rows[1].attributes)["VALUE"] == 1.5


def test_vectors_by_box(spark, tmp_path):
    ring = lambda x: [[[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 0.0]]]
    lines = [json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": ring(float(x))}, "properties": {"n": x}}) for x in range(5)]
    (tmp_path / "v.geojsonl").write_text("\n".join([*lines, "{}", ""]))
    rows = files.read_vectors(spark, str(tmp_path / "v.geojsonl"), box=(1.5, 0.0, 2.5, 1.0)).collect()
    assert sorted(r.properties["n"] for r in rows) == ["1", "2"] and all(len(r.ring) == 3 for r in rows)
    assert files.read_vectors(spark, str(tmp_path / "v.geojsonl")).count() == 5


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int32", "float32", "float64"])
def test_images_round_trip(dtype):
    image = np.arange(3 * 5 * 4).reshape(3, 5, 4).astype(dtype)
    content = files.tiff_bytes(image, (10.0, 20.0, 20.0, 26.0), 32633, -1.0)
    assert np.array_equal(files.tiff_array(content), image) and files.tiff_array(content).dtype == image.dtype
    assert files.tiff_place(content) == ((10.0, 20.0, 20.0, 26.0), 32633, -1.0) and files.tiff_place(files.tiff_bytes(image)) == (None, None, None)
    assert files.tiff_place(files.tiff_bytes(image, (0.0, 0.0, 5.0, 3.0), 4326))[1] == 4326


def test_windows_reach_beyond_the_image():
    image = np.arange(12).reshape(3, 4, 1)
    place = (0.0, 0.0, 4.0, 3.0)
    assert files.window_of(image, place, (1.0, 0.0, 3.0, 2.0), -1)[..., 0].tolist() == [[5, 6], [9, 10]]
    assert files.window_of(image, place, (-1.0, 2.0, 1.0, 4.0), -1)[..., 0].tolist() == [[-1, -1], [-1, 0]]
    assert files.window_of(image, place, (9.0, 9.0, 10.0, 10.0), -1)[..., 0].tolist() == [[-1]]


def test_tiled_and_deflated_images():
    image = np.arange(5 * 7, dtype="u2").reshape(5, 7, 1)
    tiles = [zlib.compress(np.pad(image, ((0, 3), (0, 1), (0, 0)))[y : y + 4, x : x + 4].tobytes()) for y in (0, 4) for x in (0, 4)]
    data, at = b"".join(tiles), 8
    places = [at + sum(map(len, tiles[:k])) for k in range(4)]
    extra_at = at + len(data)
    extra = struct.pack("<4I", *places) + struct.pack("<4I", *map(len, tiles))
    tags = [(256, 3, 1, 7), (257, 3, 1, 5), (258, 3, 1, 16), (259, 3, 1, 8), (277, 3, 1, 1), (322, 3, 1, 4), (323, 3, 1, 4), (324, 4, 4, extra_at), (325, 4, 4, extra_at + 16), (339, 3, 1, 1)]
    entries = b"".join(struct.pack("<HHII", *t) for t in tags)
    content = struct.pack("<2sHI", b"II", 42, extra_at + len(extra)) + data + extra + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
    assert np.array_equal(files.tiff_array(content), image)
    with pytest.raises(ValueError):
        files.tiff_array(content.replace(struct.pack("<HHII", 259, 3, 1, 8), struct.pack("<HHII", 259, 3, 1, 5)))


def test_export_and_import_of_images(spark, tmp_path):
    frames = spark.createDataFrame([(p, t, 2, 3, 2, [float(100 * p + 10 * k + i) if i else float("nan") for i in range(12)]) for p in range(2) for k, t in enumerate(DAYS)], "patch_id long, ts timestamp_ntz, h int, w int, d int, data array<double>")
    boxes = spark.createDataFrame([(p, 10.0 * p, 0.0, 10.0 * p + 3, 2.0, 32633) for p in range(2)], "patch_id long, min_x double, min_y double, max_x double, max_y double, crs int")
    images = files.to_tiff(frames, "float32", boxes, no_data=-5.0).select(F.format_string("p%d.tif", "patch_id").alias("path"), F.col("tiff").alias("content"))
    written = files.write_files(images, str(tmp_path / "out")).collect()
    assert sorted(r.path for r in written) == ["p0.tif", "p1.tif"] and all((tmp_path / "out" / r.path).stat().st_size == r.size for r in written)
    back = {(r.path[-6:], r.ts_idx): r.data for r in files.read_tiff(spark, str(tmp_path / "out"), frames=3).collect()}
    assert back["p1.tif", 2] == [-5.0, *(120.0 + i for i in range(1, 12))] and len(back) == 6
    part = files.read_tiff(spark, str(tmp_path / "out"), frames=3, box=(1.0, 0.0, 4.0, 1.0)).where("path like '%p0.tif' and ts_idx = 0").first()
    assert (part.h, part.w, part.data) == (1, 3, [8.0, 9.0, 10.0, 11.0, -5.0, -5.0])
    with pytest.raises(Exception, match="dealt"):
        files.read_tiff(spark, str(tmp_path / "out"), frames=4).collect()


def test_synthetic_patches(spark):
    """A seed fixes everything: depth, then values, feature by feature in the order given."""
    features = [(T.DATA, "bands"), (T.MASK, "clm"), (T.SCALAR_TIMELESS, "s"), (T.LABEL, "l")]
    out = synthetic.arrays(features, frames=3, height=4, width=5)
    rng = np.random.default_rng(42)
    for (kind, _), a in zip(features, out.values(), strict=True):
        d = int(rng.integers(1, 3))
        shape = {T.DATA: (3, 4, 5, d), T.MASK: (3, 4, 5, d), T.SCALAR_TIMELESS: (d,), T.LABEL: (3, d)}[kind]
        assert a.shape == shape and np.array_equal(a, rng.integers(256, size=shape) if kind.is_discrete() else rng.normal(size=shape))
    rows = synthetic.frames_table(spark, out[T.DATA, "bands"], T.DATA, 7).orderBy("ts").collect()
    assert [r.ts for r in rows] == [datetime(2019, 1, 1), datetime(2019, 7, 2), datetime(2019, 12, 31)] and rows[1].data == out[T.DATA, "bands"][1].ravel().tolist() and rows[0].patch_id == 7
    assert synthetic.frames_table(spark, out[T.SCALAR_TIMELESS, "s"], T.SCALAR_TIMELESS).first().asDict().keys() == {"patch_id", "h", "w", "d", "data"}


def test_scene_source(spark):
    imagery.register(spark)
    read = lambda **o: spark.read.format("geoloom_scenes").options(start="2024-01-01", end="2024-01-21", **o).load()
    assert read().count() == 5 and read(every_days="10", patches="2").count() == 6 and read(maxcc="0.3").where("cover > 0.3").count() == 0
    late = read().where(F.col("ts") >= F.lit(datetime(2024, 1, 12)).cast("timestamp_ntz"))
    assert sorted(r.ts.day for r in late.collect()) == [16, 21]
    r = read(height="2", width="3", bands="1").first()
    assert (r.h, r.w, r.d, len(r.data)) == (2, 3, 1, 6)
    with pytest.raises(Exception, match="not both"):
        read(size="8", resolution="10").collect()


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)
    paths = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    assert ROOT in paths.split(os.pathsep)
    here = spark.range(1).mapInPandas(lambda it: (p.assign(id=__import__("geoloom").__file__.startswith(ROOT)) for p in it), "id boolean")
    assert here.first()["id"]
