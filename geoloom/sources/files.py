"""Importers and exporters of single files: arrays, metadata, boxes, vectors and plain TIFF images.

Files are found and dealt out by Spark's binaryFile source; a small decoder turns each file into rows.
"""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import tempfile
import zlib
import uuid
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_DDL = "path string, ts_idx int, h int, w int, d int, data array<double>"


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def gunzipped(path: str, content: bytes) -> bytes:
    import gzip

    return gzip.decompress(content) if path.endswith(".gz") else content


def frames_of(array: np.ndarray, temporal: bool) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(frame, h, w, d, flat values); arrays of fewer dimensions have h = w = 1."""
    array = array if temporal else array[None]
    for t, a in enumerate(array):
        h, w, d = a.shape if a.ndim == 3 else (1, 1, a.shape[0])
        yield t, h, w, d, a.reshape(-1).astype(float)


def read_arrays(spark: SparkSession, path: str, temporal: bool = True) -> DataFrame:
    """A row for each frame of each .npy or .npy.gz file below path."""

    def run(batches):
        for pdf in batches:
            rows = [(p, *f) for p, c in zip(pdf["path"], pdf["content"], strict=True) for f in frames_of(np.load(io.BytesIO(gunzipped(p, c)), allow_pickle=False), temporal)]
            yield pd.DataFrame(rows, columns=["path", "ts_idx", "h", "w", "d", "data"])

    return files(spark, path, "*.npy*").mapInPandas(run, FRAME_DDL)


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """path, ts_idx, ts of every timestamps.json: a list of ISO strings."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="timestamps.json", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = text.select("path", F.posexplode(F.from_json("value", "array<string>")).alias("ts_idx", "s"))
    return rows.select("path", "ts_idx", F.to_timestamp_ntz(F.regexp_replace("s", "(Z|[+-][0-9]{2}:?[0-9]{2})$", "")).alias("ts"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """path, min_x ... max_y, crs of every bbox.geojson: a polygon and a named system."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="bbox.geojson", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    shape = "struct<crs:struct<properties:struct<name:string>>,coordinates:array<array<array<double>>>>"
    rows = text.select("path", F.from_json("value", shape).alias("g"))
    side = lambda f, i: f(F.transform(F.get("g.coordinates", F.lit(0)), lambda p: F.get(p, F.lit(i))))
    crs = F.regexp_extract("g.crs.properties.name", "([0-9]+)$", 1).cast("int")
    return rows.select("path", side(F.array_min, 0).alias("min_x"), side(F.array_min, 1).alias("min_y"), side(F.array_max, 0).alias("max_x"), side(F.array_max, 1).alias("max_y"), crs.alias("crs"))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """path, name, value (JSON) of every file in folders meta_info."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.where(F.col("path").contains("/meta_info/")).select("path", F.regexp_extract("path", "([^/]+)\\.json$", 1).alias("name"), "value")


def as_json(value: object) -> str:
    """JSON of a metadata value; dates as ISO strings."""
    return json.dumps(value, default=lambda v: v.isoformat() if isinstance(v, datetime) or hasattr(v, "isoformat") else _no(v))


def _no(v: object):
    raise TypeError(f"{type(v).__name__} has no JSON")


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    """path, table, geometry (WKB), attributes (JSON) of every feature table in .gpkg files, which are SQLite files."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:  # SQLite opens files; this one lives as long as the task reads it
            f.write(gunzipped(path, content))
            f.flush()
            db = sqlite3.connect(f.name)
            for table, column in db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall():
                cursor = db.execute(f'SELECT * FROM "{table}"')
                names = [c[0] for c in cursor.description]
                for row in cursor:
                    record = dict(zip(names, row, strict=True))
                    blob = record.pop(column)
                    envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] if blob else 0
                    yield path, table, bytes(blob[8 + envelope :]) if blob else None, as_json(record)
            db.close()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in rows(p, c)], columns=["path", "table", "geometry", "attributes"])

    return files(spark, path, "*.gpkg*").mapInPandas(run, "path string, table string, geometry binary, attributes string")


def rings_of(wkb: bytes | None) -> list[list[tuple[float, float]]]:
    """Rings of a polygon or of all polygons of a multipolygon in WKB, without their repeated last points; other kinds: none."""
    out = []

    def polygon(at: int) -> int:
        e = "<" if wkb[at] else ">"
        kind, n = struct.unpack_from(e + "II", wkb, at + 1)
        at += 9
        if kind % 1000 == 6:
            for _ in range(n):
                at = polygon(at)
        elif kind % 1000 == 3:
            dims = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
            for _ in range(n):
                (points,) = struct.unpack_from(e + "I", wkb, at)
                flat = struct.unpack_from(f"{e}{points * dims}d", wkb, at + 4)
                out.append([(flat[k], flat[k + 1]) for k in range(0, (points - 1) * dims, dims)])
                at += 4 + 8 * points * dims
        return at

    if wkb:
        polygon(0)
    return out


def decoded(features: DataFrame) -> DataFrame:
    """Features of read_geopackage with rings (of x, y) of their polygons, and ts, the attribute TIMESTAMP without its zone."""
    rings = F.udf(rings_of, "array<array<struct<x:double,y:double>>>", useArrow=True)
    stamp = F.regexp_replace(F.get_json_object("attributes", "$.TIMESTAMP"), "(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    return features.withColumns({"rings": rings("geometry"), "ts": F.try_to_timestamp(stamp).cast("timestamp_ntz")})


def read_vectors(spark: SparkSession, path: str, box: Box | None = None) -> DataFrame:
    """Features of line-wise GeoJSON (one feature a line): ring of the outer boundary, its box, properties (JSON).

    box: only features whose own box meets it.
    """
    from geoloom.operators.filters import in_box
    from geoloom.operators.geometry import with_box

    shape = "struct<geometry:struct<coordinates:array<array<array<double>>>>,properties:map<string,string>>"
    rows = spark.read.text(path).select(F.from_json("value", shape).alias("f")).where("f.geometry is not null")
    points = F.get("f.geometry.coordinates", F.lit(0))
    ring = F.transform(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    found = with_box(rows.select(ring.alias("ring"), F.col("f.properties").alias("properties")))
    return found if box is None else in_box(found, *box)


TIFF_TYPES = {(8, 1): "u1", (16, 1): "<u2", (32, 1): "<u4", (8, 2): "i1", (16, 2): "<i2", (32, 2): "<i4", (32, 3): "<f4", (64, 3): "<f8"}


#: Fixed values of the public TIFF and GeoTIFF formats: types of tag values, and the tags used here.
TAG_CODES = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d"}
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
Box = tuple[float, float, float, float]


def tiff_bytes(image: np.ndarray, box: Box | None = None, crs: int | None = None, no_data: float | None = None) -> bytes:
    """An uncompressed little-endian TIFF with one strip; image has rows, columns, channels. 64-bit integers become 32-bit.

    box (min_x, min_y, max_x, max_y), crs (an EPSG number) and no_data become geo tags.
    """
    image = np.ascontiguousarray(image.astype("i4") if image.dtype.kind in "iu" and image.dtype.itemsize == 8 else image)
    bits, kind = image.dtype.itemsize * 8, {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    h, w, c = image.shape
    data = image.astype(TIFF_TYPES[bits, kind]).tobytes()
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [bits] * c), (259, 3, [1]), (262, 3, [1]), (273, 4, [8]), (277, 3, [c]), (278, 4, [h]), (279, 4, [len(data)]), (284, 3, [1]), (339, 3, [kind] * c)]
    if box is not None:
        tags += [(PIXEL_SCALE, 12, [(box[2] - box[0]) / w, (box[3] - box[1]) / h, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, box[0], box[3], 0.0])]
    if crs is not None:
        degrees = crs == 4326
        tags.append((GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if degrees else 1, 1025, 0, 1, 1, 2048 if degrees else 3072, 0, 1, crs]))
    if no_data is not None:
        tags.append((NO_DATA, 2, f"{no_data:g}".encode() + b"\0"))
    at = 8 + len(data) + len(data) % 2
    extra_at, entries, extra = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, typ, values in tags:
        raw = values if typ == 2 else struct.pack(f"<{len(values)}{TAG_CODES[typ]}", *values)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, typ, len(values), extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries += struct.pack("<HHI", tag, typ, len(values)) + raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra


def tiff_tags(content: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and values of the tags of the first image."""
    e = "<" if content[:2] == b"II" else ">"
    at = struct.unpack_from(e + "I", content, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(e + "H", content, at)[0]):
        tag, typ, n = struct.unpack_from(e + "HHI", content, at + 2 + 12 * k)
        if code := TAG_CODES.get(typ):
            size = struct.calcsize(code) * n
            where = at + 2 + 12 * k + 8 if size <= 4 else struct.unpack_from(e + "I", content, at + 2 + 12 * k + 8)[0]
            tags[tag] = struct.unpack_from(f"{e}{n}{code}", content, where)
    return e, tags


def tiff_place(content: bytes) -> tuple[Box | None, int | None, float | None]:
    """(box, crs, no_data) of a TIFF, as far as its tags tell them."""
    _, tags = tiff_tags(content)
    box = crs = None
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[PIXEL_SCALE], tags[TIE_POINT]
        left, top = x - i * sx, y + j * sy
        box = (left, top - tags[257][0] * sy, left + tags[256][0] * sx, top)
    keys = tags.get(GEO_KEYS, ())
    for k in range(4, len(keys), 4):
        crs = keys[k + 3] if keys[k] in (2048, 3072) else crs
    return box, crs, float(tags[NO_DATA][0].rstrip(b"\0")) if NO_DATA in tags else None


def tiff_array(content: bytes) -> np.ndarray:
    """Rows, columns, channels of a TIFF in strips or tiles with interleaved channels, plain or deflated."""
    e, tags = tiff_tags(content)
    packed = tags.get(259, (1,))[0]
    if packed not in (1, 8, 32946) or tags.get(284, (1,))[0] != 1 or tags.get(317, (1,))[0] != 1:
        raise ValueError("only images with interleaved channels, plain or deflated, can be read")
    w, h, c = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    dtype = np.dtype(TIFF_TYPES[tags[258][0], tags.get(339, (1,))[0]]).newbyteorder(e)
    part = lambda at, n: np.frombuffer(zlib.decompress(content[at : at + n]) if packed != 1 else content[at : at + n], dtype)
    if 322 not in tags:
        return np.concatenate([part(*p) for p in zip(tags[273], tags[279], strict=True)])[: h * w * c].reshape(h, w, c)
    tw, th = tags[322][0], tags[323][0]
    across = -(-w // tw)
    out = np.zeros((-(-h // th) * th, across * tw, c), dtype)
    for k, p in enumerate(zip(tags[324], tags[325], strict=True)):
        y, x = k // across * th, k % across * tw
        out[y : y + th, x : x + tw] = part(*p).reshape(th, tw, c)
    return out[:h, :w]


def window_of(image: np.ndarray, place: Box, box: Box, fill: float) -> np.ndarray:
    """The part of an image over `place` that covers `box`, to whole pixels; pixels beyond the image take `fill`."""
    h, w = image.shape[:2]
    sx, sy = (place[2] - place[0]) / w, (place[3] - place[1]) / h
    x0, x1 = round((box[0] - place[0]) / sx), round((box[2] - place[0]) / sx)
    y0, y1 = round((place[3] - box[3]) / sy), round((place[3] - box[1]) / sy)
    out = np.full((y1 - y0, x1 - x0, image.shape[2]), fill, image.dtype)
    a, b, c, d = max(y0, 0), min(y1, h), max(x0, 0), min(x1, w)
    if a < b and c < d:
        out[a - y0 : b - y0, c - x0 : d - x0] = image[a:b, c:d]
    return out


def read_tiff(spark: SparkSession, path: str, frames: int = 1, box: Box | None = None, fill: float = 0) -> DataFrame:
    """A row for each frame of each TIFF: the channels are dealt to the frames in turn, so they must divide.

    box: only this window of images that tell where they lie; beyond an image it holds `fill`, or the image's no-data value.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                image = tiff_array(content)
                if box is not None:
                    place, _, none = tiff_place(content)
                    if place is None:
                        raise ValueError(f"{p} doesn't tell where it lies")
                    image = window_of(image, place, box, fill if none is None else none)
                h, w, c = image.shape
                if c % frames:
                    raise ValueError(f"{c} channels can't be dealt to {frames} frames")
                rows += [(p, *f) for f in frames_of(np.moveaxis(image.reshape(h, w, frames, c // frames), 2, 0), True)]
            yield pd.DataFrame(rows, columns=["path", "ts_idx", "h", "w", "d", "data"])

    return files(spark, path, "*.tif*").mapInPandas(run, FRAME_DDL)


def to_tiff(frames: DataFrame, dtype: str = "float32", boxes: DataFrame | None = None, no_data: float | None = None) -> DataFrame:
    """patch_id, tiff: an image for each patch with the channels of all its frames, T1B1, T1B2, ..., T2B1, ...

    boxes: where the patches lie, for the geo tags. no_data: takes the place of missing values and is noted in the file.
    """
    placed = boxes is not None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts") if "ts" in pdf else pdf
        image = np.concatenate([np.asarray(v, float).reshape(h, w, d) for h, w, d, v in zip(pdf["h"], pdf["w"], pdf["d"], pdf["data"], strict=True)], axis=2)
        image = image if no_data is None else np.where(np.isnan(image), no_data, image)
        first = pdf.iloc[0]
        place = (tuple(float(first[c]) for c in ("min_x", "min_y", "max_x", "max_y")), int(first["crs"])) if placed else (None, None)
        return pd.DataFrame({"patch_id": [first["patch_id"]], "tiff": [tiff_bytes(image.astype(dtype), *place, no_data)]})

    if placed:
        frames = frames.join(boxes.select("patch_id", "min_x", "min_y", "max_x", "max_y", "crs"), "patch_id")
    return frames.groupBy("patch_id").applyInPandas(run, "patch_id long, tiff binary")


def write_files(contents: DataFrame, root: str) -> DataFrame:
    """Write each row's content to root/path from the tasks; path and size of each file. root: a folder or URI that all see.

    A file appears under its name only when it is whole, so a task may run twice.
    """

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                to = f"{base}/{path}"
                system.create_dir(to.rsplit("/", 1)[0], recursive=True)
                part = f"{to}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, to)
            yield pd.DataFrame({"path": pdf["path"], "size": [len(c) for c in pdf["content"]]})

    return contents.select("path", "content").mapInPandas(run, "path string, size long")


def array_files(frames: DataFrame, name: str) -> DataFrame:
    """(path, content): <patch_id>/<name>.npy.gz for each patch, its frames in order of time. For write_files."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import gzip

        pdf = pdf.sort_values("ts") if "ts" in pdf else pdf
        stack = np.stack([np.asarray(v, float).reshape(h, w, d) for h, w, d, v in zip(pdf["h"], pdf["w"], pdf["d"], pdf["data"], strict=True)])
        out = io.BytesIO()
        np.save(out, stack if "ts" in pdf else stack[0])
        return pd.DataFrame({"path": [f"{pdf['patch_id'].iloc[0]}/{name}.npy.gz"], "content": [gzip.compress(out.getvalue(), mtime=0)]})

    return frames.groupBy("patch_id").applyInPandas(run, "path string, content binary")


def file_name(template: str, ts: Column) -> Column:
    """A file's name for a timestamp: `*` is the time as 20200131T235959, and strftime's codes Y m d H M S work too."""
    template = template.replace("*", "%Y%m%dT%H%M%S")
    template += "" if template.lower().endswith((".tif", ".tiff")) else ".tif"
    codes = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}
    parts, text, k = [], "", 0
    while k < len(template):
        if template[k] == "%" and template[k + 1 : k + 2] in codes:
            parts += [F.lit(text), F.date_format(ts, codes[template[k + 1]])]
            text, k = "", k + 2
        else:
            text, k = text + template[k], k + 1
    return F.concat(*parts, F.lit(text))
