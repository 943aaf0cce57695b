"""A store of patch sets. Paths are Hadoop paths.

<root>/<feature type>/<name>/ holds Parquet files of many frames each, sorted by patch and time, and manifests: JSON lines with
the schema and, for every file that belongs to the state, its range of patches and times. A write puts its files beside the old
ones and then names them in a new manifest under the next number, which appears by one rename; until then, and if the write
fails, readers see the old state. Replacing a patch or a frame rewrites only the files whose ranges meet what is written.
Files of the state before the last one are kept for readers that have begun; older ones are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoloom.operators.filters import at_indices, at_times, by_times, keep_frames
from geoloom.operators.timeseries import micros
from geoloom.patchset import PatchSet
from geoloom.spec import Spec
from geoloom.types import FeatureType, MissingFeatureError, OverwritePermission

BOXES, FRAMES = "bbox", "timestamps"
MANIFESTS = "_manifests"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    try:
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
    except Py4JJavaError as e:
        if "FileNotFoundException" in str(e.java_exception):
            return []
        raise


def stored(spark: SparkSession, root: str, kinds: Iterable[FeatureType] = tuple(FeatureType)) -> list[tuple[FeatureType, str]]:
    """Features in the store; only folders of these types are listed. A feature whose first write failed is not there."""
    here = set(children(spark, root))
    return [(k, n) for k in kinds if k.value in here for n in children(spark, f"{root}/{k.value}") if versions(spark, f"{root}/{k.value}/{n}")]


def versions(spark: SparkSession, at: str) -> list[int]:
    """Numbers of the manifests of a feature, rising."""
    fs, path = _fs(spark, f"{at}/{MANIFESTS}")
    if not fs.exists(path):
        return []
    return sorted(int(n[:-5]) for s in fs.listStatus(path) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, at: str, version: int | None = None) -> tuple[StructType, list[dict]] | None:
    """Schema and files (path, rows, patches and times from and to) of a feature's state, the newest without a version."""
    have = versions(spark, at)
    if not have:
        return None
    text = spark.read.text(f"{at}/{MANIFESTS}/{version or have[-1]:08d}.json", wholetext=True).first()[0]
    first, *files = (json.loads(line) for line in text.split("\n"))
    return StructType.fromJson(first), files


def publish(spark: SparkSession, at: str, schema: StructType, files: list[dict], over: int) -> None:
    """Make a new state: the manifest after number `over` appears whole, or not at all if another writer was first."""
    fs, new = _fs(spark, f"{at}/{MANIFESTS}/{over + 1:08d}.json")
    _, draft = _fs(spark, f"{at}/{MANIFESTS}/{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    out.write(bytearray("\n".join([schema.json(), *(json.dumps(f) for f in files)]).encode()))
    out.close()
    if fs.exists(new) or not fs.rename(draft, new):
        fs.delete(draft, False)
        raise OSError(f"{at} was written by another job")
    before = {f["path"] for f in (manifest(spark, at, over) if over else (None, []))[1]}
    for version in versions(spark, at)[:-2]:
        for f in manifest(spark, at, version)[1]:
            if f["path"] not in before and f["path"] not in {x["path"] for x in files}:
                fs.delete(_fs(spark, f"{at}/{f['path']}")[1], False)
        fs.delete(_fs(spark, f"{at}/{MANIFESTS}/{version:08d}.json")[1], False)


def in_range(files: list[dict], patches: Iterable[int] | None = None, times: tuple[int, int] | None = None) -> list[dict]:
    """Files that may hold these patches and times (microseconds, ends included); None: all."""
    patches = None if patches is None else sorted(patches)

    def met(f: dict) -> bool:
        if patches is not None and not any(f["patch_from"] <= p <= f["patch_to"] for p in patches):
            return False
        return times is None or f["time_from"] is None or f["time_from"] <= times[1] and f["time_to"] >= times[0]

    return [f for f in files if met(f)]


def read_files(spark: SparkSession, at: str, schema: StructType, files: list[dict]) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{at}/{f['path']}" for f in files)) if files else spark.createDataFrame([], schema)


def staged(df: DataFrame, at: str, replace: list[str], compression: str) -> tuple[StructType, list[dict], int]:
    """Write df's files beside those of the state; what the new manifest has to say, and the number of the old one.

    replace: patch_id, or patch_id and ts; rows of the state with a value that df has go. Empty: the state is replaced.
    """
    spark, have = df.sparkSession, versions(df.sparkSession, at)
    kept: list[dict] = []
    if have and replace:
        schema, files = manifest(spark, at)
        stamp = F.struct(F.min(micros(F.col("ts"))), F.max(micros(F.col("ts")))) if "ts" in replace else F.lit(None)
        low, high, times = df.agg(F.min("patch_id"), F.max("patch_id"), stamp).first()
        touched = [] if low is None else [f for f in in_range(files, None, tuple(times) if times else None) if f["patch_from"] <= high and f["patch_to"] >= low]
        kept = [f for f in files if f not in touched]
        if touched:
            rest = read_files(spark, at, schema, touched).join(df.select(*replace).distinct(), replace, "left_anti")
            df = df.select(schema.names).unionByName(rest)
        else:
            df = df.select(schema.names)
    order = [c for c in ("patch_id", "ts", "y", "x") if c in df.columns]
    folder = f"data-{uuid.uuid4().hex}"
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", compression).parquet(f"{at}/{folder}")
    written = spark.read.schema(df.schema).parquet(f"{at}/{folder}")
    time = micros(F.col("ts")) if "ts" in df.columns else F.lit(None).cast("long")
    ranges = written.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("rows"), F.min("patch_id").alias("patch_from"), F.max("patch_id").alias("patch_to"), F.min(time).alias("time_from"), F.max(time).alias("time_to"))
    return df.schema, kept + [r.asDict() | {"path": f"{folder}/{r['name']}"} for r in ranges.orderBy("patch_from", "time_from").collect()], have[-1] if have else 0  # a row for each file


def save(patches: PatchSet, root: str, features: object = ..., permission: OverwritePermission | str = OverwritePermission.ADD_ONLY, times: Column | None = None, compression: str = "zstd") -> None:
    """Write the features meant. ADD_ONLY: none of them may be there; OVERWRITE_FEATURES: patches written replace their rows;
    OVERWRITE_PATCH: features that aren't written go.

    times: a condition on ts of the frames to write; then each frame replaces just that frame. Files of all features are
    written before the first new state appears.
    """
    permission = OverwritePermission(permission)
    found = Spec(features).resolve(patches.features)
    if not found and patches.boxes is None and patches.frames is None:
        return
    spark = next(iter([*patches.features.values(), *(d for d in (patches.boxes, patches.frames) if d is not None)])).sparkSession
    old = stored(spark, root)
    names = {(k, n.lower()): n for k, n in old}
    for kind, _, new in found:
        if permission is OverwritePermission.ADD_ONLY and times is None and (kind, new) in old:
            raise ValueError(f"{(kind, new)} is already in {root}")
        if names.get((kind, new.lower()), new) != new:
            raise OSError(f"{new} and {names[kind, new.lower()]} differ in letter case only")
    writes = {}
    for kind, name, new in found:
        df, by_frame = patches.features[kind, name], False
        if times is not None and kind.is_temporal() and "ts" in df.columns:
            df, by_frame = df.where(times), True
        writes[f"{root}/{kind.value}/{new}"] = staged(df, f"{root}/{kind.value}/{new}", ["patch_id", *["ts"] * by_frame], compression)
    for name, df, keys in ((BOXES, patches.boxes, ["patch_id"]), (FRAMES, patches.frames, ["patch_id", *["ts"] * (times is not None)])):
        if df is not None:
            writes[f"{root}/{name}"] = staged(df, f"{root}/{name}", keys, compression)
    for at, (schema, files, over) in writes.items():
        publish(spark, at, schema, files, over)
    if permission is OverwritePermission.OVERWRITE_PATCH:
        for kind, name in set(old) - {(k, n) for k, _, n in found}:
            fs, at = _fs(spark, f"{root}/{kind.value}/{name}")
            fs.delete(at, True)


def infer_times(patches: PatchSet, root: str) -> DataFrame:
    """Frames of the set that the store has; an error if the set has others."""
    spark, at = patches.frames.sparkSession, f"{root}/{FRAMES}"
    there = read_files(spark, at, *manifest(spark, at)).select("patch_id", "ts")
    if not patches.frames.join(there, ["patch_id", "ts"], "left_anti").isEmpty():
        raise ValueError("the patch set has frames that the store lacks")
    return there.join(patches.frames.select("patch_id", "ts"), ["patch_id", "ts"], "left_semi")


def load(spark: SparkSession, root: str, features: object = ..., patch_ids: Iterable[int] | None = None, times: Column | list | Callable | None = None) -> PatchSet:
    """The features meant; nothing is read until it is used. patch_ids and chosen frames pick files by the manifest.

    times: a condition on ts (pushed to the scan, whose rows are sorted by time), timestamps, frame numbers, or a function from a
    patch's timestamps to booleans.
    """
    found = Spec(features).resolve(stored(spark, root))
    top = {n for n in (BOXES, FRAMES) if versions(spark, f"{root}/{n}")}

    def table(path: str, span: tuple[int, int] | None = None) -> DataFrame:
        schema, files = manifest(spark, f"{root}/{path}")
        df = read_files(spark, f"{root}/{path}", schema, in_range(files, patch_ids, span))
        return df if patch_ids is None else df.where(F.col("patch_id").isin(*patch_ids))

    frames = table(FRAMES) if FRAMES in top else None
    chosen = span = None
    if times is not None:
        if isinstance(times, Column):
            chosen = times
            frames = None if frames is None else frames.where(times)
        else:
            if frames is None:
                raise MissingFeatureError(f"{root} has no timestamps")
            frames = by_times(frames, times) if callable(times) else at_indices(frames, times) if times and isinstance(times[0], int) else at_times(frames, times)
            span = tuple(frames.agg(F.min(micros(F.col("ts"))), F.max(micros(F.col("ts")))).first())
            span = (0, -1) if span[0] is None else span

    def cut(kind: FeatureType, path: str) -> DataFrame:
        if times is None or not kind.is_temporal() or "ts" not in (df := table(path, span)).columns:
            return table(path)
        return df.where(chosen) if chosen is not None else keep_frames(df, frames)

    out = {(k, new): cut(k, f"{k.value}/{old}") for k, old, new in found}
    temporal = features is ... or any(k.is_temporal() for k, _, _ in found)
    return PatchSet(out, table(BOXES) if BOXES in top else None, frames if temporal else None)
