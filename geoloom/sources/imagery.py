"""A scene catalogue as a Spark data source: one input partition for each requested scene, filters pushed to the source.

Without a network it stands for a remote service: scenes of a patch come every `every_days` days with a cloud cover and
bands that a formula of patch, time and pixel gives. A real service replaces `bands_of` by a request.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.datasource import Filter, GreaterThanOrEqual, LessThanOrEqual


class Scene(InputPartition):
    def __init__(self, patch_id: int, ts: datetime, cover: float):
        self.patch_id, self.ts, self.cover = patch_id, ts, cover


def cover_of(patch_id: int, k: int) -> float:
    return (patch_id * 37 + k * 53) % 101 / 100


def bands_of(scene: Scene, height: int, width: int, bands: int) -> np.ndarray:
    y, x, b = np.meshgrid(np.arange(height), np.arange(width), np.arange(bands), indexing="ij")
    day = scene.ts.timetuple().tm_yday
    return 0.5 + 0.5 * np.sin(scene.patch_id + y / 3 + x / 5 + b + 2 * math.pi * day / 365)


class SceneReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options
        self.max_cover, self.start, self.end = float(options.get("maxcc", 1.0)), options["start"], options["end"]

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, LessThanOrEqual) and f.attribute == ("cover",):
                self.max_cover = min(self.max_cover, f.value)
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("ts",):
                self.start = max(self.start, f.value.isoformat())
            yield f  # Spark checks them again; here they only spare requests

    def partitions(self) -> list[Scene]:
        every = int(self.o.get("every_days", 5))
        start, end = datetime.fromisoformat(self.start), datetime.fromisoformat(self.end)
        first = datetime.fromisoformat(self.o["start"])
        out = []
        for p in range(int(self.o.get("patches", 1))):
            for k in range((end - first).days // every + 1):
                ts = first + timedelta(days=k * every)
                if start <= ts <= end and cover_of(p, k) <= self.max_cover:
                    out.append(Scene(p, ts, cover_of(p, k)))
        return out

    def read(self, scene: Scene) -> Iterator[tuple]:
        h, w, d = (int(self.o.get(n, v)) for n, v in (("height", 8), ("width", 8), ("bands", 3)))
        yield scene.patch_id, scene.ts, scene.cover, h, w, d, bands_of(scene, h, w, d).reshape(-1).tolist()


class SceneSource(DataSource):
    """register(spark); spark.read.format("geoloom_scenes").options(start=..., end=..., ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "geoloom_scenes"

    def schema(self) -> str:
        return "patch_id long, ts timestamp_ntz, cover double, h int, w int, d int, data array<double>"

    def reader(self, schema) -> SceneReader:
        if {"size", "resolution"} <= set(self.options):
            raise ValueError("give a size or a resolution, not both")
        return SceneReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark push filters to sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SceneSource)
