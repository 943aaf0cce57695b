"""Random patches that a seed fixes, in the frame layout."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from geoloom.types import FeatureType


def arrays(features: Sequence[tuple[FeatureType, str]], seed: int = 42, frames: int = 5, height: int = 98, width: int = 151, depths: tuple[int, int] = (1, 3)) -> dict[tuple[FeatureType, str], np.ndarray]:
    """Normal numbers for DATA and SCALAR features, whole numbers below 256 for MASK and LABEL ones, in the order given."""
    rng = np.random.default_rng(seed)
    out = {}
    for kind, name in features:
        depth = int(rng.integers(*depths))
        shape = [*[frames] * kind.is_temporal(), *[height, width] * kind.is_image(), depth]
        out[kind, name] = rng.integers(256, size=shape) if kind.is_discrete() else rng.normal(size=shape)
    return out


def frames_table(spark: SparkSession, array: np.ndarray, kind: FeatureType, patch_id: int = 0, start: datetime = datetime(2019, 1, 1), end: datetime = datetime(2019, 12, 31)) -> DataFrame:
    """One patch's array as rows of the frame layout; frames are spread evenly from start to end."""
    whole = array if kind.is_temporal() else array[None]
    step = (end - start) / max(len(whole) - 1, 1)
    rows = []
    for t, a in enumerate(whole):
        h, w, d = a.shape if a.ndim == 3 else (1, 1, a.shape[0])
        ts = [start + timedelta(seconds=round((t * step).total_seconds()))] if kind.is_temporal() else []
        rows.append((patch_id, *ts, h, w, d, a.reshape(-1).astype(float).tolist()))
    return spark.createDataFrame(rows, "patch_id long, " + "ts timestamp_ntz, " * kind.is_temporal() + "h int, w int, d int, data array<double>")
