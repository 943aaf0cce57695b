"""Merging features of several patch sets: by full keys, with an operation for values that meet."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.projection import number
from geoloom.patchset import PatchSet, union_names

#: Aggregates over values that meet; NaN and null don't count.
OPERATIONS: dict[str, Callable[[str], Column]] = {"min": lambda c: F.min(number(F.col(c))), "max": lambda c: F.max(number(F.col(c))), "mean": lambda c: F.avg(number(F.col(c))), "median": lambda c: F.median(number(F.col(c)))}


def only_value(c: str) -> Column:
    """The common value; an error where values differ (NaN equals NaN)."""
    low, high = F.min(c), F.max(c)  # NaN is the greatest value, so both are NaN only if all are
    return F.when(low.eqNullSafe(high), low).otherwise(F.raise_error(F.concat(F.lit("values that should be equal differ: "), low.cast("string"), F.lit(" and "), high.cast("string"))))


def merge_values(parts: Sequence[DataFrame], keys: Sequence[str], how: str | Callable[[pd.Series], float] | None = None, value: str = "v") -> DataFrame:
    """Rows of all parts, one for each key. how: None (must be equal), min, max, mean, median, or a function of a Series."""
    rows = reduce(DataFrame.unionByName, [p.select(*keys, value) for p in parts])
    if how is None:
        merged = only_value(value)
    elif callable(how):

        def run(all_values: pd.Series) -> pd.Series:
            return all_values.map(lambda v: float(how(pd.Series(v, dtype=float))))

        # values that meet are gathered by an aggregation; the function then sees a batch of keys at a time
        return rows.groupBy(*keys).agg(F.collect_list(F.col(value).cast("double")).alias("_all")).select(*keys, F.pandas_udf(run, "double")("_all").alias(value))
    elif how in OPERATIONS:
        merged = OPERATIONS[how](value)
    else:
        raise ValueError(f"unknown operation for merging: {how}")
    return rows.groupBy(*keys).agg(merged.alias(value))


def concat_frames(parts: Sequence[DataFrame]) -> DataFrame:
    """All frames, also such that share a timestamp; source tells the part."""
    return reduce(DataFrame.unionByName, [p.withColumn("source", F.lit(i)) for i, p in enumerate(parts)])


def concat_bands(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Bands of timeless features in the order of the parts; every pixel takes what there is of it."""
    rows = reduce(DataFrame.unionByName, [p.select(*keys, F.lit(i).alias("_s"), "bands") for i, p in enumerate(parts)])
    own = F.array_sort(F.collect_list(F.struct("_s", "bands")))
    return rows.groupBy(*keys).agg(F.flatten(F.transform(own, lambda p: p["bands"])).alias("bands"))


def merge_vectors(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).dropDuplicates()


def merge_meta(parts: Sequence[DataFrame]) -> DataFrame:
    """The first part's value of each name; conflict tells whether others differ."""
    rows = concat_frames(parts)
    return rows.groupBy("patch_id", "name").agg(F.min_by("value", "source").alias("value"), (F.count_distinct("value") > 1).alias("conflict"))


def merge_timestamps(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select("patch_id", "ts") for p in parts]).distinct()


def common_boxes(parts: Sequence[DataFrame]) -> DataFrame:
    """The box of each patch; an error where the parts differ."""
    rows = reduce(DataFrame.unionByName, parts)
    same = {c: only_value(c).alias(c) for c in ("min_x", "min_y", "max_x", "max_y", "crs")}
    return rows.groupBy("patch_id").agg(*same.values())


def merge(sets: Sequence[PatchSet], temporal: str | Callable | None = None, timeless: str | Callable | None = None) -> PatchSet:
    """One patch set with every feature of any set; `concatenate` keeps all frames or appends bands."""
    out = {}
    for kind, name in union_names(sets):
        parts = [s.features[kind, name] for s in sets if (kind, name) in s.features]
        how = temporal if kind.is_temporal() else timeless
        if kind.is_vector():
            out[kind, name] = merge_vectors(parts)
        elif kind.is_meta():
            out[kind, name] = merge_meta(parts).drop("conflict")
        elif how == "concatenate":
            out[kind, name] = concat_frames(parts).drop("source") if kind.is_temporal() else concat_bands(parts, kind.keys())
        else:
            from geoloom.layout import bands_to_rows, rows_to_bands

            out[kind, name] = rows_to_bands(merge_values([bands_to_rows(p) for p in parts], [*kind.keys(), "b"], how))
            if kind.is_discrete():
                out[kind, name] = out[kind, name].withColumn("bands", F.transform("bands", lambda v: F.bround(v).cast("int")))
    boxes = [s.boxes for s in sets if s.boxes is not None]
    frames = [s.frames for s in sets if s.frames is not None]
    return PatchSet(out, common_boxes(boxes) if boxes else None, merge_timestamps(frames) if frames else None)
