"""A patch set: named features of many patches, each a DataFrame keyed by patch_id, with boxes, frames and metadata.

Nothing here runs a job unless it says so; copying, renaming and selecting only rearrange the registry.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.spec import Spec, as_type, check_name
from geoloom.types import FeatureType, MissingFeatureError, TemporalDimensionWarning

Feature = tuple[FeatureType, str]


@dataclass
class PatchSet:
    """features: (type, name) -> DataFrame; boxes: patch_id, min_x, min_y, max_x, max_y, crs; frames: patch_id, ts.

    frames None: the patches have no time; an empty table: they have time but no frames.
    """

    features: dict[Feature, DataFrame] = field(default_factory=dict)
    boxes: DataFrame | None = None
    frames: DataFrame | None = None

    def __post_init__(self):
        given, self.features = self.features, {}
        for key, df in given.items():
            self[key] = df

    def __setitem__(self, key: Feature, df: DataFrame) -> None:
        kind, name = as_type(key[0]), check_name(key[1])
        missing = [c for c in kind.keys() if c not in df.columns and not (c == "ts" and kind.is_vector() and "TIMESTAMP" in df.columns)]
        if missing:
            raise ValueError(f"{kind} needs the columns {missing}")
        if kind.is_array() and kind.is_discrete() and "bands" in df.columns and df.schema["bands"].dataType.elementType.typeName() in ("double", "float"):
            raise ValueError(f"{kind} takes whole numbers or booleans")
        self.features[kind, name] = df

    def __getitem__(self, key: Feature) -> DataFrame:
        key = (as_type(key[0]), key[1])
        if key not in self.features:
            raise MissingFeatureError(f"no feature {key}")
        return self.features[key]

    def __delitem__(self, key: Feature) -> None:
        self[key]
        del self.features[as_type(key[0]), key[1]]

    def __contains__(self, key: object) -> bool:
        return any(k is key for k, _ in self.features) if isinstance(key, FeatureType) else key in self.features

    def names(self) -> list[Feature]:
        return sorted(self.features, key=lambda f: (f[0].value, f[1]))

    def select(self, features: object = ...) -> PatchSet:
        """The features meant, under their new names; boxes stay, frames if any temporal feature or `...` is meant."""
        found = Spec(features).resolve(self.features)
        keep = features is ... or any(k.is_temporal() for k, _, _ in found)
        return PatchSet({(k, new): self.features[k, old] for k, old, new in found}, self.boxes, self.frames if keep else None)

    def with_features(self, more: dict[Feature, DataFrame]) -> PatchSet:
        return PatchSet({**self.features, **more}, self.boxes, self.frames)

    def without(self, features: object) -> PatchSet:
        gone = set(Spec(features).features(self.features))
        return PatchSet({k: v for k, v in self.features.items() if k not in gone}, self.boxes, self.frames)

    def rename(self, features: object) -> PatchSet:
        names = {(k, old): (k, new) for k, old, new in Spec(features).resolve(self.features)}
        return PatchSet({names.get(k, k): v for k, v in self.features.items()}, self.boxes, self.frames)

    def duplicate(self, features: object) -> PatchSet:
        found = Spec(features).resolve(self.features)
        if taken := [(k, new) for k, _, new in found if (k, new) in self.features]:
            raise ValueError(f"already there: {taken}")
        return self.with_features({(k, new): self.features[k, old] for k, old, new in found})

    def move_to(self, other: PatchSet, features: object) -> PatchSet:
        """other with these features of this set as well."""
        return other.with_features(self.select(features).features)

    def map(self, f: Callable[[DataFrame], DataFrame], features: object = ...) -> PatchSet:
        return self.with_features({(k, new): f(self.features[k, old]) for k, old, new in Spec(features).resolve(self.features)})

    def where(self, condition: Column | str, features: object = ...) -> PatchSet:
        return self.map(lambda df: df.where(condition), features)

    def spatial_size(self, feature: Feature) -> DataFrame:
        """patch_id, height, width."""
        return self[feature].groupBy("patch_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))

    def indexed_frames(self) -> DataFrame:
        """frames with t_idx, counted from 0 in each patch."""
        return self.frames.withColumn("t_idx", F.row_number().over(Window.partitionBy("patch_id").orderBy("ts")) - 1)

    def check_frames(self, strict: bool = False) -> list[Feature]:
        """Temporal features whose frames differ from the patches' (or from each other's, if those aren't given); runs jobs.

        They are warned of, or with strict an error.
        """
        temporal = [k for k in self.names() if k[0].is_temporal() and "ts" in self.features[k].columns]
        frames = self.frames if self.frames is not None else self.features[temporal[0]] if temporal else None
        bad = [k for k in temporal if not frame_mismatch(frames, self.features[k]).isEmpty()]
        for k in bad:
            text = f"frames of {k} differ from the patches' timestamps"
            if strict:
                raise ValueError(text)
            warnings.warn(text, TemporalDimensionWarning, stacklevel=2)
        return bad

    def equals(self, other: PatchSet) -> bool:
        """Deep equality, NaN equal to NaN; runs jobs."""
        if set(self.features) != set(other.features):
            return False
        pairs = [(self.features[k], other.features[k]) for k in self.features]
        pairs += [(a, b) for a, b in ((self.boxes, other.boxes), (self.frames, other.frames)) if a is not None and b is not None]
        if (self.boxes is None) != (other.boxes is None) or (self.frames is None) != (other.frames is None):
            return False
        return all(same_rows(a, b) for a, b in pairs)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows, with equal columns and types; runs two jobs."""
    if sorted(a.dtypes) != sorted(b.dtypes):
        return False
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def frame_mismatch(frames: DataFrame, feature: DataFrame) -> DataFrame:
    """(patch_id, ts) pairs that only one side has."""
    a, b = frames.select("patch_id", "ts").distinct(), feature.select("patch_id", "ts").distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def union_names(sets: Iterable[PatchSet]) -> list[Feature]:
    """Every feature that any of the sets has."""
    return sorted({k for s in sets for k in s.features}, key=lambda f: (f[0].value, f[1]))
