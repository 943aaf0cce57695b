"""Feature types, their schemas, and permissions of writers."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class FeatureType(Enum):
    """Kinds of features; the value is the folder's name in a store (fixed values: names of the public data model)."""

    DATA = "data"
    MASK = "mask"
    SCALAR = "scalar"
    LABEL = "label"
    VECTOR = "vector"
    DATA_TIMELESS = "data_timeless"
    MASK_TIMELESS = "mask_timeless"
    SCALAR_TIMELESS = "scalar_timeless"
    LABEL_TIMELESS = "label_timeless"
    VECTOR_TIMELESS = "vector_timeless"
    META_INFO = "meta_info"

    def is_timeless(self) -> bool:
        return self.value.endswith("_timeless")

    def is_vector(self) -> bool:
        return self.value.startswith("vector")

    def is_meta(self) -> bool:
        return self is FeatureType.META_INFO

    def is_temporal(self) -> bool:
        return not self.is_timeless() and not self.is_meta()

    def is_discrete(self) -> bool:
        return self.value.split("_")[0] in ("mask", "label")

    def is_image(self) -> bool:
        return self.value.split("_")[0] in ("data", "mask")

    def is_spatial(self) -> bool:
        return self.is_image() or self.is_vector()

    def is_array(self) -> bool:
        return not self.is_vector() and not self.is_meta()

    def ndim(self) -> int | None:
        """Dimensions of the array that a patch has of this type: (time) (row, column) band."""
        return int(self.is_temporal()) + 2 * int(self.is_image()) + 1 if self.is_array() else None

    def keys(self) -> list[str]:
        """Columns that tell the rows of a patch apart in the pixel layout."""
        if self.is_meta():
            return ["patch_id", "name"]
        return ["patch_id", *["ts"] * self.is_temporal(), *["y", "x"] * self.is_image()]

    def schema(self) -> T.StructType:
        """The pixel layout of an array feature."""
        kinds = {"patch_id": T.LongType(), "ts": T.TimestampNTZType(), "y": T.IntegerType(), "x": T.IntegerType(), "name": T.StringType()}
        value = T.ArrayType(T.IntegerType() if self.is_discrete() else T.DoubleType())
        fields = [T.StructField(k, kinds[k]) for k in self.keys()]
        return T.StructType([*fields, T.StructField("value", T.StringType())] if self.is_meta() else [*fields, T.StructField("bands", value)])


class OverwritePermission(Enum):
    ADD_ONLY = "add_only"
    OVERWRITE_FEATURES = "overwrite_features"
    OVERWRITE_PATCH = "overwrite_patch"

    @classmethod
    def _missing_(cls, value):
        return next((m for m in cls if isinstance(value, str) and m.value == value.lower()), None)


#: Spark's type for each type of array elements.
ELEMENT_TYPES = {
    "bool": "boolean", "int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint",
    "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double", "object": "string", "str": "string",
}
INTEGER_RANGES = {"tinyint": (-(1 << 7), (1 << 7) - 1), "smallint": (-(1 << 15), (1 << 15) - 1), "int": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1)}


class MissingFeatureError(ValueError):
    """A named feature is not in the patch set or store."""


class TemporalDimensionWarning(RuntimeWarning):
    """Frames of a feature and the patch's timestamps differ."""
