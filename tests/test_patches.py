"""Feature types, the language of specifications, patch sets, and merging of whole patch sets."""

import warnings
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from geoloom.operators import merge
from geoloom.patchset import PatchSet, frame_mismatch, same_rows, union_names
from geoloom.spec import Spec, as_type, check_name, one_feature
from geoloom.types import ELEMENT_TYPES, FeatureType, MissingFeatureError, OverwritePermission, TemporalDimensionWarning

T = FeatureType
DAYS = [datetime(2024, 1, d) for d in (1, 2, 3)]


def temporal(spark, days=DAYS, value=1.0, patch=0, kind="double"):
    rows = [(patch, t, y, x, [value + k, value + 10]) for k, t in enumerate(days) for y in range(2) for x in range(2)]
    return spark.createDataFrame([(p, t, y, x, [int(v) if kind == "int" else v for v in b]) for p, t, y, x, b in rows], f"patch_id long, ts timestamp_ntz, y int, x int, bands array<{kind}>")


def timeless(spark, value=1.0):
    return spark.createDataFrame([(0, y, x, [value]) for y in range(2) for x in range(2)], "patch_id long, y int, x int, bands array<double>")


@pytest.fixture
def patches(spark):
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 2.0, 2.0, 32633)], "patch_id long, min_x double, min_y double, max_x double, max_y double, crs int")
    frames = spark.createDataFrame([(0, t) for t in DAYS], "patch_id long, ts timestamp_ntz")
    meta = spark.createDataFrame([(0, "who", '"me"')], "patch_id long, name string, value string")
    return PatchSet({(T.DATA, "bands"): temporal(spark), (T.MASK, "clm"): temporal(spark, kind="int"), (T.DATA_TIMELESS, "dem"): timeless(spark), (T.META_INFO, "info"): meta}, boxes, frames)


@pytest.mark.parametrize(
    ("kind", "is_temporal", "is_timeless", "is_discrete", "is_image", "is_vector", "is_spatial", "ndim"),
    [
        (T.DATA, 1, 0, 0, 1, 0, 1, 4), (T.MASK, 1, 0, 1, 1, 0, 1, 4), (T.SCALAR, 1, 0, 0, 0, 0, 0, 2), (T.LABEL, 1, 0, 1, 0, 0, 0, 2), (T.VECTOR, 1, 0, 0, 0, 1, 1, None),
        (T.DATA_TIMELESS, 0, 1, 0, 1, 0, 1, 3), (T.MASK_TIMELESS, 0, 1, 1, 1, 0, 1, 3), (T.SCALAR_TIMELESS, 0, 1, 0, 0, 0, 0, 1), (T.LABEL_TIMELESS, 0, 1, 1, 0, 0, 0, 1),
        (T.VECTOR_TIMELESS, 0, 1, 0, 0, 1, 1, None), (T.META_INFO, 0, 0, 0, 0, 0, 0, None),
    ],
)
def test_predicates_of_types(kind, is_temporal, is_timeless, is_discrete, is_image, is_vector, is_spatial, ndim):
    got = (kind.is_temporal(), kind.is_timeless(), kind.is_discrete(), kind.is_image(), kind.is_vector(), kind.is_spatial())
    assert got == tuple(map(bool, (is_temporal, is_timeless, is_discrete, is_image, is_vector, is_spatial))) and kind.ndim() == ndim
    assert kind.is_array() == (ndim is not None) and kind.is_meta() == (kind is T.META_INFO)
    assert [f.name for f in kind.schema()][: len(kind.keys())] == kind.keys()


def test_types_of_elements_and_permissions():
    assert ELEMENT_TYPES["uint8"] == "smallint" and ELEMENT_TYPES["uint64"] == "decimal(20,0)" and ELEMENT_TYPES["float16"] == "float" and ELEMENT_TYPES["object"] == "string"
    assert OverwritePermission("ADD_ONLY") is OverwritePermission.ADD_ONLY and OverwritePermission("Overwrite_Patch") is OverwritePermission.OVERWRITE_PATCH
    with pytest.raises(ValueError):
        OverwritePermission(3)


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        (..., [("data", "a", "a"), ("data", "b", "b"), ("mask", "m", "m")]), (T.DATA, [("data", "a", "a"), ("data", "b", "b")]), ((T.DATA, "a"), [("data", "a", "a")]),
        ((T.DATA, "a", "z"), [("data", "a", "z")]), ((T.DATA, ...), [("data", "a", "a"), ("data", "b", "b")]), ({T.DATA: ["b", ("a", "q")], T.MASK: ...}, [("data", "b", "b"), ("data", "a", "q"), ("mask", "m", "m")]),
        ([(T.MASK, "m"), "data"], [("mask", "m", "m"), ("data", "a", "a"), ("data", "b", "b")]), ({}, []), ([], []),
    ],
)
def test_specifications(spec, want):
    have = [(T.DATA, "a"), (T.DATA, "b"), (T.MASK, "m")]
    found = Spec(spec).resolve(have)
    assert [(k.value, old, new) for k, old, new in found] == want and Spec(spec).features(have) == [(k, old) for k, old, _ in found]


def test_specifications_that_fail():
    have = [(T.DATA, "a")]
    for bad in (3, None, [4], (T.DATA, 5), "nonsense", [(T.DATA, "")]):
        with pytest.raises(ValueError):
            Spec(bad).resolve(have)
    for spec in (..., T.DATA, (T.DATA, ...)):
        with pytest.raises(ValueError):
            Spec(spec).resolve()
    with pytest.raises(MissingFeatureError):
        Spec((T.DATA, "no")).resolve(have)
    with pytest.raises(ValueError):
        Spec((T.DATA, "a"), allowed=[T.MASK])
    with pytest.raises(ValueError):
        Spec((T.DATA, "a"), allowed=lambda k: k.is_discrete())
    assert one_feature((T.DATA, "a")) == (T.DATA, "a", "a") and as_type("mask") is T.MASK
    with pytest.raises(ValueError):
        one_feature([(T.DATA, "a"), (T.DATA, "b")])
    for name in ("a.b", "a/b", "a\\b", "a|b", "a;b", "a:b", "a\nb", "a\tb", "", 7):
        with pytest.raises(ValueError):
            check_name(name)


def test_validation(spark, patches):
    with pytest.raises(ValueError):
        patches[T.MASK, "wrong"] = temporal(spark)
    with pytest.raises(ValueError):
        patches[T.DATA, "flat"] = timeless(spark)
    with pytest.raises(ValueError):
        patches[T.VECTOR, "v"] = spark.createDataFrame([(0, "g")], "patch_id long, geometry string")
    patches[T.VECTOR, "v"] = spark.createDataFrame([(0, DAYS[0], "g")], "patch_id long, TIMESTAMP timestamp_ntz, geometry string")
    with pytest.raises(MissingFeatureError):
        patches[T.DATA, "none"]
    with pytest.raises(MissingFeatureError):
        del patches[T.DATA, "none"]
    del patches[T.VECTOR, "v"]
    assert (T.VECTOR, "v") not in patches and T.VECTOR not in patches and T.DATA in patches and (T.DATA, "bands") in patches


def test_copies_share_tables_and_change_apart(spark, patches):
    copy = patches.select(...)
    assert copy.names() == patches.names() and copy[T.DATA, "bands"] is patches[T.DATA, "bands"]
    part = patches.select([(T.DATA, "bands", "b2"), T.META_INFO])
    assert part.names() == [(T.DATA, "b2"), (T.META_INFO, "info")] and part.frames is patches.frames and patches.select(T.DATA_TIMELESS).frames is None
    del copy[T.MASK, "clm"]
    assert (T.MASK, "clm") in patches
    assert patches.without(T.MASK).names() == copy.names()
    assert patches.rename((T.DATA, "bands", "x")).names()[0] == (T.DATA, "x")
    both = patches.duplicate((T.DATA, "bands", "again"))
    assert both[T.DATA, "again"] is both[T.DATA, "bands"]
    with pytest.raises(ValueError):
        patches.duplicate((T.DATA, "bands"))
    moved = patches.move_to(PatchSet(), (T.DATA_TIMELESS, "dem"))
    assert moved.names() == [(T.DATA_TIMELESS, "dem")]
    assert patches.where("y = 0", T.DATA)[T.DATA, "bands"].count() == 6
    assert union_names([moved, patches]) == patches.names()


def test_equality(spark, patches):
    nan = spark.createDataFrame([(0, 0, 0, [float("nan")])], "patch_id long, y int, x int, bands array<double>")
    a, b = patches.with_features({(T.DATA_TIMELESS, "dem"): nan}), patches.with_features({(T.DATA_TIMELESS, "dem"): nan.select("x", "y", "patch_id", "bands")})
    assert a.equals(b) and not a.equals(patches) and not a.equals(patches.without(T.MASK)) and not a.equals(PatchSet(a.features))
    assert not same_rows(nan, nan.withColumn("x", F.col("x").cast("long")))


def test_frames(spark, patches):
    got = [(r.t_idx, r.ts) for r in patches.indexed_frames().orderBy("ts").collect()]
    assert got == list(enumerate(DAYS))
    assert patches.check_frames() == []
    patches[T.DATA, "late"] = temporal(spark, [*DAYS, datetime(2024, 2, 1)])
    with pytest.warns(TemporalDimensionWarning):
        assert patches.check_frames() == [(T.DATA, "late")]
    with pytest.raises(ValueError):
        patches.check_frames(strict=True)
    assert frame_mismatch(patches.frames, patches[T.DATA, "late"]).count() == 1
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        PatchSet({(T.DATA_TIMELESS, "dem"): timeless(spark)}).check_frames()


def test_merging_of_patch_sets(spark, patches):
    """Ones and threes that share two of their frames: means where they meet; errors where equal values are asked for."""
    other = PatchSet({(T.DATA, "bands"): temporal(spark, [DAYS[1], DAYS[2], datetime(2024, 1, 9)], value=4.0), (T.DATA_TIMELESS, "dem"): timeless(spark, 1.0), (T.DATA_TIMELESS, "new"): timeless(spark)}, patches.boxes, spark.createDataFrame([(0, DAYS[2]), (0, datetime(2024, 1, 9))], "patch_id long, ts timestamp_ntz"))
    both = merge.merge([patches, other], temporal="mean")
    assert both.names() == union_names([patches, other]) and both.frames.count() == 4 and both.boxes.count() == 1
    rows = {(r.ts.day, r.y, r.x): r.bands for r in both[T.DATA, "bands"].collect()}
    assert len(rows) == 16 and rows[1, 0, 0] == [1.0, 11.0] and rows[2, 1, 1] == [(2 + 4) / 2, (11 + 14) / 2] and rows[9, 0, 1] == [6.0, 14.0]
    assert both[T.MASK, "clm"].schema["bands"].dataType.elementType.typeName() == "integer"
    with pytest.raises(Exception, match="should be equal"):
        merge.merge([patches, other])[T.DATA, "bands"].collect()
    with pytest.raises(ValueError):
        merge.merge([patches, other], temporal="nonsense")
    kept = merge.merge([patches, other], temporal="concatenate", timeless="concatenate")
    assert kept[T.DATA, "bands"].count() == 24 and {tuple(r.bands) for r in kept[T.DATA_TIMELESS, "dem"].collect()} == {(1.0, 1.0)}
    spread = merge.merge([patches, other], temporal=lambda v: v.max() - v.min())
    assert {(r.ts.day, *r.bands) for r in spread[T.DATA, "bands"].collect()} == {(1, 0.0, 0.0), (2, 2.0, 3.0), (3, 2.0, 3.0), (9, 0.0, 0.0)}
    moved = PatchSet({}, patches.boxes.withColumn("max_x", F.lit(9.0)))
    with pytest.raises(Exception, match="should be equal"):
        merge.merge([patches, moved]).boxes.collect()
