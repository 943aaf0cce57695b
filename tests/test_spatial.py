"""The spatial join against all pairs."""

import numpy as np
import pytest

from geoloom.operators import spatial

SCHEMA = "patch_id long, row long, min_x double, min_y double, max_x double, max_y double"


def boxes(rng, n, patch=0, start=0):
    x, y = rng.uniform(-50, 50, (2, n))
    size = rng.choice([0.0, 0.01, 0.5, 3.0, 40.0, 200.0], (2, n), p=[0.15, 0.25, 0.3, 0.2, 0.07, 0.03])
    return [(patch, start + k, *map(float, (x[k], y[k], x[k] + size[0][k], y[k] + size[1][k]))) for k in range(n)]


def meet(p, q):
    return p[0] == q[0] and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]


def test_pairs_of_one_table(spark):
    rng = np.random.default_rng(1)
    rows = boxes(rng, 250) + boxes(rng, 60, 1, 250) + [(0, 400 + k, 1.0, 1.0, 2.0, 2.0) for k in range(5)] + [(0, 410, 2.0, 2.0, 2.0, 2.0), (0, 411, 2.0, 0.0, 3.0, 1.0)]
    df = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], SCHEMA)
    want = sorted((p[0], *sorted((p[1], q[1]))) for k, p in enumerate(rows) for q in rows[:k] if meet(p, q))
    assert sorted(tuple(r) for r in spatial.boxes_that_meet(df, keys=["patch_id"]).collect()) == want
    plain = sorted(tuple(sorted((p[1], q[1]))) for k, p in enumerate(rows) for q in rows[:k] if meet((0, *p[1:]), (0, *q[1:])))
    assert sorted(tuple(r) for r in spatial.boxes_that_meet(df).collect()) == plain


def test_pairs_of_two_tables(spark):
    rng = np.random.default_rng(2)
    a, b = boxes(rng, 150), boxes(rng, 170, 0, 50)
    left, right = (spark.createDataFrame(r, SCHEMA).withColumnRenamed("row", "number") for r in (a, b))
    got = sorted(tuple(r) for r in spatial.boxes_that_meet(left, right, row="number").collect())
    assert got == sorted((p[1], q[1]) for p in a for q in b if meet(p, q))


@pytest.mark.parametrize("rows", [[], [(0, 1, 5.0, 5.0, 5.0, 5.0)], [(0, 1, 5.0, 5.0, 5.0, 5.0), (0, 2, 5.0, 5.0, 5.0, 5.0)]])
def test_few_boxes(spark, rows):
    assert spatial.boxes_that_meet(spark.createDataFrame(rows, SCHEMA)).count() == (len(rows) == 2)


def test_broken_boxes_meet_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, 0.0, 0.0, 9.0, 9.0), (0, 2, 1.0, None, 2.0, 2.0), (0, 3, nan, 1.0, 2.0, 2.0), (0, 4, 1.0, 1.0, inf, 2.0), (0, 5, 3.0, 1.0, 2.0, 2.0), (0, None, 1.0, 1.0, 2.0, 2.0), (0, 6, 9.0, 9.0, 10.0, 10.0)]
    assert [tuple(r) for r in spatial.boxes_that_meet(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 6)]


def test_no_nested_loops(spark):
    df = spark.createDataFrame(boxes(np.random.default_rng(3), 40), SCHEMA)
    plan = spatial.boxes_that_meet(df)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
