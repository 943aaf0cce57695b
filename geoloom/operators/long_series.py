"""Curves through series of any length: Akima's by windows, cubic and B-splines by a partitioned banded solve.

A long series is cut into parts of PART points (and fewer than twice as many in the last). Each part solves its own rows, with
what it would take from its neighbours' coefficients left open; what the parts say about their outermost coefficients is a banded
system of a few rows a part, which gives every part the coefficients beside it. Then each part solves again and gives its values.
Points within a halo of a part's border go to both parts, so no task holds more than a part, or one row for each part.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions import curves
from geoloom.operators.skew import few_rows
from geoloom.session import materialize

#: Points of a part; a series of more than twice as many is long.
PART = 4096


def akima(points: DataFrame, wanted: DataFrame, series: Sequence[str]) -> DataFrame:
    """wanted (series, t, ...) with `curve`, Akima's piecewise cubic through points (series, t, v; one for each time).

    Slopes at a point weigh the neighbouring slopes by their changes; two slopes beyond each end are extrapolated. A series of
    two points is a straight line; outside the points, or with fewer than two, there is no value.
    """
    along = Window.partitionBy(*series).orderBy("t")
    after = lambda c, n=1: F.lead(c, n).over(along)
    before = lambda c, n=1: F.lag(c, n).over(along)
    p = points.select(*series, "t", "v", after("t").alias("t1"), after("v").alias("v1")).withColumn("m", (F.col("v1") - F.col("v")) / (F.col("t1") - F.col("t")))
    p = p.withColumns({"m1": after("m"), "_1": before("m"), "_2": before("m", 2)})
    m, m1, b1, b2 = (F.col(c) for c in ("m", "m1", "_1", "_2"))
    slopes = {  # two before the point and two after it
        "s0": F.coalesce(b2, F.when(b1.isNotNull(), 2 * b1 - m).otherwise(3 * m - 2 * m1)),
        "s1": F.coalesce(b1, 2 * m - m1),
        "s2": F.coalesce(m, 2 * b1 - b2),
        "s3": F.coalesce(m1, F.when(m.isNotNull(), 2 * m - b1).otherwise(3 * b1 - 2 * b2)),
    }
    p = p.withColumns(slopes)
    w1, w2 = F.abs(F.col("s3") - F.col("s2")), F.abs(F.col("s1") - F.col("s0"))
    d = F.when(w1 + w2 < 1e-12, (F.col("s1") + F.col("s2")) / 2).otherwise((w1 * F.col("s1") + w2 * F.col("s2")) / (w1 + w2))
    p = p.withColumn("d", F.coalesce(d, m, b1)).withColumn("d1", after("d"))
    knot = F.struct(*(F.col(c).alias(c) for c in ("t", "v", "d", "t1", "v1", "d1")))
    rows = p.select(*series, "t", knot.alias("_knot")).unionByName(wanted.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    upto = Window.partitionBy(*series).orderBy("t", F.asc_nulls_first("_asked")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_at", F.last("_knot", ignorenulls=True).over(upto)).where("_asked")
    k = F.col("_at")
    h, u = k["t1"] - k["t"], F.col("t") - k["t"]
    s = (k["v1"] - k["v"]) / h
    inside = k["v"] + u * (k["d"] + u * ((3 * s - 2 * k["d"] - k["d1"]) / h + u * (k["d"] + k["d1"] - 2 * s) / (h * h)))
    curve = F.when((u == 0) & k["d"].isNotNull(), k["v"]).otherwise(inside)
    return rows.select(*wanted.columns, curve.alias("curve"))


def coupled(bands: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A part's own bands, and its rows' entries at the w coefficients before and after it (rows by w)."""
    n = len(bands)
    i, c = np.arange(n)[:, None], np.arange(-w, w + 1)[None, :]
    column = i + c
    own = np.where((column >= 0) & (column < n), bands, 0.0)
    left, right = np.zeros((n, w)), np.zeros((n, w))
    at = (column < 0) & (column >= -w)
    left[np.nonzero(at)[0], (column + w)[at]] = bands[at]
    at = (column >= n) & (column < n + w)
    right[np.nonzero(at)[0], (column - n)[at]] = bands[at]
    return own, left, right


def part_solution(curve, x: np.ndarray, y: np.ndarray, at: int, n: int, first: int, last: int) -> np.ndarray:
    """A part's coefficients with no neighbours, and what each neighbouring coefficient takes away (1 + 2 w columns)."""
    bands, right = curve.rows(x, y, at, n, first, last)
    own, before, after = coupled(bands, curve.width)
    return curves.banded(own, np.column_stack([right, before, after]))


def reduced(w: int, parts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The w coefficients before and after each part; parts: the first and last w rows of each one's solution (2 w by 1 + 2 w)."""
    size, reach = 2 * w, 3 * w
    bands, right = np.zeros((size * len(parts), 2 * reach + 1)), np.zeros(size * len(parts))
    for k, p in enumerate(parts):
        for r in range(size):
            i = size * k + r
            bands[i, reach] = 1
            right[i] = p[r, 0]
            for c in range(w):
                if k:  # the last w of the part before
                    bands[i, size * (k - 1) + w + c - i + reach] += p[r, 1 + c]
                if k + 1 < len(parts):  # the first w of the part after
                    bands[i, size * (k + 1) + c - i + reach] += p[r, 1 + w + c]
    z = curves.banded(bands, right).reshape(len(parts), size)
    none = np.zeros(w)
    return [(z[k - 1][w:] if k else none, z[k + 1][:w] if k + 1 < len(parts) else none) for k in range(len(parts))]


def parted(points: DataFrame, series: Sequence[str], part: int) -> DataFrame:
    """points (series, t, v) with g, the place in the series, its length n, and the part.

    Places come from a sort by range: a point's place in its partition plus the series' points in the partitions before it.
    """
    keys = list(series)
    rows = points.repartitionByRange(*keys, "t").sortWithinPartitions(*keys, "t").withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows, "series")
    rows = rows.withColumn("piece", F.shiftright("at", 33))
    pieces = rows.groupBy(*keys, "piece").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    along = Window.partitionBy(*keys)
    pieces = pieces.withColumns({"n": F.sum("size").over(along), "before": F.sum("size").over(along.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))})
    pieces = few_rows(materialize(pieces.select(*keys, "piece", "n", (F.coalesce("before", F.lit(0)) - F.col("first")).alias("shift")), "pieces"))
    out = rows.join(pieces, [*keys, "piece"]).withColumn("g", F.col("at") + F.col("shift"))
    last = F.greatest(F.expr(f"n div {part}"), F.lit(1)) - 1
    return out.select(*keys, "t", "v", "g", "n", F.least(F.expr(f"g div {part}"), last).alias("part"))


def banded_curve(points: DataFrame, wanted: DataFrame, series: Sequence[str], kind: str, part: int = PART, **options) -> DataFrame:
    """wanted (series, t, ...) with `curve`; points (series, t, v): one for each time, no nulls."""
    curve, keys = curves.BANDED[kind](**options), list(series)
    w, halo = curve.width, curve.halo
    if part < 2 * (w + halo):
        raise ValueError(f"a part has {2 * (w + halo)} points at least")
    rows = materialize(parted(points, keys, part), "parts")
    last = F.greatest(F.expr(f"n div {part}"), F.lit(1)) - 1
    near = F.sequence(F.greatest(F.least(F.expr(f"(g - {halo}) div {part}"), last), F.lit(0)), F.least(F.expr(f"(g + {halo}) div {part}"), last))
    shared = rows.select(*keys, "t", "v", "g", "n", F.col("part").alias("own"), F.explode(near).alias("part"))
    types = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)

    def taken(pdf: pd.DataFrame):
        pdf = pdf.sort_values("g")
        own = pdf.loc[pdf["own"] == pdf["part"].iloc[0], "g"]
        return pdf["t"].to_numpy(), pdf["v"].to_numpy(), int(pdf["g"].iloc[0]), int(pdf["n"].iloc[0]), int(own.iloc[0]), int(own.iloc[-1])

    def local(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = part_solution(curve, *taken(pdf))
        return pd.DataFrame([(*key, np.vstack([s[:w], s[-w:]]).ravel())], columns=[*keys, "part", "s"])

    said = shared.groupBy(*keys, "part").applyInPandas(local, f"{types}, part long, s array<double>")

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        sides = reduced(w, [np.asarray(s).reshape(2 * w, 1 + 2 * w) for s in pdf["s"]])
        return pd.DataFrame([(*key, p, a, b) for p, (a, b) in zip(pdf["part"], sides, strict=True)], columns=[*keys, "part", "before", "after"])

    sides = said.groupBy(*keys).applyInPandas(meet, f"{types}, part long, before array<double>, after array<double>")  # a row for each part
    sides = materialize(sides, "sides")
    starts = rows.groupBy(*keys, "part").agg(F.min("t").alias("start")).groupBy(*keys).agg(F.array_sort(F.collect_list("start")).alias("starts"))
    asked = wanted.join(starts, keys).withColumn("part", F.greatest(F.size(F.filter("starts", lambda s: s <= F.col("t"))) - 1, F.lit(0)).cast("long")).drop("starts")
    rest = [c for c in wanted.columns if c not in (*keys, "t")]
    everything = shared.unionByName(asked, allowMissingColumns=True).join(few_rows(sides), [*keys, "part"])
    names = [*keys, "t", *rest, "curve"]

    def values(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known, want = pdf[pdf["g"].notna()], pdf[pdf["g"].isna()].copy()
        if not len(want):
            return pd.DataFrame(columns=names)
        x, y, at, n, first, last = taken(known)
        before, after = np.asarray(pdf["before"].iloc[0]), np.asarray(pdf["after"].iloc[0])
        s = part_solution(curve, x, y, at, n, first, last)
        own = s[:, 0] - s[:, 1 : 1 + w] @ before - s[:, 1 + w :] @ after
        c = np.full(len(x), np.nan)
        a = first - at
        c[a : a + len(own)] = own
        k = min(w, a)
        c[a - k : a] = before[w - k :]
        k = min(w, len(x) - a - len(own))
        c[a + len(own) : a + len(own) + k] = after[:k]
        t = want["t"].to_numpy()
        # only the points whose coefficients are known; values of this part need no others
        lo, hi = a - min(w, a), a + len(own) + k
        got = np.full(len(t), np.nan)
        inside = (t >= x[0]) & (t <= x[-1])
        got[inside] = curve.values(x, y, at, n, c, t[inside]) if isinstance(curve, curves.Spline) else curve.values(x[lo:hi], y[lo:hi], at + lo, n, c[lo:hi], t[inside])
        want["curve"] = got
        return want[names]

    kinds = ", ".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in (*keys, "t", *rest))
    out = everything.groupBy(*keys, "part").applyInPandas(values, f"{kinds}, curve double")
    return out.withColumn("curve", F.when(~F.isnan("curve"), F.col("curve")))


def kriged(points: DataFrame, wanted: DataFrame, series: Sequence[str], part: int = PART, length: float | str = 0.1, noise: float = 1e-6, neighbours: int = curves.NEIGHBOURS) -> DataFrame:
    """wanted (series, t, ...) with `curve`, the mean of a Gaussian process of which each value sees its neighbourhood.

    Parts share `neighbours` points at their borders; the likelihood of each length is summed over parts.
    """
    keys, rest = list(series), [c for c in wanted.columns if c not in (*series, "t")]
    rows = materialize(parted(points, keys, part), "parts")
    whole = rows.groupBy(*keys).agg(F.avg("v").alias("middle"), F.min("t").alias("from"), F.max("t").alias("to"))
    types = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    scaled = lambda df: df.join(whole, keys).withColumn("a", (F.col("t") - F.col("from")) / (F.col("to") - F.col("from")))
    if length == "fit":

        def say(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("a")
            return pd.DataFrame([(*key[:-1], curves.likelihoods(pdf["a"].to_numpy(), (pdf["v"] - pdf["middle"]).to_numpy(), noise, neighbours))], columns=[*keys, "l"])

        said = scaled(rows).groupBy(*keys, "part").applyInPandas(say, f"{types}, l array<double>")
        sums = said.groupBy(*keys).agg(F.array(*(F.sum(F.get("l", F.lit(k))) for k in range(len(curves.LENGTHS)))).alias("l"))
        best = F.pandas_udf(lambda l: l.map(lambda x: curves.best_length(np.asarray(x))), "double")
        whole = whole.join(materialize(sums.select(*keys, best("l").alias("length")), "lengths"), keys)
    else:
        whole = whole.withColumn("length", F.lit(float(length)))
    last = F.greatest(F.expr(f"n div {part}"), F.lit(1)) - 1
    near = F.sequence(F.greatest(F.least(F.expr(f"(g - {2 * neighbours}) div {part}"), last), F.lit(0)), F.least(F.expr(f"(g + {2 * neighbours}) div {part}"), last))
    starts = rows.groupBy(*keys, "part").agg(F.min("t").alias("start")).groupBy(*keys).agg(F.array_sort(F.collect_list("start")).alias("starts"))
    asked = wanted.join(starts, keys).withColumn("part", F.greatest(F.size(F.filter("starts", lambda s: s <= F.col("t"))) - 1, F.lit(0)).cast("long")).drop("starts")
    both = scaled(rows.select(*keys, "t", "v", "g", F.explode(near).alias("part")).unionByName(asked, allowMissingColumns=True))
    names = [*keys, "t", *rest, "curve"]

    def values(pdf: pd.DataFrame) -> pd.DataFrame:
        known, want = pdf[pdf["g"].notna()].sort_values("g"), pdf[pdf["g"].isna()].copy()
        at, middle = want["a"].to_numpy(), pdf["middle"].iloc[0]
        inside, got = (at >= 0) & (at <= 1), np.full(len(at), np.nan)
        if inside.any():
            got[inside] = middle + curves.near_values(known["a"].to_numpy(), known["v"].to_numpy() - middle, at[inside], pdf["length"].iloc[0], noise, neighbours)
        want["curve"] = got
        return want[names]

    kinds = ", ".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in (*keys, "t", *rest))
    out = both.groupBy(*keys, "part").applyInPandas(values, f"{kinds}, curve double")
    return out.withColumn("curve", F.when(~F.isnan("curve"), F.col("curve")))


def long_keys(points: DataFrame, series: Sequence[str], most: int = 2 * PART) -> DataFrame:
    """Series of more than so many points: few, as each has many."""
    return points.groupBy(*series).agg(F.count("*").alias("_n")).where(F.col("_n") > most).drop("_n")


def same_series(a: DataFrame, b: DataFrame, series: Sequence[str], how: str) -> DataFrame:
    """Rows of a whose series is (or isn't) among b's; nulls are values."""
    named = b.select(*(F.col(k).alias(f"_{k}") for k in series))
    match: Column | None = None
    for k in series:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        match = one if match is None else match & one
    return a.join(F.broadcast(named), match, how)
