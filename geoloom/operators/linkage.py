"""Agglomerative clustering over a graph, in rounds.

The distance of two clusters comes from the links between them: their largest (complete), least (single) or mean distance
(average), or from the clusters' sizes and means (Ward). In a round every two clusters that are each other's nearest merge, in
all patches at once; for single linkage each cluster merges with its nearest. As the distance from a merged pair is never below
both of its parts' distances, complete, average and single linkage end in the tree that one merge at a time would give. Ward's
distance can fall where only one part has a link, so there the tree is that of the rounds. Equal distances go by the pixels
at the ends of the links that they come from.

A round is two or three aggregations of the links that are left and two joins by cluster, hot clusters apart
(operators.skew); its tables are written, and only their counts come to the driver. At least the nearest two clusters of each
patch merge in a round, usually a third of all. Patches of few links need no rounds: they are merged one pair at a time inside
their task, to the same tree (not so with Ward, which always takes the rounds). Links without a distance are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.operators.components import components
from geoloom.operators.skew import SMALL_ROWS, join_by
from geoloom.session import discard, materialize

LINKAGES = ("single", "complete", "average", "ward")
PAIR = ["patch_id", "a", "b"]
#: Links of a patch that a task merges by itself.
SHORT_GRAPH = 20_000
TREE = "patch_id long, a long, b long, h struct<distance:double,p:long,q:long>"


def ranked(distance: Column) -> Column:
    """A distance that no other pair of clusters can share."""
    return F.struct(distance.alias("distance"), F.col("a").alias("p"), F.col("b").alias("q"))


def ward_distance() -> Column:
    """From the sizes and sums at both ends: the square root of twice the growth of the squared deviations."""
    n, m = F.col("a_end.n"), F.col("b_end.n")
    gap = F.zip_with("a_end.s", "b_end.s", lambda x, y: (x / n - y / m) * (x / n - y / m))
    return F.sqrt(2 * n * m / (n + m) * F.aggregate(gap, F.lit(0.0), lambda t, v: t + v))


def started(nodes: DataFrame, edges: DataFrame, linkage: str) -> DataFrame:
    """The links between single pixels with what the linkage needs: h, their ranked distance, first."""
    links = edges.where("distance IS NOT NULL AND a <> b").select("patch_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("distance").cast("double").alias("distance"))
    if linkage == "ward":
        ends = nodes.select("node", F.struct(F.lit(1.0).alias("n"), F.col("bands").cast("array<double>").alias("s")).alias("end"))
        for k in ("a", "b"):
            links = links.join(ends.select(F.col("node").alias(k), F.col("end").alias(f"{k}_end")), k)
    links = links.withColumn("h", ranked(F.col("distance")))
    if linkage == "average":
        links = links.withColumns({"total": F.col("distance"), "times": F.lit(1).cast("long")})
    return together(links.drop("distance"), linkage)


def together(links: DataFrame, linkage: str) -> DataFrame:
    """One link for each pair of clusters."""
    groups = links.groupBy(*PAIR)
    if linkage == "average":
        return groups.agg(F.sum("total").alias("total"), F.sum("times").alias("times")).withColumn("h", ranked(F.col("total") / F.col("times")))
    if linkage == "ward":
        ends = groups.agg(F.max(F.struct("a_end", "b_end")).alias("e"))
        return ends.select(*PAIR, "e.*").withColumn("h", ranked(ward_distance()))
    return groups.agg((F.min if linkage == "single" else F.max)("h").alias("h"))


def chosen(links: DataFrame, linkage: str, distance: float | None) -> DataFrame:
    """The links that merge in this round."""
    near = links if distance is None else links.where(F.col("h.distance") <= distance)
    extra = ["a_end", "b_end"] if linkage == "ward" else []
    best = near.select("patch_id", F.explode(F.array("a", "b")).alias("node"), F.struct("h", "a", "b", *extra).alias("l"))
    best = best.groupBy("patch_id", "node").agg(F.min("l").alias("l"))
    picked = best.groupBy("patch_id", "l").agg(F.count("*").alias("ends"))
    return picked.where("ends = 2" if linkage != "single" else "ends > 0").select("patch_id", "l.*")


def moves(merged: DataFrame, linkage: str) -> DataFrame:
    """node, root and (Ward) the new end of every cluster that has merged."""
    if linkage == "single":
        return components(merged.select("a", "b")).where("node <> root")
    if linkage == "ward":
        s = F.zip_with("a_end.s", "b_end.s", lambda x, y: x + y)
        end = F.named_struct(F.lit("n"), F.col("a_end.n") + F.col("b_end.n"), F.lit("s"), s)
        return merged.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("root"), end.alias("end"))
    return merged.select(F.col("b").alias("node"), F.col("a").alias("root"))


def carried(links: DataFrame, moved: DataFrame, linkage: str, few: bool) -> DataFrame:
    """The links between the clusters after a round. few: there are so few moves that they may be broadcast."""
    for k in ("a", "b"):
        here = moved.withColumnRenamed("node", k)
        links = links.join(F.broadcast(here), k, "left") if few else join_by(links, here, k, how="left")
        links = links.withColumn(k, F.coalesce("root", k)).drop("root")
        if linkage == "ward":
            links = links.withColumn(f"{k}_end", F.coalesce("end", f"{k}_end")).drop("end")
    links, turned = links.where("a <> b"), F.col("a") > F.col("b")
    swap = {x: F.when(turned, F.col(y)).otherwise(F.col(x)) for x, y in (("a", "b"), ("b", "a"), *((("a_end", "b_end"), ("b_end", "a_end")) if linkage == "ward" else ()))}
    return together(links.withColumns(swap), linkage)


def settled(linkage: str, distance: float | None) -> Callable[[pa.Table], pa.Table]:
    """The tree of one patch with few links, the nearest two clusters at a time."""

    def height(value: tuple, a: int, b: int) -> tuple:
        return (value[0] / value[1], a, b) if linkage == "average" else value

    def combined(u: tuple, v: tuple) -> tuple:
        return (u[0] + v[0], u[1] + v[1]) if linkage == "average" else min(u, v) if linkage == "single" else max(u, v)

    def run(links: pa.Table) -> pa.Table:
        rows, near, found = links.to_pylist(), {}, []
        for r in rows:
            value = (r["total"], r["times"]) if linkage == "average" else tuple(r["h"].values())
            near.setdefault(r["a"], {})[r["b"]] = near.setdefault(r["b"], {})[r["a"]] = value
        heap = [(height(near[a][b], a, b), a, b) for a in near for b in near[a] if a < b]
        heapq.heapify(heap)
        while heap:
            h, a, b = heapq.heappop(heap)
            if distance is not None and not h[0] <= distance:
                break
            value = near.get(a, {}).get(b)
            if value is None or height(value, a, b) != h:
                continue  # of a cluster that has merged since
            found.append({"a": h[1] if linkage == "single" else a, "b": h[2] if linkage == "single" else b, "h": dict(zip("distance p q".split(), h, strict=True))})
            del near[a][b]
            for c, v in near.pop(b).items():
                if c != a:
                    del near[c][b]
                    v = combined(near[a][c], v) if c in near[a] else v
                    near[a][c] = near[c][a] = v
                    low, high = min(a, c), max(a, c)
                    heapq.heappush(heap, (height(v, low, high), low, high))
        patch = rows[0]["patch_id"]
        kind = pa.struct([("distance", pa.float64()), ("p", pa.int64()), ("q", pa.int64())])
        return pa.Table.from_pylist([{"patch_id": patch, **f} for f in found], pa.schema([("patch_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("h", kind)]))

    return run


def merge_tree(nodes: DataFrame, edges: DataFrame, linkage: str = "single", distance: float | None = None, short: int = SHORT_GRAPH, small: int = SMALL_ROWS) -> DataFrame:
    """patch_id, a, b, h: every merge, by a pixel of each of the two clusters, and its ranked distance.

    nodes: node, bands; edges: patch_id, a, b, distance. distance: no merge above it. short: links of a patch that is merged
    inside a task; small: most moves of a round that are broadcast.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {', '.join(LINKAGES)}, not {linkage!r}")
    links = materialize(started(nodes, edges, linkage), "linkage-links")
    found = []
    if linkage != "ward":
        long = links.groupBy("patch_id").agg(F.count("*").alias("n")).where(F.col("n") > short).select("patch_id")
        few = links.join(long, "patch_id", "left_anti").groupBy("patch_id").applyInArrow(settled(linkage, distance), TREE)
        found, links = [materialize(few, "linkage-merges")], materialize(links.join(long, "patch_id", "left_semi"), "linkage-links")
    while not links.isEmpty():
        merged = materialize(chosen(links, linkage, distance), "linkage-merges")
        ends = [F.col("h.p").alias("a"), F.col("h.q").alias("b")] if linkage == "single" else ["a", "b"]
        found.append(merged.select("patch_id", *ends, "h"))
        times = merged.count()
        if not times:
            break
        few = times * (2 if linkage != "complete" else 1) <= (small if linkage != "ward" else small // 16)
        after = materialize(carried(links, moves(merged, linkage), linkage, few), "linkage-links")
        discard(links)
        links = after
    discard(links)
    return reduce(DataFrame.unionByName, found) if found else nodes.sparkSession.createDataFrame([], TREE)


def kept_merges(tree: DataFrame, nodes: DataFrame, n_clusters: int) -> DataFrame:
    """The merges that leave n_clusters in each patch: all but its highest ones. A patch whose graph falls apart into more
    parts keeps those. Spark limits the ranks to n_clusters in each task before it shuffles them.
    """
    if n_clusters < 1:
        raise ValueError("n_clusters must be at least 1")
    parts = nodes.groupBy("patch_id").agg(F.count("*").alias("_nodes")).join(tree.groupBy("patch_id").agg(F.count("*").alias("_merges")), "patch_id")
    place = F.row_number().over(Window.partitionBy("patch_id").orderBy(F.desc("h")))
    high = tree.withColumn("_place", place).where(F.col("_place") <= n_clusters).join(parts, "patch_id")
    cut = high.where(F.col("_place") <= n_clusters - (F.col("_nodes") - F.col("_merges")))
    return tree.join(cut.select(*PAIR), PAIR, "left_anti")
