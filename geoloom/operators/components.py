"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is two aggregations and two joins; each is written to the shared folder, and only counts and a checksum come
to the driver. The rounds grow with the logarithm of the number of nodes. A star's centre may be a neighbour of any number of
nodes: its links are met by a broadcast of the heavy centres (operators.skew), never gathered in one task. A round's table is
deleted when the next one is written. Before the first round each task contracts the links that it holds, CHUNK at a time, to
stars of the same components, which saves rounds and rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.skew import join_by
from geoloom.session import discard, materialize


#: Links that a task contracts together.
CHUNK = 500_000


def stars(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Links (root, node) that connect what the links (a, b) connect, the root being the smallest node."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            top[max(x, y)] = min(x, y)
    nodes = [x for x in top if top[x] != x]
    return [find(x) for x in nodes], nodes


def contracted(edges: DataFrame) -> DataFrame:
    """Links a < b of the same components, from the links of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for batch in batches:
            a += batch.column("a").to_pylist()
            b += batch.column("b").to_pylist()
            if len(a) >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(a, b)], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(a, b)], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long").distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours now hang on its smallest neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return join_by(edges, least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours now hang on the smallest of them. edges: a < b.

    A node has no more smaller neighbours than there were tasks that contracted its links, so no key of this join is hot.
    """
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("b"))
    return moved.select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of its component. links: columns a and b."""
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(contracted(edges), "links")
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        new = materialize(small_star(large_star(edges)), "links")
        discard(edges)
        edges = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
