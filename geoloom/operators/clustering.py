"""Clusters of neighbouring pixels: single linkage with a distance threshold is the connected components of the pixel graph
whose edges join neighbours at most so far apart, so it is a join and a component search, whatever the image's size. Other
linkages, and a wanted number of clusters, go through rounds of merges (operators.linkage).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.layout import with_pixel_numbers
from geoloom.operators.components import components
from geoloom.operators.linkage import kept_merges, merge_tree
from geoloom.session import materialize


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def manhattan_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)


DISTANCES = {"cosine": cosine_distance, "euclidean": euclidean_distance, "l2": euclidean_distance, "manhattan": manhattan_distance, "l1": manhattan_distance}


def pixel_edges(pixels: DataFrame, affinity: str = "cosine") -> DataFrame:
    """patch_id, a, b, distance for each pair of pixels beside each other; a and b are the pixels' numbers (layout.with_pixel_numbers)."""
    f = DISTANCES[affinity]
    nodes = pixels if "node" in pixels.columns else with_pixel_numbers(pixels, ["patch_id"])
    step = F.explode(F.array(F.struct(F.lit(0).alias("dy"), F.lit(1).alias("dx")), F.struct(F.lit(1).alias("dy"), F.lit(0).alias("dx"))))
    sent = nodes.select("patch_id", "y", "x", F.col("node").alias("a"), F.col("bands").alias("_bands"), step.alias("s"))
    sent = sent.select("patch_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "a", "_bands")
    met = sent.join(nodes, ["patch_id", "y", "x"])
    return met.select("patch_id", "a", F.col("node").alias("b"), f(F.col("_bands").cast("array<double>"), F.col("bands").cast("array<double>")).alias("distance"))


def cluster(
    pixels: DataFrame,
    distance: float | None = None,
    affinity: str = "cosine",
    remove_small: int = 0,
    mask: Column | None = None,
    edges: DataFrame | None = None,
    linkage: str = "single",
    n_clusters: int | None = None,
) -> DataFrame:
    """patch_id, y, x, cluster of each pixel; -1 for masked pixels and clusters of fewer than remove_small pixels.

    Either distance, above which nothing merges, or n_clusters, the number of clusters of each patch. Clusters of a patch are
    numbered from 0 in the order of their first pixels. edges: a graph other than the grid's.
    """
    if (distance is None) == (n_clusters is None):
        raise ValueError("give either distance or n_clusters")
    if linkage == "ward" and affinity not in ("euclidean", "l2"):
        raise ValueError("Ward's linkage needs Euclidean distances")
    used = materialize(with_pixel_numbers(pixels if mask is None else pixels.where(mask), ["patch_id"]), "cluster-nodes")
    graph = pixel_edges(used, affinity) if edges is None else edges
    if linkage == "single" and n_clusters is None:
        graph = graph.where(F.col("distance") <= distance)
    else:
        graph = merge_tree(used, graph, linkage, distance)
        graph = graph if n_clusters is None else kept_merges(graph, used, n_clusters)
    roots = components(graph.select("a", "b"))
    nodes = used.select("patch_id", "y", "x", "node")
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = named.groupBy("patch_id", "root").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("first"))
    sizes = sizes.where(F.col("n") >= remove_small).withColumn("cluster", F.row_number().over(Window.partitionBy("patch_id").orderBy("first")) - 1)
    out = named.join(sizes.select("patch_id", "root", "cluster"), ["patch_id", "root"], "left").select("patch_id", "y", "x", "cluster")
    return pixels.select("patch_id", "y", "x").join(out, ["patch_id", "y", "x"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def boundaries(pixels: DataFrame, clusters: DataFrame, keys: Sequence[str] = ("patch_id", "y", "x")) -> DataFrame:
    """pixels with the cluster's number as a band at the end."""
    return pixels.join(clusters, list(keys)).withColumn("bands", F.concat("bands", F.array(F.col("cluster").cast("double")))).drop("cluster")
