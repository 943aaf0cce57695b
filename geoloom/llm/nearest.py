"""Approximate nearest neighbours by multiprobe p-stable hashing.

TABLES hash tables each cut Gaussian projections of a vector (2-stable, so that a neighbour at distance r is moved by r times a
normal number) into cells of equal width; a bucket is a combination of cells. A query visits, over all tables, the buckets in
which a neighbour may lie, its own first and the others in order of their estimated success, down to a cutoff; the candidates of all tables are merged and
ranked by exact distance.

What is fitted: centre and spread of the projections on SAMPLE_ROWS vectors, and, on SAMPLE_QUERIES queries whose true neighbours
are found by brute force over all vectors, where a neighbour's projection lies given the query's (a normal number) and the
cutoff that reaches `reach` of these neighbours. Both samples are the smallest hashes, of fixed number. Every vector is indexed.
The number of cells grows with the logarithm of the number of vectors. A bucket of any size is whole: it is cut into blocks of
at most BLOCK vectors, each visited by all of the bucket's queries, and every block returns only its nearest ones for a query,
so no pairs are written but those that may be returned.

Equal vectors are one class with its smallest k + 1 ids, which is all that a result of k can show; ids are put back at the end,
where a query's own is left out.

Cases: vectors that are null, empty, zero, or hold a null, a NaN or an infinity, and rows with a null id or a length other than the most
frequent one, take no part; repeated rows count once; several vectors of one id are each searched and found; fewer than k
candidates are all that is returned; ties go to the smaller id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.common import materialize
from geoloom.llm.vectors import matrices, vector_rows
from geoloom.operators.skew import few_rows
from geoloom.session import discard

TABLES, CELL, SEED = 4, 2.5, 20240229
#: Vectors in a bucket that the number of projections aims at, and those that a block holds at most.
OCCUPANCY, BLOCK = 128, 4096
#: Bounds of what is fitted on: rows for centre and spread, queries for the success model and the cutoff.
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 128
#: Share of the sample's true neighbours that the cutoff has to reach.
REACH = 0.96
#: Queries whose distances to a block are worked out together.
TOGETHER = 512
#: Rows that a task holds before it drops those that can't be among the nearest.
MOST_HELD = 100_000
EMPTY = "query_id long, rank int, vec_id long, score double"


def classes_of(rows: DataFrame, d: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(key, vec_id, vec) of the valid rows, and classes of equal vectors: key, vec (bytes), ids (the k + 1 smallest)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, v in matrices(batches, d):
            ok = np.flatnonzero(np.isfinite(v).all(1) & (v != 0).any(1))
            v = v[ok] + np.array(0, v.dtype)  # one zero only
            yield pa.RecordBatch.from_arrays([piece.column("vec_id").take(pa.array(ok)), pa.array([x.tobytes() for x in v], pa.binary())], names=["vec_id", "vec"])

    valid = rows.where("vec_id is not null").mapInArrow(encode, "vec_id long, vec binary").select(F.unhex(F.md5("vec")).alias("key"), "vec_id", "vec")
    ids = valid.select("key", "vec_id").distinct()  # the limit of each key is applied before a shuffle as well, so copies don't meet
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = ids.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return valid, valid.groupBy("key").agg(F.first("vec").alias("vec")).join(ids, "key")


class Cells:
    """Projections and cells; plain numbers, small enough for a closure."""

    def __init__(self, sample: np.ndarray, n: int):
        d = sample.shape[1]
        rng = np.random.default_rng(SEED)
        self.k = max(2, int(np.ceil(np.log2(max(n / OCCUPANCY, 2)) / 1.25)))
        self.lines = rng.normal(size=(d, TABLES * self.k))
        at = sample.astype(float) @ self.lines
        self.centre, self.spread = at.mean(0), np.maximum(at.std(0), 1e-12)
        self.shift = rng.uniform(0, CELL, TABLES * self.k)
        self.mix = rng.integers(1, 1 << 62, (TABLES, self.k)) | 1
        self.slope, self.noise, self.cutoff = 0.0, 1.0, 0.0

    def places(self, v: np.ndarray) -> np.ndarray:
        """Projections in units of their spread."""
        return (v.astype(float) @ self.lines - self.centre) / self.spread

    def cells(self, places: np.ndarray) -> np.ndarray:
        """Cell of each projection; what lies beyond 9 spreads shares the outer cell."""
        return np.floor((np.clip(places, -9, 9) + self.shift) / CELL).astype(np.int64)

    def bucket(self, cells: np.ndarray, table: int) -> np.ndarray:
        """A number for each combination of cells (rows); two that share one are visited together."""
        with np.errstate(over="ignore"):
            x = (cells * self.mix[table]).sum(1)
            return x ^ (x >> 29)

    def log_success(self, place: np.ndarray, column: int) -> tuple[int, np.ndarray]:
        """First cell, and for each query (row) and cell of one projection the log probability that a neighbour lies there."""
        first, last = np.floor((np.array([-9, 9]) + self.shift[column]) / CELL).astype(int)
        edges = np.arange(first + 1, last + 1) * CELL - self.shift[column]
        below = normal((edges - self.slope * place[:, None]) / self.noise)
        below = np.hstack([np.zeros((len(place), 1)), below, np.ones((len(place), 1))])
        return first, np.log(np.maximum(np.diff(below, axis=1), 1e-12))

    def visits(self, places: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query (row), bucket and log success of every bucket of a table at or above the cutoff, and of the query's own bucket.

        The own bucket comes first (log success 0), as near copies lie there, whatever the success model says.
        Projections are added one by one; what can't reach the cutoff even with the best cells of the rest goes at once.
        """
        columns = [table * self.k + i for i in range(self.k)]
        chances = [self.log_success(places[:, c], c) for c in columns]
        best = np.array([p.max(1) for _, p in chances])
        rest = best[::-1].cumsum(0)[::-1]
        query, so_far, code = np.arange(len(places)), np.zeros(len(places)), np.zeros((len(places), 0), np.int64)
        for i, (first, p) in enumerate(chances):
            after = rest[i + 1][query] if i + 1 < self.k else 0.0
            total = so_far[:, None] + p[query]
            at, cell = np.nonzero(total >= (self.cutoff - after)[:, None] if isinstance(after, np.ndarray) else total >= self.cutoff)
            so_far, code, query = total[at, cell], np.column_stack([code[at], first + cell]), query[at]
        bucket, own = self.bucket(code, table), self.bucket(self.cells(places)[:, columns], table)
        others = bucket != own[query]
        return np.concatenate([np.arange(len(places)), query[others]]), np.concatenate([own, bucket[others]]), np.concatenate([np.zeros(len(places)), so_far[others]])

    def success_of(self, places: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Log success of the bucket of `cells` for each query, in the table where it is largest."""
        logs = []
        for c in range(TABLES * self.k):
            first, p = self.log_success(places[:, c], c)
            logs.append(p[np.arange(len(places)), cells[:, c] - first])
        return np.array(logs).reshape(TABLES, self.k, -1).sum(1).max(0)

    def fit(self, asked: np.ndarray, found: np.ndarray, reach: float) -> None:
        """Success model and cutoff from pairs of a query and a true neighbour."""
        q, v = self.places(asked), self.places(found)
        self.slope = float((q * v).sum() / max((q * q).sum(), 1e-12))
        self.noise = max(float((v - self.slope * q).std()), 1e-3)
        reached = np.sort(self.success_of(q, self.cells(v)))[::-1]
        self.cutoff = float(reached[min(len(reached) - 1, int(np.ceil(reach * len(reached))) - 1)]) - 1e-9


def normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 (Abramowitz and Stegun 7.1.26)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.where(z > 0, 1 - tail / 2, tail / 2)


def nearest_of(queries: np.ndarray, block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query (row), vector of the block and exact distance, for the k nearest of each query and what ties with them.

    A matrix product bounds the distances; those that may be among the k nearest are worked out by differences.
    """
    q, v = queries.astype(float), block.astype(float)
    sizes = (q * q).sum(1)[:, None] + (v * v).sum(1)
    rough = sizes - 2 * (q @ v.T)
    slack = 1e-12 * v.shape[1] * (sizes.max(1, initial=0) + 1e-300)
    limit = np.partition(rough, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1] + 2 * slack
    at, of = np.nonzero(rough <= limit[:, None])
    return at, of, np.sqrt(((q[at] - v[of]) ** 2).sum(1))


class Best:
    """The k nearest classes that a task has seen so far for each query, of MOST_HELD rows at most before they are passed on."""

    def __init__(self, k: int):
        self.k = k
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bound: list[float] = []
        self.held: list[tuple] = []

    def add(self, query: bytes, score: float, found: bytes, ids: list[int]) -> None:
        n = self.number.setdefault(query, len(self.bound))
        if n == len(self.bound):
            self.bound.append(float("inf"))
        if score <= self.bound[n]:
            self.held.append((n, score, ids[0], found, ids, query))

    def trim(self) -> None:
        """Keeps k classes for each query; one that several tables or blocks found counts once."""
        out, before, seen = [], (None,) * 4, 0
        for row in sorted(self.held):
            if row[:4] == before[:4]:
                continue
            seen = seen + 1 if row[0] == before[0] else 1
            before = row
            if seen <= self.k:
                out.append(row)
                if seen == self.k:
                    self.bound[row[0]] = row[1]
        self.held = out

    def batch(self) -> pa.RecordBatch:
        _, score, _, found, ids, query = zip(*self.held, strict=True) if self.held else ([],) * 6
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(query, pa.binary()), pa.array(found, pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array(score, pa.float64())], names=["key", "found", "ids", "score"])


def true_neighbours(classes: DataFrame, sample: list, dtype: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a sampled query's vector and one of its k nearest, by brute force over all classes; equal vectors don't count."""
    keys, asked = [r["key"] for r in sample], np.array([np.frombuffer(r["vec"], dtype) for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, float, bytes]] = []
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                vec = piece.column("vec").to_pylist()
                at, of, far = nearest_of(asked, np.array([np.frombuffer(x, dtype) for x in vec]), k + 1)
                held = best(held + [(int(a), float(f), vec[o]) for a, o, f in zip(at, of, far, strict=True) if f > 0], k)
        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int32()), pa.array([h[1] for h in held], pa.float64()), pa.array([h[2] for h in held], pa.binary())], names=["q", "far", "vec"])

    def best(held: list, k: int) -> list:
        out, seen = [], dict.fromkeys(range(len(keys)), 0)
        for h in sorted(held):
            if seen[h[0]] < k:
                seen[h[0]] += 1
                out.append(h)
        return out

    near = classes.select("vec").mapInArrow(run, "q int, far double, vec binary")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("far", "vec"))).where(F.col("r") <= k)
    rows = near.select("q", "vec").collect()  # SAMPLE_QUERIES times k rows at most
    return np.array([asked[r["q"]] for r in rows]), np.array([np.frombuffer(r["vec"], dtype) for r in rows])


def nearest(table: DataFrame, asks: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", reach: float = REACH) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found for each row where `asks` (a condition on vec_id)."""
    spark = table.sparkSession
    rows, d = vector_rows(table, id_col, vec_col)
    if not d:
        return spark.createDataFrame([], EMPTY)
    dtype = "<f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    valid, classes = classes_of(rows, d, k)
    classes = materialize(classes, "vectors")
    queries = materialize(valid.where(asks).select("key", F.col("vec_id").alias("query_id")).distinct(), "queries")
    searched = materialize(classes.join(queries.select("key").distinct(), "key", "left_semi").select("key", "vec"), "searched")
    sampled = lambda df, most: df.orderBy(F.xxhash64("key"), "key").limit(most).select("key", "vec").collect()
    some, few = sampled(classes, SAMPLE_ROWS), sampled(searched, SAMPLE_QUERIES)
    if not few:
        return spark.createDataFrame([], EMPTY)
    cells = Cells(np.array([np.frombuffer(r["vec"], dtype) for r in some]), classes.count())
    pairs = true_neighbours(classes, few, dtype, k)
    if len(pairs[0]):
        cells.fit(*pairs, reach)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = cells.cells(cells.places(np.array([np.frombuffer(x, dtype) for x in batch.column("vec").to_pylist()]).reshape(-1, d)))
            for t in range(TABLES):
                bucket = cells.bucket(codes[:, t * cells.k : (t + 1) * cells.k], t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(bucket), *(batch.column(c) for c in ("key", "vec", "ids"))], names=["t", "bucket", "key", "vec", "ids"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                places = cells.places(np.array([np.frombuffer(x, dtype) for x in piece.column("vec").to_pylist()]).reshape(-1, d))
                found = [cells.visits(places, t) for t in range(TABLES)]
                t = np.concatenate([np.full(len(f[0]), i, np.int32) for i, f in enumerate(found)])
                query, bucket, success = (np.concatenate([f[i] for f in found]) for i in range(3))
                order = np.lexsort([-success, query])  # each query's visits in estimated success order, tables mixed
                for at in range(0, len(order), 8192):
                    part = order[at : at + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array(t[part]), pa.array(bucket[part]), *(piece.column(c).take(pa.array(query[part])) for c in ("key", "vec"))], names=["t", "bucket", "key", "vec"])

    entries = classes.mapInArrow(index, "t int, bucket long, key binary, vec binary, ids array<long>")
    visits = searched.mapInArrow(probe, "t int, bucket long, key binary, vec binary")
    large = entries.groupBy("t", "bucket").count().where(F.col("count") > BLOCK).select("t", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    large = materialize(large, "large-buckets")
    blocks = few_rows(large)
    part = F.coalesce("blocks", F.lit(1))
    entries = entries.join(blocks, ["t", "bucket"], "left").withColumn("block", F.pmod(F.xxhash64("key"), part).cast("int"))
    visits = visits.join(blocks, ["t", "bucket"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), part - 1)))
    names = ["t", "bucket", "block", "asks", "key", "vec", "ids"]
    both = entries.withColumn("asks", F.lit(False)).select(names).unionByName(visits.withColumns({"asks": F.lit(True), "ids": F.lit(None).cast("array<long>")}).select(names))
    both = both.repartition("t", "bucket", "block").sortWithinPartitions("t", "bucket", "block", "asks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's vectors come before its queries; BLOCK vectors (and a few more) are held at a time."""
        now, keys, ids, vecs, best = None, [], [], [], Best(k + 1)
        for batch in batches:
            where = list(zip(*(batch.column(c).to_pylist() for c in ("t", "bucket", "block", "asks")), strict=True))
            cuts = [0, *(i for i in range(1, len(where)) if where[i] != where[i - 1]), len(where)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if where[a][:3] != now:
                    now, keys, ids, vecs = where[a][:3], [], [], []
                piece = batch.slice(a, b - a)
                matrix = np.array([np.frombuffer(x, dtype) for x in piece.column("vec").to_pylist()])
                if not where[a][3]:
                    keys += piece.column("key").to_pylist()
                    ids += piece.column("ids").to_pylist()
                    vecs.append(matrix)
                elif vecs:
                    vecs = [np.concatenate(vecs)]
                    asked = piece.column("key").to_pylist()
                    for at in range(0, len(matrix), TOGETHER):
                        for q, v, far in zip(*(x.tolist() for x in nearest_of(matrix[at : at + TOGETHER], vecs[0], k + 1)), strict=True):
                            best.add(asked[at + q], far, keys[v], ids[v])
                    if len(best.held) > MOST_HELD:
                        best.trim()
                        if len(best.held) > MOST_HELD // 2:
                            yield best.batch()
        best.trim()
        yield best.batch()

    met = both.mapInArrow(meet, "key binary, found binary, ids array<long>, score double")
    merged = met.groupBy("key", "found").agg(F.first("score").alias("score"), F.first("ids").alias("ids"))
    best = merged.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("score", F.element_at("ids", 1), "found"))).where(F.col("r") <= k + 1)
    best = best.groupBy("key").agg(F.collect_list(F.struct("score", "ids")).alias("best"))  # k + 1 classes
    flat = F.flatten(F.transform("best", lambda c: F.transform(c["ids"], lambda i: F.struct(c["score"].alias("score"), i.alias("vec_id")))))
    own = queries.join(best, "key").select("key", "query_id", F.slice(F.array_sort(F.filter(flat, lambda c: c["vec_id"] != F.col("query_id"))), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("rank", "near")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "near.vec_id", "near.score")
