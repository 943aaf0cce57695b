"""Vectors of a table as matrices inside tasks: which rows take part, and their numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that a task looks at together.
CHUNK_NUMBERS = 1 << 18


def vector_rows(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows whose vector has the most frequent length (the larger one of two), and that length.

    Arrays of floats stay floats, others become doubles; no other column can clash. Null and empty vectors go. The length is 0
    where no vector is left.
    """
    kind = "array<float>" if table.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v"))
    lengths = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return rows.where(F.size("v") == max(d, 1)), d


def matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the record batches and their vectors, a row each; null entries are NaN."""
    step = max(1, CHUNK_NUMBERS // max(d, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            yield piece, piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
