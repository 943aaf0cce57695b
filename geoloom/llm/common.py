"""Small helpers that the text operators share: reading tables, cutting lineage, and words of UTF-8 texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import materialize as materialize

#: Bytes of text that an operator looks at together inside a task.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, so that no other column can clash with names used inside an operator."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the record batches with about CHUNK_BYTES of text each, and their texts' bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = batch.slice(a, b - a)
            yield piece, utf8(piece.column(column))


class Memo(dict):
    """word -> f(word), emptied between texts once it holds `most` entries, so that its memory is bounded."""

    def __init__(self, f, most: int = 300_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, word):
        out = self[word] = self.f(word)
        return out

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


#: Bytes 0x20 and 0x09 to 0x0D; bytes.split() without arguments cuts at just these.
BLANK = re.compile(rb"[\x20\x09-\x0d]+")


def ids_of(words: list[bytes]) -> np.ndarray:
    """An integer for each word, equal for equal words: the place of its first occurrence."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, range(len(words))), np.int64, len(words))


def window_ids(ids: np.ndarray, width: int) -> np.ndarray:
    """An integer for each run of `width` ids, equal for equal runs."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out, top = ids[:n], len(ids)
    for k in range(1, width):
        if int(out.max(initial=0)) >= (1 << 62) // max(top, 1):
            out = np.unique(out, return_inverse=True)[1]
        out = out * top + ids[k : k + n]
    return out


def n_repeat_words(ids: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    keys = window_ids(ids, width)
    if len(keys) < 2:
        return 0
    _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice = count[at] >= 2
    hit = np.zeros(len(ids), bool)
    for k in range(width):
        hit[k : k + len(keys)] |= twice
    return int(hit.sum())
