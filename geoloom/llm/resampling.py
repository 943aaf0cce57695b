"""Target-distribution importance resampling over hashed n-grams, found by word-id suffix arrays inside tasks.

A task numbers the words of CHUNK_BYTES of text, sorts the suffixes of its documents (prefix doubling, as deep as the longest
n-gram) and compares neighbours: a run of suffixes whose common prefix has n words or more is one n-gram with all its occurrences.
Each run is hashed once and its bucket goes back to the run's occurrences. The buckets of each document are written, so texts are
read once; from them come the counts of raw and target features, each bucket's gain, and each document's weight. The drawn
documents have the highest sums of weight and Gumbel noise, which is drawing without replacement in proportion to exp(weight).

Ranks come from a sort by range: a row's place in its partition plus the rows of the partitions before it, so no task holds all.

Cases: a null or blank text has no features, weight 0 and is never drawn unless `least_words` is 0; a null doc_id draws its noise
from the empty string and follows the other ids in ties; repeated rows are ranked one after the other; empty tables give no rows, or gains without a target (t = T = 0);
other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import chunks, id_text, ids_of, materialize

#: Bytes to words: A-Z lower-cased, and every byte that is no digit, letter or part of a longer character becomes a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def suffix_runs(ids: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `longest` words at least, and each one's common prefix with the one before it.

    left: words from each place to the end of its document, which no suffix passes. Common prefixes are counted up to `longest`.
    """
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < longest:
        ahead = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > depth)
        ahead[inside] = rank[inside + depth] + 1
        rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        depth *= 2
    order = np.argsort(rank, kind="stable")
    common, same = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    a, b = order[:-1], order[1:]
    for k in range(longest):
        same = same & (left[a] > k) & (left[b] > k)
        same[same] = ids[a[same] + k] == ids[b[same] + k]
        common[1:] += same
    return order, common


def buckets_of(texts: list[bytes], shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, n-grams of each text, and the n-grams' buckets, text after text."""
    split = [t.translate(WORD_BYTES).split() for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    words = [w for ws in split for w in ws]
    ids = ids_of(words)
    ends = np.repeat(np.cumsum(n_words), n_words)
    left = ends - np.arange(len(words))
    of_text = np.repeat(np.arange(len(texts)), n_words)
    order, common = suffix_runs(ids, left, longest)
    texts_of, found = [], []
    for n in range(shortest, longest + 1):
        whole = left[order] >= n
        head = whole & (common < n)
        hashed = np.array([zlib.crc32(b" ".join(words[i : i + n])) % buckets for i in order[head].tolist()], np.int64)
        run = np.cumsum(head) - 1
        texts_of.append(of_text[order[whole]])
        found.append(hashed[run[whole]])
    texts_of, found = np.concatenate(texts_of), np.concatenate(found)
    return n_words, np.bincount(texts_of, minlength=len(texts)), found[np.argsort(texts_of, kind="stable")]


def occurrences(docs: DataFrame, shortest: int, longest: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features and the buckets of a document's n-grams as bytes (unsigned, 2 or 4 each)."""
    width = bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in chunks(batches):
            n_words, sizes, found = buckets_of(texts, shortest, longest, buckets)
            data, at = found.astype(width).tobytes(), np.concatenate([[0], np.cumsum(sizes)]) * np.dtype(width).itemsize
            cut = pa.array([data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n_words), pa.array(sizes.astype(np.int64)), cut], names=["doc_id", "n_words", "n_features", "buckets"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def counts_of(found: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket; tasks send one row for each bucket, and the driver gets one for each."""
    width = bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column("buckets").to_pylist():
                total += np.bincount(np.frombuffer(b, width), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    s, t = raw.astype(float), target.astype(float)
    b = float(len(raw))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, shortest: int = 1, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those that aren't drawn.

    Of the N documents with least_words words or more, floor(percent * N / 100) are drawn.
    """
    found = materialize(occurrences(id_text(docs, id_col, text_col), shortest, longest, buckets), "features")
    wanted = occurrences(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), shortest, longest, buckets)
    gains, width = gains_of(counts_of(found, buckets), counts_of(wanted, buckets)), bucket_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gains[np.frombuffer(b, width)].sum()) for b in batch.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long").cast("double") + 0.5) / 4294967296.0
    weighed = weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))))
    weighed = weighed.withColumn("fits", F.col("n_words") >= least_words)
    # the last key only tells equal rows apart, so that many of them are spread over partitions
    keys = [F.desc("fits"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.col("row")]
    ordered = weighed.withColumn("row", F.monotonically_increasing_id()).orderBy(*keys).withColumn("at", F.monotonically_increasing_id())
    ordered = materialize(ordered.drop("row"), "ordered")
    part = F.shiftright("at", 33)
    sizes = {r["part"]: (r["n"], r["fit"]) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("fits").alias("fit")).collect()}  # a row for each partition
    amount = percent * sum(fit for _, fit in sizes.values()) // 100
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p][0]
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "part long, before long"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    out = ordered.withColumn("part", part).join(starts, "part").withColumn("place", place)
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("fits") & (F.col("place") <= amount), F.col("place")).alias("rank"))


#: crc32 of a word's bytes, and of each n-gram here a word, by the usual reflected table; all else is plain SQL.
SQL = r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS l FROM steps WHERE k = 8),
cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
raw AS (SELECT doc_id, unnest(words) AS w FROM cut),
aim AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
bytes AS (SELECT w, list_transform(range(0, CAST(length(hex(encode(w))) // 2 AS BIGINT)), lambda k: CAST('0x' || substr(hex(encode(w)), 2 * k + 1, 2) AS BIGINT)) AS b FROM (SELECT w FROM raw UNION SELECT w FROM aim)),
hashed AS (SELECT w, xor(list_reduce(b, lambda c, x: xor(c // 256, l[xor(c % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
s AS (SELECT bucket, count(*) AS n FROM raw JOIN hashed USING (w) GROUP BY ALL), t AS (SELECT bucket, count(*) AS n FROM aim JOIN hashed USING (w) GROUP BY ALL),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM raw) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM aim) + 10000)::DOUBLE))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket)),
weight AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM raw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT cut.doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || cut.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM cut LEFT JOIN weight ON cut.doc_id = weight.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""
