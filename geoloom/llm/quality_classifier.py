"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is a weighted sum of features of its text; P(a better than b) is the logistic function of the difference
of scores, and the weights maximise the likelihood of preference pairs (a document labelled good over one labelled bad).
The threshold is the quantile of the scores that cuts off the share of bad documents among the labelled ones.

Labels are a sample of at most SAMPLE_ROWS rows (those with the smallest hash of doc_id), which is all that the driver
sees; features of all documents are computed in the tasks, over whole texts.

Defined results: a null or empty text has the features of no words and gets a score too; equal texts get equal scores;
labels without a document, null labels and repeated labels do no harm; without labels of both kinds every score is 0.5;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import chunks, id_text, materialize
from geoloom.llm.textstats import FIELDS, stats

SAMPLE_ROWS = 20_000
PAIRS = 200_000
FEATURES = ("bias_words", "symbols", "marked", "shouted", "upper", "bars", "same", "repeat", "dup", "bang", "stop", "distinct", "length", "ended", "digits", "junk", "junk_seen")


def features(rows: np.ndarray) -> np.ndarray:
    """A row of features for each row of counts: shares of words, square roots so that small shares count, and their largest."""
    f = dict(zip(FIELDS, rows.astype(float).T, strict=True))
    words, lines, letters = (np.maximum(f[x], 1) for x in ("n_words", "n_lines", "n_letters"))
    root = lambda a, b: np.sqrt(np.minimum(a / b, 1))
    marked, shouted, bars, same = f["n_symbol_words"] / words, f["n_upper_words"] / words, f["n_loose_bars"] / words, f["n_same_next"] / words
    junk = np.maximum.reduce([marked, np.where(f["n_upper_words"] > 3, shouted, 0), bars, np.where(f["n_same_next"] > 4, same, 0)])
    out = [
        np.log1p(f["n_words"]) / 10, root(f["n_symbols"], words), np.sqrt(marked), np.sqrt(shouted), root(f["n_upper"], letters), np.sqrt(bars), np.sqrt(same), root(f["n_repeat_words"], words),
        root(f["n_dup_lines"], lines), root(f["n_bang"], words), root(f["n_stop"], words), f["n_distinct"] / words, np.minimum(f["word_chars"] / words, 20) / 10, f["n_ended"] / lines, root(f["n_digits"], words * 5), np.sqrt(junk), np.minimum(junk / 0.2, 1),
    ]
    return np.column_stack(out)


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the features x of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            x = features(np.array([stats(t) for t in texts], np.int64).reshape(len(texts), len(FIELDS))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "text_hash", "x"])

    return id_text(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, x array<float>")


def fit_bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 25, seed: int = 7) -> np.ndarray:
    """Weights by Newton's method on the logistic loss of feature differences, with an L2 penalty."""
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    d = good[rng.integers(len(good), size=n)] - bad[rng.integers(len(bad), size=n)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        gradient = -(d * p[:, None]).mean(0) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, sample_rows: int = SAMPLE_ROWS, key: bool = False) -> DataFrame:
    """doc_id, score (0 to 1) and predicted for each document; with key also text_hash, xxhash64 of the text.

    usable: which documents' labels may be learnt from.
    """
    names = ["doc_id", *["text_hash"] * key]
    table = materialize(document_features(docs), "quality-features")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1)).groupBy("doc_id").agg(F.max("_y").alias("_y"))
    seen = table.where(usable if usable is not None else F.lit(True)).join(marked, "doc_id")
    rows = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("x", "_y").collect()
    y = np.array([r[1] for r in rows], int)
    x = np.array([r[0] for r in rows], float).reshape(len(rows), len(FEATURES))
    if not (y == 0).any() or not (y == 1).any():
        return table.select(*names, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    w = fit_bradley_terry(x[y == 1], x[y == 0])
    s = x @ w
    low, high = np.quantile(s, [max(0, (y == 0).mean() - 0.5 / len(y)), min(1, (y == 0).mean() + 0.5 / len(y))], method="nearest")
    middle = (low + high) / 2
    total = sum((F.get("x", F.lit(k)).cast("double") * float(v) for k, v in enumerate(w)), F.lit(-float(middle)))
    return table.select(*names, (1 / (1 + F.exp(-total))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
