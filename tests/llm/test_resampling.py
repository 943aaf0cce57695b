"""Importance resampling against a plain count of n-grams, over the whole table and over awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import queries, resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, shortest, longest, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=10, shortest=1, longest=1, buckets=10_000, least=20):
    found = [(i, *grams(t, shortest, longest, buckets)) for i, t in docs]
    s, t = Counter(b for _, _, bs in found for b in bs), Counter(b for x in target for b in grams(x, shortest, longest, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, n, bs in found:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, bs))
        rows.append([i, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted([(r[0], *r[2:], rank.get(id(r))) for r in rows], key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()], key=str)


def test_whole_table(spark):
    docs = [tuple(r) for r in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False)]
    target = pd.read_parquet(f"{SF}/benchmark.parquet")["text"].tolist()
    assert rows_of(queries.op12_importance_resampling(spark, SF)) == plain(docs, target)


@pytest.mark.parametrize(("shortest", "longest"), [(1, 2), (2, 5), (3, 3)])
def test_longer_ngrams(spark, shortest, longest):
    docs = [tuple(r) for r in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False)]
    target = pd.read_parquet(f"{SF}/benchmark.parquet")["text"].tolist()
    a, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert rows_of(resampling.resample(a, b, 30, shortest, longest, 100_000)) == plain(docs, target, 30, shortest, longest, 100_000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é.", max_size=30), max_size=6), st.integers(1, 4), st.integers(0, 3))
def test_runs_of_equal_suffixes(texts, shortest, more):
    n_words, sizes, found = resampling.buckets_of([t.encode() for t in texts], shortest, shortest + more, 997)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for k, t in enumerate(texts):
        n, want = grams(t, shortest, shortest + more, 997)
        assert n_words[k] == n and sorted(found[at[k] : at[k + 1]].tolist()) == sorted(want)


def test_suffix_order_and_common_prefixes():
    ids, left = np.array([1, 2, 1, 2, 1, 3, 1, 2]), np.array([5, 4, 3, 2, 1, 3, 2, 1])
    order, common = resampling.suffix_runs(ids, left, 3)
    suffix = [tuple(ids[i : i + min(left[i], 3)]) for i in order]
    assert suffix == sorted(suffix)
    for k in range(1, len(order)):
        a, b = suffix[k - 1], suffix[k]
        assert common[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


AWKWARD = [(1, "one two " * 15, "x", 1), (1, "one two " * 15, "x", 1), (2, None, "x", 1), (3, "", None, 2), (4, " .,; ", "y", 3), (None, "one Two é " * 12, "y", 3), (5, "word " * 300_000, "y", 3), (6, "one two " * 15, "z", 9), (7, "short", "z", 9), (8, "\x00Ünï\tcode " * 20, "z", 9)]
SCHEMA = "doc_id long, text string, buckets string, rank long"


def test_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    target = spark.createDataFrame([("ONE two", 5), (None, 6)], "text string, weight long")
    for percent in (0, 50, 100):
        assert rows_of(resampling.resample(df, target, percent)) == plain([r[:2] for r in AWKWARD], ["ONE two", None], percent)
    assert rows_of(resampling.resample(df, target.limit(0), 50)) == plain([r[:2] for r in AWKWARD], [], 50)
    assert resampling.resample(df.limit(0), target).count() == 0


def test_ranks_over_many_partitions(spark):
    rows = [(i, f"w{i % 7} " * (20 + i % 3), None, None) for i in range(500)] + [(3, "w3 " * 20, None, None)] * 200
    df = spark.createDataFrame(rows, SCHEMA).repartition(11)
    target = spark.createDataFrame([("w3 w4",)], "text string")
    got, want = rows_of(resampling.resample(df, target, 60)), plain([r[:2] for r in rows], ["w3 w4"], 60)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 421)) and [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted((r[0], r[4]) for r in got if r[4]) == sorted((r[0], r[4]) for r in want if r[4])
