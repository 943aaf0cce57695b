"""Packing of tokenised documents into windows of equal length by non-negative least squares.

Documents are tokenised inside the tasks and cut into full windows and one rest. Everything that follows works on the
histogram of the rests' lengths, which has at most `window` bins at any size of the corpus: shallow combinations of
lengths that fill a window (up to three different lengths, the first one repeated) are the columns of a matrix, repeat
counts that reproduce the histogram are solved with x >= 0, rounded down and kept within what is there, and what is left is
packed greedily, longest first. The plan then says, for the r-th piece of a length, its sequence and offset; ranks of
pieces of one length have two levels (salt, row in a salt), so that a hot length doesn't meet in one task.

Defined results: a null or empty text is the one id that ends a document; repeated rows are separate documents; a text of
any length is cut into pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import importlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.common import chunks, id_text, materialize

WINDOW = 4096
END_ID = 2
SALTS = 128
#: Words whose ids one Python worker remembers.
MEMO_WORDS = 1_000_000
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    return importlib.import_module("public_tokenizers").path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The tokenizer drops white space and lower-cases, and no token crosses white space, so a text's ids are those of its
    blank-separated parts, which are remembered in two generations: when the young one is full, it becomes the old one.
    Texts with a special token's opening go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young, self.old = {}, {}
        ends = [i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")]
        self.ends = np.zeros(max(ends) + 1, bool)
        self.ends[ends] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def whole(self, text: bytes) -> bytes:
        return self.ids(text.decode("utf-8", "replace")).tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Remember the ids of all these parts."""
        young, old = self.young, self.old
        bare, ended, rest = {}, [], []
        for w in words:
            if w in old:
                young[w] = old[w]
                continue
            head = w[:-1] if w[-1] in b".," else w
            if head.isalpha() or (head and not head.isascii() and (t := head.decode("utf-8", "replace")).isalpha()):
                if head is not w:
                    ended.append(w)
                if head not in young and head not in old:
                    bare[head] = None
            else:
                rest.append(w)
        heads = list(bare)
        for k in range(0, len(heads), 4096):  # letters alone are one word to the tokenizer, so many can go at once
            some = heads[k : k + 4096]
            ids = self.ids(b" ".join(some).decode("utf-8", "replace"))
            stops = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if len(stops) == len(some):
                data, a = ids.tobytes(), 0
                for w, b in zip(some, (4 * stops).tolist(), strict=True):
                    young[w], a = data[a:b], b
            else:
                rest += some
        for w in rest:
            young[w] = self.whole(w)
        for w in ended:
            tail = w[-1:]
            if tail not in young:
                young[tail] = self.whole(tail)
            young[w] = (young.get(w[:-1]) or old.get(w[:-1]) or self.whole(w[:-1])) + young[tail]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        known = self.young.get
        got = [None if b"<|" in x else list(map(known, x.lower().split())) for x in texts]
        gaps = {}
        for k, ids in enumerate(got):
            if ids is not None and None in ids:
                words = texts[k].lower().split()
                gaps[k] = [(i, words[i]) for i, x in enumerate(ids) if x is None]
        if gaps:
            self.learn({w for gap in gaps.values() for _, w in gap})
            for k, gap in gaps.items():
                ids = got[k]
                for i, w in gap:
                    ids[i] = self.young[w]
        out = [self.whole(x) if ids is None else b"".join(ids) for x, ids in zip(texts, got, strict=True)]
        if len(self.young) > MEMO_WORDS // 2:
            self.young, self.old = {}, self.young
        return out


def encoder(path: str) -> Encoder:
    """One for each Python worker, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """A row for each piece: full windows from the start, then the rest."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for part, texts in chunks(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                for a in range(0, n, window):
                    piece = ids[4 * a : 4 * (a + window)]
                    for column, v in zip(out, (doc_id, a, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], schema=PIECES)

    return id_text(docs).mapInArrow(run, PIECES_DDL)


def combinations(have: dict[int, int], window: int, partners: int = 12) -> list[tuple[tuple[int, int], ...]]:
    """Shallow fills of a window: ((length, times), ...) with one, two or three different lengths and no padding."""
    lengths = sorted(have)
    common = sorted(lengths, key=lambda x: -have[x])[:partners]
    found = set()
    for a in lengths:
        times = {1, window // a, max(1, window // a - 1), max(1, window // (2 * a))}
        for m in times:
            rest = window - m * a
            if rest == 0:
                found.add(((a, m),))
            elif rest > 0:
                if rest in have:
                    found.add(tuple(sorted((Counter({a: m}) + Counter([rest])).items(), reverse=True)))
                for b in common:
                    c = rest - b
                    if c > 0 and c in have:
                        found.add(tuple(sorted((Counter({a: m}) + Counter([b, c])).items(), reverse=True)))
    return sorted(found)


def nnls(columns: list[tuple[tuple[int, int], ...]], have: dict[int, int], steps: int = 300) -> np.ndarray:
    """x >= 0 that brings sum(x * columns) close to the histogram: projected gradient with momentum, columns scaled."""
    if not columns:
        return np.empty(0)
    lengths = sorted(have)
    at = {x: k for k, x in enumerate(lengths)}
    row = np.array([at[length] for c in columns for length, _ in c])
    col = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    val = np.array([m for c in columns for _, m in c], float)
    want = np.array([have[x] for x in lengths], float)
    scale = 1 / np.sqrt(np.bincount(col, val * val, len(columns)))
    val = val * scale[col]

    def forward(x):
        return np.bincount(row, val * x[col], len(lengths))

    def back(r):
        return np.bincount(col, val * r[row], len(columns))

    probe = np.ones(len(columns))
    for _ in range(20):
        probe = back(forward(probe))
        step = np.linalg.norm(probe)
        probe /= step
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - want) / (1.05 * step))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    return x * scale


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, times a sequence, first sequence, offset): each rank of a length in one of them."""
    left = Counter({k: v for k, v in histogram.items() if v})
    patterns: list[tuple[list[tuple[int, int]], int]] = []
    if left[window]:
        patterns.append(([(window, 1)], left.pop(window)))
    columns = combinations(left, window)
    solved = nnls(columns, left)
    for k in np.argsort(-solved, kind="stable"):
        repeats = min([int(solved[k]), *(left[length] // m for length, m in columns[k])])
        if repeats:
            patterns.append((list(columns[k]), repeats))
            for length, m in columns[k]:
                left[length] -= m * repeats
    lengths = sorted(x for x in left if left[x])
    while lengths:  # every pattern uses up a length, so there are at most as many as lengths
        items, room, top = [], window, len(lengths)
        while top and (top := bisect.bisect_right(lengths, room, 0, top)):
            length = lengths[top - 1]
            m = min(left[length], room // length)
            items.append((length, m))
            room -= m * length
            top -= 1
        repeats = min(left[length] // m for length, m in items)
        patterns.append((items, repeats))
        for length, m in items:
            left[length] -= m * repeats
        lengths = [x for x in lengths if left[x]]
    rows, used, sequence = [], Counter(), 0
    for items, repeats in patterns:
        offset = 0
        for length, m in items:
            rows.append((length, used[length], m * repeats, m, sequence, offset))
            used[length] += m * repeats
            offset += m * length
        sequence += repeats
    return sorted(rows)


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """A row for each piece: where it is cut and in which sequence, at which offset it lies."""
    pieces = materialize(cut_pieces(docs, tokenizer_path or default_tokenizer(), window).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int")), "pack-pieces")
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `window` rows
    rows = np.array(plan(histogram, window) or np.empty((0, 6)), np.int64).reshape(-1, 6)
    keys = (rows[:, 0] << 44) + rows[:, 1]

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("k", F.row_number().over(inside)).join(firsts, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("k") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
            r = rows[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            k = rank - r[:, 1]
            more = [pa.array(r[:, 4] + k // r[:, 3]), pa.array(r[:, 5] + k % r[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in PIECES.names), *more], names=[*PIECES.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES_DDL + ", sequence_id long, offset long")
