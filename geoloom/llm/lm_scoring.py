"""Language-model scoring with Brown-style class n-grams.

Texts are lower-cased (A-Z). Words are counted over the whole training part. Exchange clustering works on the bigram counts, again
over the whole training part, of the most frequent words and, for all others, of units by shape (letters, closing mark, ending):
each unit moves to the class that raises the mutual information of adjacent classes most, until nothing moves. Then every
other word of the training part, however rare, leaves its shape for the class that the same measure prefers by the word's own
counts of neighbouring classes, to which the neighbours of its shape are added with the weight of PRIOR tokens. Only words unseen in
training keep their shape's class. Texts become sequences of classes; class transitions are counted over those of the training
part. A text's probability is the product of class transitions P(class | class before) and emissions P(word | class), both smoothed
by adding one. The same counts give the base score, an add-one unigram model.

Each text is split into words once; the ids of its words are written, and all later passes count from these.

Classes and counts of the HEAD most frequent words and of the HELD_HEAD most frequent words outside the training part (fixed
numbers) travel with the tasks; each distinct other word of a document meets its class in a join by word, so nothing that grows
with the vocabulary is broadcast, and no word of the join is hot.

Defined results: a null or blank text is the single token that ends a text; a null doc_id is in the training part; repeated
rows count and are scored as separate documents; words unknown in training have count 0; ties of classes go to the lower class;
without training documents every count is 0; a text of any length is one sequence, in one task; an empty table gives an empty
result; other columns are ignored. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import Memo, chunks, crc_remainder, id_text, materialize
from geoloom.session import discard

#: Frequent words whose counts travel with the tasks: 16 bytes each.
HEAD = 262_144
#: Frequent words outside the training part whose counts travel too.
HELD_HEAD = 65_536
#: Frequent words, the end token among them, that found the classes, with the shapes; all other words join a class by their neighbours.
UNITS = 512
SHAPES = 64
CLASSES = 32
#: How many tokens of its shape a word's own neighbours are weighed against.
PRIOR = 1.0
#: Words of which one task decides the classes, about; below that Spark's number of partitions decides.
TASK_WORDS = 1_000_000
#: Marks a word outside the head in a sequence of classes.
LATER = 255
#: Words that a task remembers before it starts afresh.
MEMO_WORDS = 400_000
#: Tokens that a task looks at together.
BLOCK = 1 << 18
#: The same where a task counts words.
COUNTED_WORDS = 1 << 21
#: The same where a task counts the neighbours of each word; slices of at most half of 1 << COUNT_BITS are packed.
NEIGHBOUR_WORDS = 1 << 20
#: Bits of a count beside its slot in 32 bits.
COUNT_BITS = 22
MARKS = b".,;:!?)]}\"'"


def shape(word: bytes) -> int:
    """0 to SHAPES - 1 from letters beyond ASCII, a closing mark, and the two bytes before it."""
    bare = word.rstrip(MARKS)
    return ((not bare.isascii()) * 2 + (len(bare) < len(word))) * 16 + xxhash.xxh32_intdigest(bare[-2:]) % 16


def word_id(word: bytes) -> int:
    """A signed 64-bit hash whose last six bits are the word's shape."""
    h = xxhash.xxh3_64_intdigest(word) & ~(SHAPES - 1) | shape(word)
    return h - (1 << 64) if h >> 63 else h


END = word_id(b"")


def hash_words(docs: DataFrame) -> DataFrame:
    """doc_id, train, words: the ids of a text's words and of the end token, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Memo(word_id, MEMO_WORDS)
        for rows, texts in chunks(batches):
            out = []
            for text in texts:
                ids.trim()
                words = text.lower().split()  # bytes.lower() changes A-Z only
                words.append(b"")
                out.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("train"), pa.array(out, pa.binary())], names=["doc_id", "train", "words"])

    return docs.mapInArrow(run, "doc_id long, train boolean, words binary")


def packed(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that binary values without nulls hold, one after another, and the place after each value's end."""
    column = column.cast(pa.binary())
    _, cuts, data = column.buffers()
    size = np.dtype(kind).itemsize
    cuts = np.frombuffer(cuts, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    return np.frombuffer(data, kind, int(cuts[-1] - cuts[0]) // size, int(cuts[0])), (cuts[1:] - cuts[0]) // size


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the record batches with about `most` word ids each, these ids, and the place after each text's end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, stops = packed(batch.column("words"), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff((stops - 1) // most)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            start = stops[a - 1] if a else 0
            yield batch.slice(a, b - a), ids[start : stops[b - 1]], stops[a:b] - start


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    """Word ids of whole texts, at most `most` and one text together. Every text ends with the end token, so texts can be chained."""
    waiting, n = [], 0
    for _, ids, _ in pieces(batches, most):
        if n and n + len(ids) > most:
            yield np.concatenate(waiting)
            waiting, n = [], 0
        waiting.append(ids)
        n += len(ids)
    if waiting:
        yield np.concatenate(waiting)


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and the place of each id among them."""
    coded = pa.array(ids).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def find(sorted_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place of each id in sorted_ids, or -1."""
    if not len(sorted_ids):
        return np.full(len(ids), -1)
    at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
    return np.where(sorted_ids[at] == ids, at, -1)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in blocks(batches, COUNTED_WORDS):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(ids, return_counts=True)], names=["word", "c"])

    return texts.select("words").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def unit_of(units: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The place of each id among the frequent words (sorted), or len(units) + shape."""
    at = find(units, ids)
    return np.where(at >= 0, at, len(units) + (ids & (SHAPES - 1))).astype(np.int64)


def count_bigrams(texts: DataFrame, units: np.ndarray) -> DataFrame:
    """(a, b, n): adjacent units over all texts; a text's first word follows the end token."""
    size = len(units) + SHAPES
    end = int(unit_of(units, np.array([END], np.int64))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for ids in blocks(batches, BLOCK):
            unit = unit_of(units, ids)
            total += np.bincount(np.concatenate([[end], unit[:-1]]) * size + unit, minlength=size * size)
        keep = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((keep // size).astype(np.int32)), pa.array((keep % size).astype(np.int32)), pa.array(total[keep])], names=["a", "b", "n"])

    return texts.select("words").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 12) -> np.ndarray:
    """The class of each unit: from classes by rank of frequency, each unit goes where mutual information is largest."""
    n = len(bigrams)
    counts = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-counts, kind="stable")
    k = min(classes, n)
    cls = np.empty(n, int)
    cls[order] = np.arange(n) % k
    one = np.zeros((n, k))
    one[np.arange(n), cls] = 1
    table = one.T @ bigrams @ one
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not counts[u]:
                continue
            old, own = cls[u], bigrams[u, u]
            after, before = bigrams[u] @ one, bigrams[:, u] @ one
            after[old] -= own
            before[old] -= own
            table[old] -= after
            table[:, old] -= before
            table[old, old] -= own
            left, right = table.sum(1) + before, table.sum(0) + after  # marginals once u is placed, but for its own class
            rows = xlogx(table + after).sum(1) - xlogx(table).sum(1)
            cols = xlogx(table.T + before).sum(1) - xlogx(table.T).sum(1)
            diagonal = np.diag(table)
            a, b = np.diag(table + after), np.diag(table.T + before)
            corner = xlogx(diagonal + after + before + own) + xlogx(diagonal) - xlogx(a) - xlogx(b)
            gain = rows + cols + corner
            gain -= xlogx(left + after.sum() + own) - xlogx(left) + xlogx(right + before.sum() + own) - xlogx(right)
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else old
            moved += new != old
            one[u, old], one[u, new], cls[u] = 0, 1, new
            table[new] += after
            table[:, new] += before
            table[new, new] += own
        if not moved:
            break
    return cls


def count_neighbours(texts: DataFrame, units: np.ndarray, cls: np.ndarray, classes: int) -> DataFrame:
    """(word, near) for all words but units. near: 32-bit numbers, each a slot and, in its lower COUNT_BITS bits, how often it was
    met, where slots below classes are the classes before the word and the others those after it.

    Counts are summed inside a block of texts; a word comes from each block once.
    """
    end = int(cls[unit_of(units, np.array([END], np.int64))[0]])
    width = 2 * classes
    new = lambda x: np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))  # noqa: E731  (where a sorted row of numbers changes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in blocks(batches, NEIGHBOUR_WORDS):
            word, index = distinct(ids)
            c, mine = cls[unit_of(units, word)].astype(np.int32)[index], (find(units, word) < 0)[index]
            before, after = np.roll(c, 1), np.roll(c, -1)
            before[0] = after[-1] = end
            every = np.flatnonzero(mine)  # the end token is a unit, so a word's neighbours are of its own text
            for a in range(0, len(every), 1 << (COUNT_BITS - 1)):
                at = every[a : a + (1 << (COUNT_BITS - 1))]
                base = index[at] * np.int64(width)
                keys = np.concatenate([base + before[at], base + (classes + after[at])])
                keys.sort()
                first = new(keys)
                row, slot = np.divmod(keys[first], width)
                pairs = (slot << COUNT_BITS | np.diff(first, append=len(keys))).astype(np.uint32)
                starts = new(row)
                cuts = (np.append(starts, len(row)) * pairs.itemsize).astype(np.int32)
                near = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(pairs)])
                yield pa.RecordBatch.from_arrays([pa.array(word[row[starts]]), near], names=["word", "near"])

    return texts.select("words").mapInArrow(run, "word long, near binary")


def assign_classes(neighbours: DataFrame, gain: np.ndarray, prior: np.ndarray, parts: int) -> DataFrame:
    """(word, c, cls): the class with the largest gain for each word. gain: of one neighbour, slots by classes; prior: shapes by classes."""
    width, classes = gain.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(word, met):
            value = np.round(met @ gain + prior[word & (SHAPES - 1)], 9)  # so that equal sums are equal
            c = met[:, :classes].sum(1).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(c), pa.array(np.argmax(value, 1).astype(np.int32))], names=["word", "c", "cls"])

        last = None  # the word at the end of a batch, which may go on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column("word").to_numpy()
            pairs, stops = packed(batch.column("near"), np.uint32)
            change = np.concatenate([[False], word[1:] != word[:-1]])
            row = np.repeat(np.cumsum(change), np.diff(stops, prepend=0))
            word = np.concatenate([word[:1], word[change]])
            at = row * width + (pairs >> COUNT_BITS)
            met = np.bincount(at, pairs & ((1 << COUNT_BITS) - 1), len(word) * width).reshape(-1, width)  # whole numbers
            if last is not None:
                if last[0][0] == word[0]:
                    met[0] += last[1][0]
                else:
                    yield out(*last)
            if len(word) > 1:
                yield out(word[:-1], met[:-1])
            last = word[-1:], met[-1:].copy()
        if last is not None:
            yield out(*last)

    by_word = neighbours.repartition(parts, "word") if parts else neighbours.repartition("word")
    return by_word.sortWithinPartitions("word").mapInArrow(run, "word long, c long, cls int")


def encode(texts: DataFrame, head: np.ndarray, times: np.ndarray, head_cls: np.ndarray) -> DataFrame:
    """doc_id, train, n_tokens, head_known, head_log, the sequence of classes (LATER for words outside the head), those
    words once each (tail), and which of them stands at each LATER (places).
    """
    logs = np.log10(times + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, stops in pieces(batches, BLOCK):
            word, index = distinct(ids)
            at = find(head, word)
            pick = lambda x, other: (np.where(at >= 0, x[at], other) if len(head) else np.full(len(word), other))[index]  # noqa: E731, B023
            c, seen, log = pick(head_cls, LATER).astype(np.uint8), pick(times, 0) > 0, pick(logs, 0.0)
            starts = np.concatenate([[0], stops[:-1]])
            sums = [np.add.reduceat(x, starts) for x in (seen.astype(np.int64), log)]
            seq, tail, places = [], [], []
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                late, place = np.unique(ids[a:b][c[a:b] == LATER], return_inverse=True)
                seq.append(c[a:b].tobytes())
                tail.append(late)
                places.append(place.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("train"), pa.array(stops - starts), *map(pa.array, sums), pa.array(seq, pa.binary()), pa.array(tail, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                names=["doc_id", "train", "n_tokens", "head_known", "head_log", "seq", "tail", "places"],
            )

    return texts.mapInArrow(run, "doc_id long, train boolean, n_tokens long, head_known long, head_log double, seq binary, tail array<long>, places array<int>")


def sequences(rows: DataFrame, classes: DataFrame, of_shape: list[int]) -> DataFrame:
    """doc_id, train, n_tokens, n_known, logs and the whole sequence of classes of each encoded row."""
    each = rows.select("row", F.posexplode("tail").alias("i", "word")).join(classes, "word", "left")
    shape_cls = F.element_at(F.lit(of_shape), (F.col("word").bitwiseAND(SHAPES - 1) + 1).cast("int"))
    met = each.select("row", F.struct("i", F.coalesce("cls", shape_cls).alias("cls"), F.coalesce("c", F.lit(0)).alias("c")).alias("t")).groupBy("row").agg(F.array_sort(F.collect_list("t")).alias("t"))
    joined = rows.drop("tail").join(met, "row", "left").select("doc_id", "train", "n_tokens", "head_known", "head_log", "seq", "places", F.col("t.cls").alias("cls"), F.col("t.c").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, n, logs = [], [], []
            for seq, places, cls, c in zip(*(batch.column(x) for x in ("seq", "places", "cls", "c")), strict=True):
                s = np.frombuffer(seq.as_py(), np.uint8)
                if cls.is_valid:
                    at, c = places.values.to_numpy(), c.values.to_numpy()
                    s = s.copy()
                    s[s == LATER] = cls.values.to_numpy()[at]
                    n.append(int((c[at] > 0).sum()))
                    logs.append(float(np.log10(c[at] + 1.0).sum()))
                else:
                    n.append(0)
                    logs.append(0.0)
                seqs.append(s.tobytes())
            n_known = batch.column("head_known").to_numpy() + np.array(n, np.int64)
            total = batch.column("head_log").to_numpy() + np.array(logs)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "train", "n_tokens")), pa.array(n_known), pa.array(total), pa.array(seqs, pa.binary())], names=["doc_id", "train", "n_tokens", "n_known", "logs", "seq"])

    return joined.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, logs double, seq binary")


def chained(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class before each token, its own class, and where each sequence starts; every sequence has its end token."""
    seqs = batch.column("seq").to_pylist()
    c = np.frombuffer(b"".join(seqs), np.uint8).astype(np.int64)
    starts = np.cumsum([0, *map(len, seqs[:-1])])
    before = np.concatenate([[end], c[:-1]])
    before[starts] = end
    return before, c, starts


def count_transitions(seqs: DataFrame, classes: int, end: int) -> np.ndarray:
    """Counts of adjacent classes over all sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            if batch.num_rows:
                before, c, _ = chained(batch, end)
                total += np.bincount(before * classes + c, minlength=classes * classes)
        keep = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array(total[keep])], names=["pair", "n"])

    grams = seqs.select("seq").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most classes ** 2 rows
    table = np.zeros(classes * classes)
    table[grams.column("pair").to_numpy()] = grams.column("n").to_numpy()
    return table.reshape(classes, classes)


def class_tables(part: DataFrame, units: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The class of each unit, the gains of one neighbour (slots by classes), the prior of each shape, and the number of classes."""
    size = len(units) + SHAPES
    grams = count_bigrams(part, units).toArrow()  # at most (UNITS + SHAPES) ** 2 rows
    bigrams = np.zeros((size, size))
    bigrams[grams.column("a").to_numpy(), grams.column("b").to_numpy()] = grams.column("n").to_numpy()
    cls = exchange(bigrams, classes)
    k = int(cls.max()) + 1
    one = np.zeros((size, k))
    one[np.arange(size), cls] = 1
    table = one.T @ bigrams @ one + 1
    # mutual information that a word adds to a class: log P(class, neighbour) / P(class) for one side, over P(class) once more for the emission
    forward = np.log(table / table.sum(1, keepdims=True)) - np.log(table.sum(0) / table.sum())
    backward = np.log(table / table.sum(1, keepdims=True))
    gain = np.concatenate([forward, backward.T])
    shapes = slice(len(units), size)
    near = np.concatenate([one.T @ bigrams[:, shapes], (bigrams[shapes] @ one).T]).T  # shapes by slots
    often = np.maximum(near[:, :k].sum(1, keepdims=True), 1)
    return cls, gain, PRIOR * (near / often) @ gain, k


def score(docs: DataFrame, training: Column | None = None, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity for each row of docs.

    training: which rows the model learns from; by default those whose crc32(doc_id as text) mod 7 is not 2.
    """
    docs = id_text(docs)
    docs = docs.withColumn("train", F.coalesce(training if training is not None else crc_remainder(F.col("doc_id"), 7) != 2, F.lit(False)))
    texts = materialize(hash_words(docs), "lm-words")
    part = texts.where("train")
    most = lambda df, n: df.orderBy(F.desc("c"), "word").limit(n).toArrow()  # noqa: E731  (a fixed number of rows)
    counts = materialize(count_words(part), "lm-counts")
    n_types, n_all = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = counts.orderBy(F.col("word") != END, F.desc("c"), "word").limit(UNITS).toArrow()  # the end token is a unit in any case
    order = np.argsort(top.column("word").to_numpy())
    units, unit_times = top.column("word").to_numpy()[order], top.column("c").to_numpy()[order]
    cls, gain, prior, k = class_tables(part, units, classes)
    end = int(cls[unit_of(units, np.array([END], np.int64))[0]])

    parts = -(-n_types // TASK_WORDS)
    parts = parts if parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0
    words = materialize(assign_classes(count_neighbours(part, units, cls, k), gain, prior, parts), "lm-classes")
    held = docs.sparkSession.createDataFrame(most(count_words(texts.where("not train")), HELD_HEAD).to_pandas()[["word"]], "word long")
    unseen = held.join(words, "word", "left").select("word", F.coalesce("c", F.lit(0)).alias("c"), "cls").toArrow()  # HELD_HEAD rows
    first = most(words, HEAD)
    of_shape = cls[len(units) :]
    ids = np.concatenate([units, *(x.column("word").to_numpy() for x in (first, unseen))])
    times = np.concatenate([unit_times, *(x.column("c").to_numpy() for x in (first, unseen))])
    shape_cls = of_shape[unseen.column("word").to_numpy() & (SHAPES - 1)]
    late = np.where(unseen.column("c").to_numpy() > 0, unseen.column("cls").fill_null(0).to_numpy(), shape_cls)
    head_cls = np.concatenate([cls[: len(units)], first.column("cls").to_numpy(), late])
    head, at = np.unique(ids, return_index=True)  # of equal words the first, so units keep their classes
    rows = materialize(encode(texts, head, times[at], head_cls[at]).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    discard(texts, counts)
    seqs = materialize(sequences(rows, words, [int(x) for x in of_shape]), "lm-sequences")
    discard(rows)

    table = count_transitions(seqs.where("train"), k, end)
    transition = np.log10((table + 1) / (table.sum(1, keepdims=True) + k))
    types = np.bincount(cls[: len(units)], minlength=k).astype(float)
    for r in words.groupBy("cls").count().collect():  # a row for each class
        types[r["cls"]] += r["count"]
    emission = np.log10(table.sum(0) + types + 1)  # the part of P(word | class) below the line

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            before, c, starts = chained(batch, end)
            model = np.add.reduceat(transition[before, c] - emission[c], starts)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "train", "n_tokens", "n_known", "logs")), pa.array(model)], names=["doc_id", "train", "n_tokens", "n_known", "logs", "model"])

    out = seqs.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, logs double, model double")
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(n_all + n_types + 1)))).alias("base_score"), (F.col("logs") + F.col("model")).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
