"""Near-duplicate detection with bottom-k sketches from one hash function.

Documents with equal shingle sets become one class at once, through a digest of the set. A class keeps the k smallest
hashes of its set. Inverted lists of the retained values generate overlaps: a pair at the threshold shares all but a tail
of chances of at least `shared` of its retained values, so each class enters only the lists of its rarest
size - shared + 1 values (prefix filtering over the sketches), and values of one class alone are dropped. Lists are not
expanded into pairs: every member of a long list meets the list's pivot, the class with the most common values; the union's
sketch estimates the similarity, and what passes is verified with exact Jaccard similarity over the full sets, the pivot's text
being sent once for every few hundred of its members. Lists whose members are then in one component are done. Classes that
open lists connect form clusters, which are compared block against block over full sets, only between different components,
for sizes that can reach the threshold; a cluster that many small lists hold together is compared list by list, where that
takes fewer comparisons. A task holds two blocks, and gives no more links than connect what it found. Components are joined by
alternating stars. Joins by a value, a pivot, a cluster or a digest broadcast the rows of heavy keys (operators.skew).

Defined results: a null, empty or blank text has an empty set and is linked with nothing; fewer words than the shingle's
width make one shingle; equal sets are linked; a document is a doc_id with a text, so one doc_id may have several, linked
only where their texts are, and rows without doc_id are told apart by their texts; repeated rows are one document; a
component takes the smallest doc_id in it, null where no row of it has one; a text of any length is one set, in one task; an empty
table gives an empty result; other columns are ignored, whatever their names. Documents, shingles and digests are known by 64-, 64- and 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import Memo, chunks, id_text, materialize
from geoloom.operators.components import components
from geoloom.operators.skew import few_rows, is_heavy, join_by
from geoloom.session import discard

K = 32
#: Share of the smaller sketch that a pair at the threshold 0.8 has in common at least; for k = 32 it misses 1 in 10 ** 8.
SHARED = 0.375
#: Longer lists meet their pivot first.
SHORT_LIST = 16
#: Bounds of a block: classes, and shingles of all its classes together (one class with more is a block of its own).
BLOCK_DOCS = 512
BLOCK_SHINGLES = 1 << 18
#: Clusters of so few classes share a call: about BIN_DOCS classes are hashed into one group.
FEW_DOCS, FEW_SHINGLES = 64, 1 << 16
BIN_DOCS = 1024
#: Members of a pivot that one copy of its text serves.
PIVOT_MEMBERS = 256
#: Parts into which the pairs of blocks of one cluster are dealt.
SALTS = 16
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * MIX[1]
    h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, width: int, memo: Memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split()  # bytes.lower() changes A-Z only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    memo.trim()
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = out * MIX[0] + h[k : n - width + 1 + k]
    return np.unique(mixed(out))


def document_key(docs: DataFrame) -> Column:
    """A hash of doc_id and text, which tells documents apart where doc_id is null or has several texts."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """key, doc_id, n_shingles, a 128-bit digest of the set in two numbers, and the k smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxhash.xxh3_64_intdigest)
        for part, texts in chunks(batches):
            n, low, high, small = [], [], [], []
            for text in texts:
                s = shingle_set(text, width, memo)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                n.append(len(s))
                low.append(digest[0])
                high.append(digest[1])
                small.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(small, pa.list_(pa.int64()))], names=["key", "doc_id", "n", "low", "high", "sketch"])

    return docs.mapInArrow(run, "key long, doc_id long, n long, low long, high long, sketch array<long>")


def similar_sizes(a: str, b: str, threshold: float) -> Column:
    return 100 * F.least(a, b) >= round(100 * threshold) * F.greatest(a, b)


def lists(classes: DataFrame, k: int, scratch: list[DataFrame]) -> tuple[DataFrame, list[tuple]]:
    """(v, rep, n, common): each class in the inverted lists of its rarest retained values; values of one class are left out.
    Also the heavy values, of which there are fewer than HEAVY.

    common: how often the class's values occur in other sketches, which is greatest for what copies were made of.
    """
    postings = classes.select("rep", "n", F.explode("sketch").alias("v"))
    total = classes.agg(F.coalesce(F.sum(F.size("sketch")), F.lit(0))).first()[0]
    often = materialize(postings.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "near-values")
    scratch.append(often)
    heavy = [(r.v,) for r in often.where(is_heavy(F.col("c"), total)).select("v").collect()]  # fewer than HEAVY rows
    mine = join_by(postings, often, "v", heavy).groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("own"), F.sum("c").alias("common"))
    size = F.least(F.col("n"), F.lit(k))
    prefix = size - F.greatest(F.lit(1), F.floor(size * SHARED)) + 1
    room = (prefix - (size - F.size("own"))).cast("int")  # values of one class come first in the order
    return mine.where(room > 0).select("rep", "n", "common", F.explode(F.slice("own", F.lit(1), room)).alias("p")).select("p.v", "rep", "n", "common"), heavy


def estimated(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Pairs whose union's sketch does not rule the threshold out."""
    both = join_by(pairs, classes.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(classes.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return both.where(shared >= SHARED * F.size(union)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, width: int, threshold: float, scratch: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) of keys whose full shingle sets reach the threshold. Only the texts in question are moved.

    A pivot a may have any number of members b: they are dealt over salts, and each salt has the pivot's text once, before
    those of its members, so that a task streams over them.
    """
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "near-ids")
    scratch.append(ids)
    texts = docs.join(few_rows(ids), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    texts = materialize(texts, "near-texts")
    scratch.append(texts)
    most = pairs.groupBy("a").count().agg(F.max("count")).first()[0] or 1
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(-(-most // PIVOT_MEMBERS))).cast("int"))
    members = dealt.withColumnRenamed("b", "key").join(texts, "key").select("a", "salt", "key", "text", F.lit(1).alias("side"))
    pivots = dealt.select("a", "salt").distinct().withColumn("key", F.col("a")).join(texts, "key").select("a", "salt", "key", "text", F.lit(0).alias("side"))
    rows = members.unionByName(pivots).repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    least = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxhash.xxh3_64_intdigest)
        own = np.empty(0, np.uint64)
        for part, texts in chunks(batches):
            a, key, side = (part.column(x).to_numpy() for x in ("a", "key", "side"))
            keep = np.zeros(len(a), bool)
            for i, text in enumerate(texts):
                one = shingle_set(text, width, memo)
                if side[i] == 0:
                    own = one
                else:
                    both = len(np.intersect1d(own, one, assume_unique=True))
                    keep[i] = 100 * both >= least * (len(own) + len(one) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(key[keep])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def met_pivot(postings: DataFrame, heavy: list[tuple], threshold: float) -> DataFrame:
    """(a, b): every long list's pivot, its most common class, and the other members with sizes that can reach the threshold."""
    chosen = postings.groupBy("v").agg(F.max_by(F.struct("rep", "n"), F.struct("common", "rep")).alias("p"), F.count("*").alias("members")).where(F.col("members") > SHORT_LIST)
    met = join_by(postings, chosen, "v", heavy).where((F.col("rep") != F.col("p.rep")) & similar_sizes("n", "p.n", threshold))
    return met.select(F.col("p.rep").alias("a"), F.col("rep").alias("b")).distinct()


def open_lists(postings: DataFrame, heavy: list[tuple], roots: DataFrame | None) -> DataFrame:
    """(v, rep, n, root) of the lists whose members aren't all in one component yet."""
    if roots is None:
        with_root = postings.select("v", "rep", "n", F.col("rep").alias("root"))
    else:
        with_root = postings.join(roots, postings["rep"] == roots["node"], "left").select("v", "rep", "n", F.coalesce("root", "rep").alias("root"))
    still = with_root.groupBy("v").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("v")
    return join_by(with_root, still, "v", heavy, "left_semi")


def comparable(rest: DataFrame, heavy: list[tuple], scratch: list[DataFrame]) -> DataFrame:
    """(rep, n, root, cluster): the classes that open lists connect, a cluster being a component of the graph of these lists,
    or one list of it, where the lists' squares sum to less than the square of the component.
    """
    star = rest.groupBy("v").agg(F.min("rep").alias("a"))
    clusters = components(join_by(rest, star, "v", heavy).select("a", F.col("rep").alias("b")).distinct())
    placed = materialize(rest.join(clusters.withColumnRenamed("root", "cluster"), F.col("rep") == F.col("node")).drop("node"), "near-placed")
    scratch.append(placed)
    squares = placed.groupBy("cluster", "v").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.sum(F.col("m").cast("double") ** 2).alias("lists"))
    sizes = placed.select("cluster", "rep").distinct().groupBy("cluster").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK_DOCS)
    listed = sizes.join(squares, "cluster").where(F.col("lists") < F.col("m").cast("double") ** 2).select("cluster", F.lit(True).alias("listed"))
    listed = materialize(listed, "near-listed")
    scratch.append(listed)
    if listed.isEmpty():
        return placed.select("rep", "n", "root", "cluster").distinct()
    unit = F.when(F.col("listed"), F.xxhash64(F.lit(1), "v")).otherwise(F.col("cluster"))
    return join_by(placed, listed, "cluster", how="left").select("rep", "n", "root", unit.alias("cluster")).distinct()


def blocks(members: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """members with bucket (sizes within a tenth), settled (in the cluster's largest component) and block: at most about
    BLOCK_DOCS classes and BLOCK_SHINGLES shingles of one bucket, chosen by a hash.
    """
    by_root = members.groupBy("cluster", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("cluster")
    few = (F.sum("c") <= FEW_DOCS) & (F.sum("s") <= FEW_SHINGLES)
    largest = by_root.agg(F.max_by("root", F.struct("c", "root")).alias("_main"), few.alias("few"))
    rows = join_by(members, largest, "cluster").withColumn("settled", F.col("root") == F.col("_main")).drop("_main")
    rows = rows.withColumn("bucket", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.1))).cast("int"))
    rows = materialize(rows, "near-rows")
    scratch.append(rows)
    group = ["cluster", "settled", "bucket"]
    sizes = rows.groupBy(*group).agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("_n"))
    return join_by(rows, sizes, group).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int")).drop("_n")


def block_pairs(rows: DataFrame) -> DataFrame:
    """(rep, n, root, few, pair, side): every class once for each pair of blocks of its cluster that may hold links."""
    own = ["cluster", "settled", "bucket", "block"]
    each = rows.select(*own).distinct().withColumn("id", F.xxhash64(*own))
    other = each.select("cluster", F.col("settled").alias("settled2"), F.col("bucket").alias("near"), F.col("id").alias("id2"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    each = each.withColumns({"salt": F.pmod(F.col("id"), F.lit(SALTS)).cast("int"), "near": F.explode(F.sequence(F.col("bucket") - 3, F.col("bucket") + 3))})  # a ratio of sizes up to 1.25
    pairs = each.join(other, ["cluster", "near", "salt"]).where((F.col("id") <= F.col("id2")) & ~(F.col("settled") & F.col("settled2")))
    pairs = pairs.select("id", "id2", F.xxhash64("id", "id2").alias("pair"))
    sides = pairs.select(F.col("id").alias("_id"), "pair", F.lit(0).alias("side")).unionByName(pairs.where("id <> id2").select(F.col("id2").alias("_id"), "pair", F.lit(1).alias("side")))
    return rows.withColumn("_id", F.xxhash64(*own)).join(sides, "_id").select("rep", "n", "root", "few", "pair", "side")


def shared_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other, by products of 0-1 matrices."""
    sets = [*one, *two]
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    keep = count[at] > 1
    column, owner = (np.cumsum(count > 1) - 1)[at[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        out += m[: len(one)] @ m[len(one) :].T
    return out


def forest(a: list[int], b: list[int], links: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the links (rows of indexes into a and b) to connect what all of them connect."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in links:
        x, y = top(a[i]), top(b[j])
        if x != y:
            root[x] = y
            out.append((a[i], b[j]))
    return out


def links_in_blocks(rows: DataFrame, sets: DataFrame, threshold: float, bins: int) -> DataFrame:
    """Links (a, b) between classes of different components: exact Jaccard similarity of full sets, block against block."""
    least = round(100 * threshold)
    placed = rows.join(sets, "rep").withColumn("bin", F.when(F.col("few"), F.pmod(F.col("pair"), F.lit(bins))).otherwise(F.col("pair")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in pdf.groupby("pair", sort=False):
            side = group["side"].to_numpy()
            ids, roots, sets_ = group["rep"].to_numpy(), group["root"].to_numpy(), [np.asarray(x) for x in group["set"]]
            one = np.flatnonzero(side == 0)
            two = np.flatnonzero(side == 1) if (side == 1).any() else one
            size = np.array([len(x) for x in sets_], np.float64)
            both = shared_counts([sets_[i] for i in one], [sets_[i] for i in two]).astype(np.float64)
            fine = (100 * both >= least * (size[one][:, None] + size[two] - both)) & (roots[one][:, None] != roots[two])
            out += forest(ids[one].tolist(), ids[two].tolist(), np.argwhere(fine))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return placed.groupBy("bin").applyInPandas(run, "a long, b long")


def full_sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(rep, set): the whole shingle set of these documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxhash.xxh3_64_intdigest)
        for part, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([shingle_set(t, width, memo).view(np.int64) for t in texts], pa.list_(pa.int64()))], names=["rep", "set"])

    texts = docs.join(few_rows(reps.select(F.col("rep").alias("key"))), "key", "left_semi")
    return texts.select("key", "text").mapInArrow(run, "rep long, set array<long>")


def link_classes(classes: DataFrame, docs: DataFrame, width: int, threshold: float, k: int) -> DataFrame | None:
    """(node, root) of the classes that have links to other classes; None without any."""
    scratch: list[DataFrame] = []

    def table(df: DataFrame, what: str) -> DataFrame:
        scratch.append(materialize(df, what))
        return scratch[-1]

    listed, heavy = lists(classes, k, scratch)
    postings = table(listed, "near-lists")
    pairs = table(estimated(table(met_pivot(postings, heavy, threshold), "near-met"), classes, k), "near-pairs")
    links = roots = None
    if not pairs.isEmpty():
        links = table(verified(pairs, docs, width, threshold, scratch), "near-links")
        roots = materialize(components(links), "near-roots")
    rest = table(open_lists(postings, heavy, roots), "near-open")
    if not rest.isEmpty():
        members = table(blocks(table(comparable(rest, heavy, scratch), "near-members"), scratch), "near-blocks")
        reps = table(members.select("rep").distinct(), "near-reps")
        sets = table(full_sets(docs, reps, width).groupBy("rep").agg(F.first("set").alias("set")), "near-sets")
        found = table(links_in_blocks(block_pairs(members), sets, threshold, members.count() // BIN_DOCS + 1), "near-links")
        links = found if links is None else links.unionByName(found)
        if roots is not None:
            scratch.append(roots)
        roots = materialize(components(links), "near-roots")
    discard(*scratch)
    return roots


def resolved(docs: DataFrame, width: int, threshold: float, k: int) -> DataFrame:
    """key, doc_id, n_shingles, component_id and kept for each row; repeated rows share their key and what is found."""
    docs = id_text(docs)
    docs = docs.select(document_key(docs).alias("key"), "doc_id", "text")
    rows = materialize(sketches(docs, width, k), "near-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    classes = materialize(rows.where("n > 0").groupBy("low", "high", "n").agg(F.min("key").alias("rep"), first, F.first("sketch").alias("sketch"), F.count("*").alias("times")), "near-classes")
    roots = link_classes(classes.select("rep", "n", "sketch"), docs, width, threshold, k)
    where = classes.select("low", "high", "rep", "first", "times")
    if roots is not None:
        where = where.join(roots, where["rep"] == roots["node"], "left").select("low", "high", "first", "times", F.coalesce("root", "rep").alias("root"))
        where = materialize(where, "near-where")
        firsts = where.groupBy("root").agg(F.min("first").alias("first"))
        where = join_by(where.drop("first"), firsts, "root")
    own = rows.select("key", "doc_id", "n", "low", "high")
    total = classes.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    heavy = [tuple(r) for r in classes.where(is_heavy(F.col("times"), total)).select("low", "high").collect()]  # fewer than HEAVY rows
    out = join_by(own, where.select("low", "high", "first"), ["low", "high"], heavy, "left")
    alone = F.col("n") == 0
    return out.select(
        "key", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), (alone | (F.col("key") == F.col("first.key"))).alias("kept")
    )


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept for each row."""
    return resolved(docs, width, threshold, k).drop("key")


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id (and of its repeated rows, one); all columns stay.

    Rows with neither doc_id nor words can't be told apart, nor shown to be copies: all stay.
    """
    best = resolved(docs, width, threshold, K).where("kept").select(F.col("key").alias("_key")).distinct()
    nothing = docs["doc_id"].isNull() & ~F.coalesce(docs["text"].cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    own = F.when(nothing, F.monotonically_increasing_id())
    return docs.withColumns({"_key": document_key(docs), "_own": own}).join(best, "_key", "left_semi").dropDuplicates(["_key", "_own"]).select(*docs.columns)


#: DuckDB twin of near_duplicates(width=4) over the table documents.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_slice(w, k, k + 3) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT met.a, met.b FROM met JOIN n x ON x.doc_id = met.a JOIN n y ON y.doc_id = met.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM root LEFT JOIN n USING (doc_id)
"""
