"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Terms of the test items are counted over the whole corpus. The index holds a posting (document, term, position) for every
occurrence of the LISTS rarest terms of each window of an item. The rarest term's list is met first: around each of its
postings the other lists are looked up in the same document, block of positions by block, and intersected at their offsets;
an exact phrase has every listed term at its own distance from the rarest, a proximity match has all within reach. What is
left, hardly more than the matches themselves, is checked against the documents' words: exact phrases word for word, proximity
matches for all words of the window around the posting, in any order. A term that the corpus lacks rules its windows out.

Postings are joined by document, term and block, so no common term gathers in one task; terms meet the dictionary by broadcast
while that is small (BROADCAST_BYTES, which is measured), and else with heavy terms apart (operators.skew).

Defined results: a null or blank text has no words and no hits; an item without words or without an id has no windows;
items of fewer words than a window are one window; of terms that are equally rare the smaller one counts as rarer; repeated
rows of documents get equal results (a document is known by doc_id and a hash of its text), repeated items count once by
item_id; texts of any length are indexed whole; an empty table on either side gives no hits; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import id_text, materialize
from geoloom.operators.skew import is_heavy, join_by

WINDOW = 10
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lists of a window that are intersected, from the rarest.
LISTS = 3
#: Positions in a block of a list.
BLOCK = 64
#: Bytes up to which a table made from the benchmark is broadcast.
BROADCAST_BYTES = 32 << 20
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def met_by(rows: DataFrame, table: DataFrame, key: str, heavy: list[tuple] | None) -> DataFrame:
    """rows joined with a written table that has one row for each key: by broadcast while it is small.

    heavy: heavy keys of rows where they are known; None: rows are a written table and theirs are counted.
    """
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))).first()[0] or 0
    return rows.join(F.broadcast(table), key) if size <= BROADCAST_BYTES else join_by(rows, table, key, heavy)


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), BREAKS), "")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(words, items): every window, with the ids of the items that have it."""
    rows = items.select(F.col("item_id").alias("item"), words(F.col("text").cast("string")).alias("w")).where("item is not null and size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    cut = rows.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in the corpus of each of the terms that occur. Counts are combined before they are moved."""
    each = docs.select(F.explode(words(F.col("text"))).alias("term"))
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    few = size <= BROADCAST_BYTES
    counts = (each.join(F.broadcast(terms), "term") if few else each).groupBy("term").agg(F.count("*").alias("n"))
    return counts if few else counts.join(terms, "term")


def ranked(windows: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """(id, words, items, rare): windows all of whose terms occur, with their rarest terms (n, term, at), at the first offset."""
    rows = windows.withColumn("id", F.md5(F.array_join("words", " ")))
    terms = rows.select("id", F.posexplode("words").alias("at", "term")).groupBy("id", "term").agg(F.min("at").alias("at"))
    terms = terms.join(counts, "term", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "at"))).alias("rare"))
    return rows.join(terms.where(F.get("rare", F.lit(0))["n"] > 0), "id").withColumn("rare", F.slice("rare", 1, lists))


def positional_index(docs: DataFrame, terms: DataFrame, heavy: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """The index (doc_id, h, term, pos), and (doc_id, h, n_words) of each row of docs, both from one look at the texts.

    terms: a written table of terms; heavy: those of them that make up much of the corpus. The end of a document is the
    posting of the empty term.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.array_append(words(F.col("text")), F.lit(""))).alias("pos", "term"))
    found = materialize(met_by(rows, terms, "term", heavy), "decon-postings")
    index = found.where("term <> ''").distinct()  # repeated rows of documents have the same postings
    return materialize(index, "decon-index"), found.where("term = ''").select("doc_id", "h", F.col("pos").cast("long").alias("n_words"))


def neighbours(index: DataFrame, looked: DataFrame, reach: int) -> DataFrame:
    """(doc_id, h, t1, p1, term, delta): postings of a window's other listed terms within reach of its rarest term's postings."""
    pairs = looked.select(F.get("rare", F.lit(0))["term"].alias("term"), F.explode(F.slice("rare", 2, LISTS)).alias("o"))
    pairs = materialize(pairs.groupBy("term").agg(F.collect_set("o.term").alias("others")), "decon-pairs")
    first = met_by(index, pairs, "term", None).select("doc_id", "h", F.col("term").alias("t1"), F.col("pos").alias("p1"), F.explode("others").alias("term"))
    blocks = F.sequence(F.floor((F.col("p1") - reach) / BLOCK).cast("int"), F.floor((F.col("p1") + reach) / BLOCK).cast("int"))
    first = first.withColumn("block", F.explode(blocks))
    other = index.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("term").alias("_term"), F.floor(F.col("pos") / BLOCK).cast("int").alias("_block"), "pos")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("term") == F.col("_term")) & (F.col("block") == F.col("_block"))
    delta = F.col("pos") - F.col("p1")
    return first.join(other, same).where(F.abs(delta) <= reach).select("doc_id", "h", "t1", "p1", "term", delta.alias("delta"))


def intersected(index: DataFrame, looked: DataFrame, reach: int) -> DataFrame:
    """(doc_id, h, id, p1): postings of windows' rarest terms around which all their listed terms lie within reach."""
    rare = F.get("rare", F.lit(0))
    near = materialize(neighbours(index, looked, reach), "decon-near").withColumn("key", F.concat_ws(" ", "t1", "term"))
    need = looked.select("id", (F.size("rare") - 1).alias("others"), rare["term"].alias("t1"), F.explode(F.slice("rare", 2, LISTS)).alias("o"))
    need = need.select(F.concat_ws(" ", "t1", "o.term").alias("key"), F.struct("id", "others").alias("w")).groupBy("key").agg(F.collect_list("w").alias("ws"))
    met = met_by(near, materialize(need, "decon-need"), "key", None).select("doc_id", "h", "p1", "term", F.explode("ws").alias("w")).select("doc_id", "h", "p1", "term", "w.*")
    several = met.groupBy("doc_id", "h", "id", "p1", "others").agg(F.count_distinct("term").alias("n")).where("n = others").select("doc_id", "h", "id", "p1")
    alone = materialize(looked.where(F.size("rare") == 1).select(rare["term"].alias("term"), "id").groupBy("term").agg(F.collect_list("id").alias("ids")), "decon-alone")
    single = met_by(index, alone, "term", None).select("doc_id", "h", F.explode("ids").alias("id"), F.col("pos").alias("p1"))
    return several.unionByName(single)


def lookups(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Places where windows match: doc_id, h, start, size, items, exact (phrase at this place) and near (all its words around);
    and doc_id, h and n_words of each row of docs.
    """
    reach = window - 1
    windows = materialize(item_windows(items, window), "decon-windows")
    terms = materialize(windows.select(F.explode("words").alias("term")).distinct(), "decon-terms")
    counts = materialize(term_counts(docs, terms), "decon-counts")
    looked = materialize(ranked(windows, counts), "decon-ranked")
    ends = docs.sparkSession.createDataFrame([("",)], "term string")
    listed = materialize(looked.select(F.explode("rare.term").alias("term")).distinct().unionByName(ends), "decon-listed")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # of the benchmark's terms: fewer than all words, so no heavy one is missed
    heavy = [(r.term,) for r in counts.where(is_heavy(F.col("n"), total)).select("term").collect()]  # fewer than HEAVY rows
    index, base = positional_index(docs, listed, [*heavy, ("",)])
    places = materialize(intersected(index, looked, reach), "decon-places")

    of_doc = materialize(places.groupBy("doc_id", "h").agg(F.collect_set(F.struct("id", "p1")).alias("places")), "decon-docs")
    same = docs["doc_id"].eqNullSafe(of_doc["doc_id"]) & (F.xxhash64(docs["text"]) == of_doc["h"])
    size = of_doc.agg(F.sum(F.size("places"))).first()[0] or 0
    both = docs.join(F.broadcast(of_doc) if size * 80 <= BROADCAST_BYTES else of_doc, same).select(of_doc["doc_id"], "h", "places", docs["text"])
    first = lambda p: F.greatest(F.lit(0), p["p1"] - reach)
    cut = F.transform(  # the one-element array gives the words a name, so that they are made once
        F.array(F.struct(words(F.col("text")).alias("w"))),
        lambda x: F.transform("places", lambda p: F.struct(p["id"].alias("id"), p["p1"].alias("p1"), first(p).alias("first"), F.slice(x["w"], first(p) + 1, p["p1"] - first(p) + reach + 1).alias("around"))),
    )
    around = both.select("doc_id", "h", F.explode(F.get(cut, F.lit(0))).alias("p")).select("doc_id", "h", "p.*")
    met = met_by(materialize(around, "decon-around"), looked, "id", None)
    start = F.col("p1") - F.get("rare", F.lit(0))["at"]
    inside = (start >= F.col("first")) & (start + F.size("words") <= F.col("first") + F.size("around"))
    exact = inside & (F.slice("around", F.greatest(F.lit(1), start - F.col("first") + 1), F.size("words")) == F.col("words"))
    every = F.size(F.array_except("words", "around")) == 0
    met = met.select("doc_id", "h", start.alias("start"), F.size("words").alias("size"), "items", exact.alias("exact"), every.alias("near")).where("exact or near")
    return met, base


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, proximity: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs.

    proximity: also n_near_items, the items of which all words of a window occur around its rarest one, in any order.
    """
    docs = id_text(docs)
    met, base = lookups(docs, items, window)
    exact = F.col("exact")
    per_doc = met.groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_set(F.when(exact, F.struct("start", (F.col("start") + F.col("size")).alias("end"))))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.when(exact, F.col("items"))))).alias("hit_items"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("near_items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], x["end"]).alias("reach")),
        lambda a: a["n"].cast("long"),
    )
    ids = F.array_sort(F.transform("hit_items", lambda x: x.cast("string")))
    per_doc = per_doc.select("doc_id", "h", covered.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.array_join(ids, ",").alias("ids"), F.size("near_items").cast("long").alias("n_near_items"))
    both = base.join(per_doc.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")) & (base["h"] == per_doc["h"]), "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return both.select(
        "doc_id", "n_words", none("n_hit").alias("n_hit"), none("n_items").alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (none("n_hit") > 0).alias("contaminated"),
        *([none("n_near_items").alias("n_near_items")] if proximity else []),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a window of an item; all columns stay."""
    met = lookups(id_text(docs), items, window)[0].where("exact").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    met = materialize(met, "decon-hit")
    return docs.join(met, docs["doc_id"].cast("long").eqNullSafe(met["_id"]) & (F.xxhash64(docs["text"].cast("string")) == met["_h"]), "left_anti")


#: DuckDB twin of decontaminate() over the tables documents and benchmark.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + least(10, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)
), lens AS (SELECT DISTINCT len(g) AS n FROM iw), dw AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (g)), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
), counts AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d) GROUP BY term), gram AS (SELECT DISTINCT g FROM iw), rarest AS (
  SELECT g, term FROM (
    SELECT g, t.term, row_number() OVER (PARTITION BY g ORDER BY n, t.term) AS r, count(n) OVER (PARTITION BY g) AS met, count(*) OVER (PARTITION BY g) AS terms
    FROM (SELECT g, unnest(list_distinct(g)) AS term FROM gram) t LEFT JOIN counts USING (term)
  ) WHERE r = 1 AND met = terms
), places AS (SELECT doc_id, w, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM d), near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM (
    SELECT DISTINCT doc_id, g FROM places JOIN rarest USING (term) WHERE list_has_all(list_slice(w, greatest(1, p - 9), p + 9), g)
  ) JOIN iw USING (g) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""
