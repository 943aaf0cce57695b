"""Not-modified revisits of web archives: as-of join to the latest earlier full response of the same canonical URL.

A revisit carries no body. It is resolved to the latest response of its canonical URL that was captured before it; its
validators (entity tag, last-modified, payload digest: those that both sides have) must agree, and then status and body
come from the response, and of the revisit's headers only those that a not-modified answer may update replace the stored
ones. The as-of join has two levels so that a URL with very many captures is spread: the latest response inside a
(URL, time bucket), and, over one row for each bucket, the latest response of the buckets before.

Defined results: a null URL is canonically null and resolves nothing; a null time never comes before anything; among
responses of one time the greatest record_id counts; a response of the revisit's own time doesn't come before it; without
an earlier response the state is `missing`, with disagreeing validators `changed`, else `resolved`; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Headers that a not-modified answer may update (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "age", "via")
#: Query parameters that don't tell pages apart.
IDLE = "utm_[a-z]+|ref|fbclid|gclid|sessionid"
#: Captures of one URL are spread over buckets of so many units of time.
BUCKET = 4096


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., m. or default port; no scheme, fragment, idle parameters, trailing slash or index page."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^(www|m)\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/index\\.html?$", "/"), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i)({IDLE})(=|$)")))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")))


def latest_earlier(records: DataFrame, value: Column, is_response: Column, bucket: int = BUCKET) -> DataFrame:
    """records with `found`: value of the latest response of the same `url` strictly before the row's `at`."""
    rows = records.withColumns({"_b": F.floor(F.col("at") / bucket), "_r": F.when(is_response & F.col("url").isNotNull() & F.col("at").isNotNull(), value)})
    inside = Window.partitionBy("url", "_b").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    last = lambda c, w: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "record_id"))).over(w)
    rows = rows.withColumn("_in", last("_r", inside))
    ends = rows.where("_r is not null").groupBy("url", "_b").agg(F.max_by("_r", F.struct("at", "record_id")).alias("_e"))
    buckets = rows.select("url", "_b").distinct().join(ends, ["url", "_b"], "left")
    before = Window.partitionBy("url").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("url", "_b", F.last("_e", ignorenulls=True).over(before).alias("_before")).where("_before is not null")
    return rows.join(carried, ["url", "_b"], "left").withColumn("found", F.coalesce("_in", "_before")).drop("_b", "_r", "_in", "_before")


def agree(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def bare_tag(tag: Column) -> Column:
    """Entity tags are compared weakly."""
    return F.regexp_replace(tag, '^(W/)?"?|"$', "")


def resolve(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """A row for each revisit: record_id, url, at, state, source_id, digest, headers.

    records: record_id, url, at (number), kind ('response' or 'revisit'), etag, last_modified, digest and headers (map
    from names in lower case). The body stays where it is: source_id names the record that has it.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url"), "at", "kind", "etag", "last_modified", "digest", "headers")
    full = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    found = latest_earlier(rows, full, F.col("kind") == "response", bucket).where("kind = 'revisit'")
    same = agree(bare_tag(F.col("etag")), bare_tag(F.col("found.etag"))) & agree(F.col("last_modified"), F.col("found.last_modified")) & agree(F.col("digest"), F.col("found.digest"))
    state = F.when(F.col("found").isNull(), "missing").when(same, "resolved").otherwise("changed")
    empty = F.create_map().cast("map<string,string>")
    fresh = F.map_filter(F.coalesce("headers", empty), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce("found.headers", empty), lambda k, v: ~F.map_contains_key(fresh, k))
    ok = state == "resolved"
    return found.select("record_id", "url", "at", state.alias("state"), F.when(ok, F.col("found.record_id")).alias("source_id"), F.when(ok, F.col("found.digest")).alias("digest"), F.when(ok, F.map_concat(kept, fresh)).alias("headers"))


def crawl_of(pages: DataFrame, visits: int = 3) -> DataFrame:
    """Records of a crawl that takes every page as a full response and then asks for it again `visits` times.

    Page p is captured at 10 (p + 500 v) + v on visit v, so other pages of its URL may come between; answers after the
    first are not modified. They bring an entity tag (the
    digest of what that page holds), an age, and a content type that a not-modified answer may not change.
    """
    page = F.col("page_id")
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    each = pages.select(page.cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), digest.alias("digest"), F.explode(F.sequence(F.lit(0), F.lit(visits))).alias("visit"))
    first = F.col("visit") == 0
    headers = F.create_map(F.lit("age"), F.col("visit").cast("string"), F.lit("content-type"), F.when(first, "text/html").otherwise("none"))
    return each.select(
        (F.col("page_id") * 10 + F.col("visit")).alias("record_id"), "url", ((F.col("page_id") + 500 * F.col("visit")) * 10 + F.col("visit")).alias("at"), F.when(first, "response").otherwise("revisit").alias("kind"),
        F.concat(F.when(first, F.lit('"')).otherwise('W/"'), "digest", F.lit('"')).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.when(first, F.col("digest")).alias("digest"), headers.alias("headers"),
    )


#: DuckDB twin of resolve(crawl_of(pages)), with headers as text.
SQL = r"""
WITH c AS (
  SELECT page_id * 10 + v AS record_id, (page_id + 500 * v) * 10 + v AS t, v, md5(coalesce(html, '')) AS tag,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages, (SELECT unnest(range(0, 4)) AS v)
), p AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^(www|m)\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(?i)(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS parts
  FROM c
), r AS (SELECT record_id, t, v, tag, host || path || CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END AS url FROM p),
j AS (SELECT a.*, b.record_id AS src, b.tag AS src_tag FROM (SELECT * FROM r WHERE v > 0) a ASOF LEFT JOIN (SELECT * FROM r WHERE v = 0) b ON a.url = b.url AND a.t > b.t)
SELECT record_id, url, t AS at, CASE WHEN src IS NULL THEN 'missing' WHEN tag = src_tag THEN 'resolved' ELSE 'changed' END AS state,
  CASE WHEN tag = src_tag THEN src END AS source_id, CASE WHEN tag = src_tag THEN src_tag END AS digest,
  CASE WHEN tag = src_tag THEN 'age=' || v || ';content-type=text/html' END AS headers
FROM j
"""


def headers_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
