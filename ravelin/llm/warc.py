"""WARC: resolution of not-modified revisits.

A revisit record with a 304 answer has no body. It is resolved to the latest earlier full response of
the same canonical URL; its validators must agree with that response's, and the response's headers are
updated with those headers of the 304 answer that may update a stored response.

The as-of join is done in two levels, so that a URL with a third of all records is no single task: records
are reduced to one row per URL and instant, these are cut by range of (URL, instant) into slices of about
SLICE rows, the last response before each is found within (slice, URL), and the last response of the slices
before, at most one row a slice, is carried in. The ranges follow the rows, so one absurd time does no harm.
Only narrow columns go through these windows; headers and bodies meet their revisit by record id at the end,
where a response that many revisits need is copied once for every SHARE of them and these are dealt among the copies.

Columns of records: record_id, kind ('response' or 'revisit'), url, time (long, e.g. microseconds),
status int, headers map<string,string> (lower-case names), body string. Other columns are not read.

Defined cases: a response counts only with status 200 and strictly before the revisit; of several at
one instant the one with the largest record_id. With an etag on both sides the etags decide (weak
comparison), else with last-modified on both sides that; else the revisit has no validator. States are
'resolved', 'no_response', 'mismatch', 'no_validator'. Only resolved ones get a body and headers. A null
URL or time matches nothing ('no_response'); null headers are empty. Rows that repeat a revisit are resolved
each; of full responses with one record_id, URL and time the one with the largest (body, headers) counts. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SLICE, SHARE = 500_000, 10_000
# Fields that describe the stored body or one connection; a 304 answer may not change them.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical(url: Column) -> Column:
    """Lower-case scheme-less host without 'www.' and default port, path without fragment and trailing slash, sorted query."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^(?:[^@]*@)?(?:www\.)?", ""), r":(?:80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    sorted_query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), sorted_query)).otherwise(""))


def _validators(h: Column) -> tuple[Column, Column]:
    return F.regexp_replace(F.get(F.map_values(F.map_filter(h, lambda k, _: k == "etag")), F.lit(0)), "^W/", ""), h["last-modified"]


def as_of(dated: DataFrame, rows: int = SLICE) -> DataFrame:
    """url_key, time, base_id, base_time: for every instant of a revisit the last response before it; others are left out.

    dated: url_key, time, response (the record_id of a full response, or null), asked (1 for a revisit).
    """
    instants = materialize(dated.groupBy("url_key", "time").agg(F.max("response").alias("response"), F.max("asked").alias("asked")), "instants")
    slices = max(1, -(-instants.count() // rows))
    cut = instants.repartitionByRange(slices, "url_key", "time").select("*", F.spark_partition_id().alias("slice"))
    answer = F.when(F.col("response").isNotNull(), F.struct("response", F.col("time").alias("at")))
    cut = materialize(cut.withColumn("answer", answer), "slices")
    within = Window.partitionBy("slice", "url_key").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("near", F.last("answer", ignorenulls=True).over(within))
    # a URL goes on from one slice to the next, so only the first and last URL of each slice matter here
    edges = F.broadcast(cut.groupBy("slice").agg(F.min("url_key").alias("first"), F.max("url_key").alias("final")))
    ends = cut.join(edges, "slice").where("url_key = first OR url_key = final").groupBy("slice", "url_key").agg(F.max_by("answer", "answer.at").alias("last"))
    earlier = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("slice", "url_key", F.last("last", ignorenulls=True).over(earlier).alias("far")).where("far IS NOT NULL")
    met = near.where("asked = 1").join(F.broadcast(carried), ["slice", "url_key"], "left").withColumn("base", F.coalesce("near", "far"))
    return met.where("base IS NOT NULL").select("url_key", "time", F.col("base.response").alias("base_id"), F.col("base.at").alias("base_time"))


def _once(base: DataFrame) -> DataFrame:
    """One row for each base_id, url_key and base_time; bodies are only grouped where ids repeat at all."""
    key = ["base_id", "url_key", "base_time"]
    if base.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return base
    entries = F.array_sort(F.map_entries("stored"))
    best = base.select(*key, F.struct("stored_body", entries.alias("entries")).alias("x")).groupBy(*key).agg(F.max("x").alias("x"))
    return best.select(*key, F.map_from_entries("x.entries").alias("stored"), F.col("x.stored_body").alias("stored_body"))


def resolve(records: DataFrame, rows_a_slice: int = SLICE, share: int = SHARE) -> DataFrame:
    """record_id, url_key, base_id, state, headers, body of every revisit."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = records.select(
        "record_id", "kind", canonical(F.col("url")).alias("url_key"), F.col("time").cast("long").alias("time"),
        "status", F.coalesce("headers", none).alias("headers"), "body",
    )
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()
    dated = rows.where(F.col("url_key").isNotNull() & F.col("time").isNotNull())
    found = as_of(dated.select(
        "url_key", "time", F.when(full, F.col("record_id")).alias("response"), (F.col("kind") == "revisit").cast("int").alias("asked")
    ), rows_a_slice)
    asked = rows.where("kind = 'revisit'").select("record_id", "url_key", "time", F.col("headers").alias("fresh"))
    asked = asked.join(found, ["url_key", "time"], "left")
    copies = F.ceil(F.count(F.lit(1)) / share).cast("int").alias("copies")
    often = materialize(asked.where("base_id IS NOT NULL").groupBy("base_id").agg(copies).where("copies > 1"), "often")
    often = F.broadcast(often)  # at most one id for every ``share`` revisits
    dealt = asked.join(often, "base_id", "left")
    dealt = dealt.withColumn("copy", F.pmod(F.xxhash64("record_id", "time"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    base = _once(dated.where(full).select(
        F.col("record_id").alias("base_id"), "url_key", F.col("time").alias("base_time"), F.col("headers").alias("stored"), F.col("body").alias("stored_body")
    )).join(often, "base_id", "left")
    base = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    both = dealt.join(base, ["base_id", "url_key", "base_time", "copy"], "left")
    (tag, since), (old_tag, old_since) = _validators(F.col("fresh")), _validators(F.col("stored"))
    agrees = F.when(tag.isNotNull() & old_tag.isNotNull(), tag == old_tag).when(since.isNotNull() & old_since.isNotNull(), since == old_since)
    state = (
        F.when(F.col("base_id").isNull(), "no_response").when(agrees.isNull(), "no_validator").when(agrees, "resolved").otherwise("mismatch")
    )
    allowed = F.map_filter("fresh", lambda k, _: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.map_contains_key(allowed, k)), allowed)
    ok = F.col("state") == "resolved"
    return both.withColumn("state", state).select(
        "record_id", "url_key", "base_id", "state", F.when(ok, merged).alias("headers"), F.when(ok, F.col("stored_body")).alias("body")
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl's records made of ``pages``: every page is fetched once, and asked for again later.

    Page p is a full response at time 1000 p (not modified since day p % 28 + 1, etag by its bytes) and
    is visited again at 1000 p + 500000 with a validator: every fifth by date only, every seventh with a
    stale etag, every eleventh without any. Pages without an id are left out.
    """
    p = F.col("page_id")
    etag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit(""))), F.lit('"'))
    day = F.concat(F.lit("2024-01-"), F.lpad((p % 28 + 1).cast("string"), 2, "0"))
    size = F.length(F.coalesce(F.col("html"), F.lit(""))).cast("string")
    rows = pages.where(p.isNotNull())
    response = rows.select(
        (2 * p).alias("record_id"), F.lit("response").alias("kind"), "url", (1000 * p).alias("time"), F.lit(200).alias("status"),
        F.create_map(F.lit("etag"), etag, F.lit("last-modified"), day, F.lit("content-length"), size, F.lit("age"), F.lit("0")).alias("headers"),
        F.col("html").alias("body"),
    )
    names = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("age"), p.cast("string"))
    sent = (
        F.when(p % 11 == 0, names).when(p % 5 == 0, F.map_concat(names, F.create_map(F.lit("last-modified"), day)))
        .otherwise(F.map_concat(names, F.create_map(F.lit("etag"), F.when(p % 7 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), etag)))))
    )
    revisit = rows.select(
        (2 * p + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", (1000 * p + 500_000).alias("time"), F.lit(304).alias("status"),
        sent.alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return response.unionByName(revisit)


def digest(resolved: DataFrame) -> DataFrame:
    return resolved.select(
        "record_id", "url_key", "base_id", "state", F.md5("body").alias("body_md5"), F.length("body").cast("long").alias("body_chars"),
        F.col("headers")["age"].alias("age"), F.col("headers")["content-length"].alias("content_length"),
        F.array_join(F.array_sort(F.map_keys("headers")), ",").alias("header_names"),
    )


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id AS p, html, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages WHERE page_id IS NOT NULL
), k AS (
  SELECT p, html, coalesce(html, '') AS h,
         regexp_replace(regexp_replace(lower(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)', 1)),
           '^(?:[^@]*@)?(?:www\.)?', ''), ':(?:80|443)?$', '')
         || regexp_replace(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)', 1), '/+$', '')
         || CASE WHEN regexp_extract(bare, '\?(.*)$', 1) <> ''
              THEN '?' || array_to_string(list_sort(string_split(regexp_extract(bare, '\?(.*)$', 1), '&')), '&') ELSE '' END AS url_key
  FROM u
), r AS (
  SELECT 2 * p AS base_id, url_key, 1000 * p AS t, html AS body, md5(h) AS etag, p % 28 AS day, length(h) AS n FROM k
), v AS (
  SELECT 2 * p + 1 AS record_id, p, url_key, 1000 * p + 500000 AS t, md5(h) AS etag, p % 28 AS day FROM k
), j AS (
  SELECT v.record_id, v.p, v.url_key, r.base_id, r.body, r.n,
         CASE WHEN r.base_id IS NULL THEN 'no_response' WHEN v.p % 11 = 0 THEN 'no_validator'
              WHEN v.p % 5 = 0 THEN CASE WHEN v.day = r.day THEN 'resolved' ELSE 'mismatch' END
              WHEN v.p % 7 <> 0 AND v.etag = r.etag THEN 'resolved' ELSE 'mismatch' END AS state
  FROM v ASOF LEFT JOIN r ON v.url_key = r.url_key AND v.t > r.t
)
SELECT record_id, url_key, base_id, state,
       CASE WHEN state = 'resolved' THEN md5(body) END AS body_md5,
       CASE WHEN state = 'resolved' THEN length(body) END AS body_chars,
       CASE WHEN state = 'resolved' THEN CAST(p AS VARCHAR) END AS age,
       CASE WHEN state = 'resolved' THEN CAST(n AS VARCHAR) END AS content_length,
       CASE WHEN state = 'resolved' THEN 'age,content-length,etag,last-modified' END AS header_names
FROM j
"""
