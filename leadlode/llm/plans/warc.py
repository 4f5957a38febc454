"""op9: captures of all pages, each visited four times, with their revisits resolved."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlode.llm.warc import resolve_revisits

START = 1_700_000_000


def captures(pages):
    """Four visits of each page: the page itself, then answers that it has not changed, under varied addresses.

    The third visit has another tag on every fifth page and only a date on the others; the fourth is a new
    version on every seventh page and otherwise has a weak tag, but none on every eleventh.
    """
    digest = F.md5(F.col("html"))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"'))
    date = F.concat(F.lit("day-"), F.col("page_id"))
    visit = F.col("visit")
    seen = pages.select("page_id", "url", digest.alias("digest"), tag.alias("tag"), date.alias("date"), F.length("html").alias("length")).withColumn(
        "visit", F.explode(F.array(*[F.lit(k) for k in range(4)]))
    )
    full = (visit == 0) | ((visit == 3) & (F.col("page_id") % 7 == 0))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    when = F.lit(START) + F.col("page_id") * 600 + visit * 86400
    of_page = F.concat(
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.col("length") + visit),
        line("ETag", F.when(visit == 0, F.col("tag")).otherwise(F.lit('"new"'))),
        line("Last-Modified", F.concat(F.col("date"), F.when(visit == 0, "").otherwise("-new"))),
        line("Cache-Control", F.lit("max-age=60")),
        line("Date", when),
    )
    named = (
        F.when(visit == 1, line("ETag", F.col("tag")))
        .when((visit == 2) & (F.col("page_id") % 5 == 0), line("ETag", F.lit('"other"')))
        .when(visit == 2, line("Last-Modified", F.col("date")))
        .when(F.col("page_id") % 11 == 0, F.lit(""))
        .otherwise(line("etag", F.concat(F.lit("W/"), F.col("tag"))))
    )
    of_answer = F.concat(
        named,
        line("Content-Length", F.lit(0)),
        line("Cache-Control", F.lit("max-age=5")),
        line("cache-control", F.concat(F.lit("max-age="), 100 + visit)),
        line("Expires", when + 100),
        line("Date", when),
    )
    return seen.select(
        (F.col("page_id") * 4 + visit).alias("record_id"),
        F.when(visit == 1, F.concat("url", F.lit("#part")))
        .when(visit == 2, F.regexp_replace("url", "^https?://", "HTTP://www."))
        .otherwise(F.col("url"))
        .alias("url"),
        when.alias("ts"),
        F.when(full, 200).otherwise(304).alias("status"),
        F.when(full, of_page).otherwise(of_answer).alias("headers"),
        F.when(full, F.when(visit == 0, F.col("digest")).otherwise(F.md5("digest"))).alias("payload_digest"),
        F.when(full, F.col("length") + visit).cast("long").alias("payload_length"),
    )


def op9_revisits(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    found = resolve_revisits(captures(pages))
    return found.select("row.record_id", "canonical", "outcome", "refers_to", "payload_digest", "payload_length", "headers")


QUERIES = {"op9_revisits": op9_revisits}

SQL = {
    "op9_revisits": r"""
WITH v AS (SELECT page_id, url, md5(html) AS digest, '"' || substr(md5(html), 1, 12) || '"' AS tag, 'day-' || page_id AS day,
    length(html) AS length, visit, 1700000000 + page_id * 600 + visit * 86400 AS ts
  FROM pages, (SELECT unnest(range(0, 4)) AS visit)),
c AS (
  SELECT page_id * 4 + visit AS record_id, ts, visit = 0 OR visit = 3 AND page_id % 7 = 0 AS is_full, digest, length, visit, day, tag, page_id,
    CASE visit WHEN 1 THEN url || '#part' WHEN 2 THEN regexp_replace(url, '^https?://', 'HTTP://www.') ELSE url END AS url
  FROM v),
h AS (
  SELECT *, CASE WHEN is_full THEN CASE WHEN visit = 0 THEN tag ELSE '"new"' END
      WHEN visit = 1 THEN tag WHEN visit = 2 AND page_id % 5 = 0 THEN '"other"' WHEN visit = 2 THEN NULL
      WHEN page_id % 11 = 0 THEN NULL ELSE 'W/' || tag END AS etag,
    CASE WHEN is_full THEN day || CASE WHEN visit = 0 THEN '' ELSE '-new' END WHEN visit = 2 AND page_id % 5 <> 0 THEN day END AS modified,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS bare
  FROM c),
u AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))), '&') AS query
  FROM h),
k AS (SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM u),
f AS (SELECT * FROM k WHERE is_full),
b AS (
  SELECT r.*, arg_max(f.record_id, f.ts * 1000000000 + f.record_id) AS base
  FROM k r LEFT JOIN f ON f.canonical = r.canonical AND (f.ts < r.ts OR f.ts = r.ts AND f.record_id < r.record_id)
  WHERE NOT r.is_full GROUP BY ALL),
o AS (
  SELECT b.*, f.etag AS base_etag, f.modified AS base_modified, f.visit AS base_visit, f.length AS base_length, f.digest AS base_digest,
    CASE WHEN b.base IS NULL THEN 'no_original' WHEN b.etag IS NULL AND b.modified IS NULL THEN 'no_validator'
      WHEN b.etag IS NOT NULL AND regexp_replace(b.etag, '^W/', '') = f.etag THEN 'resolved'
      WHEN b.etag IS NULL AND b.modified = f.modified THEN 'resolved' ELSE 'changed' END AS outcome
  FROM b LEFT JOIN f ON f.record_id = b.base)
SELECT record_id, canonical, outcome, CASE WHEN outcome = 'resolved' THEN base END AS refers_to,
  CASE WHEN outcome = 'resolved' THEN CASE WHEN base_visit = 0 THEN base_digest ELSE md5(base_digest) END END AS payload_digest,
  CASE WHEN outcome = 'resolved' THEN base_length + base_visit END::BIGINT AS payload_length,
  'cache-control: max-age=' || (100 + visit) || CASE WHEN outcome = 'resolved' THEN chr(10) || 'content-length: ' || (base_length + base_visit)
      || chr(10) || 'content-type: text/html' ELSE chr(10) || 'content-length: 0' END || chr(10) || 'date: ' || ts
    || CASE WHEN coalesce(etag, CASE WHEN outcome = 'resolved' THEN base_etag END) IS NULL THEN ''
        ELSE chr(10) || 'etag: ' || coalesce(etag, base_etag) END
    || chr(10) || 'expires: ' || (ts + 100)
    || CASE WHEN coalesce(modified, CASE WHEN outcome = 'resolved' THEN base_modified END) IS NULL THEN ''
        ELSE chr(10) || 'last-modified: ' || coalesce(modified, base_modified) END AS headers
FROM o
UNION ALL
SELECT record_id, canonical, 'full', NULL, CASE WHEN visit = 0 THEN digest ELSE md5(digest) END, (length + visit)::BIGINT,
  'cache-control: max-age=60' || chr(10) || 'content-length: ' || (length + visit) || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || ts || chr(10) || 'etag: ' || etag || chr(10) || 'last-modified: ' || modified
FROM k WHERE is_full
"""
}
