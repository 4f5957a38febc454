"""Candidate-cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlode.operators import candidates as CA
from leadlode.operators import results_page as RP
from leadlode.plans import views as V
from leadlode.sources.readers import text_table
from leadlode.functions import urls


def _cleaned(spark, folder):
    return CA.filter_candidates(V.hits(spark, folder), excluded=V.EXCLUDED)


def candidate_domains(spark, folder):
    return CA.with_domain(V.hits(spark, folder)).select("page_id", "domain")


def candidate_filter(spark, folder):
    return _cleaned(spark, folder).select("page_id", "domain", "reject_reason")


def candidate_first_per_domain(spark, folder):
    return CA.dedupe_candidates(_cleaned(spark, folder), ["query"], per_page=20).select("query", "page", "pos", "domain")


def candidate_funnel(spark, folder):
    return CA.candidate_funnel(_cleaned(spark, folder))


def candidate_running_totals(spark, folder):
    flagged = _cleaned(spark, folder).withColumn("accepted", F.col("reject_reason").isNull())
    return CA.running_totals(flagged)


def _listed(spark, folder):
    """Hosts that show a German page: a rule table made of the data."""
    pages = text_table(spark, folder, "pages", "page_id").where(F.col("url").contains("/de/"))
    return pages.select(urls.clean_domain(F.col("url")).alias("domain")).distinct()


def candidate_rule_table(spark, folder):
    hits = CA.with_domain(V.hits(spark, folder))
    return CA.drop_listed_domains(hits, _listed(spark, folder)).select("page_id", "domain")


def candidate_seen(spark, folder):
    # Counted first, so that the anti-join meets one row per domain.
    found = CA.with_domain(V.hits(spark, folder)).groupBy("domain").agg(F.count("*").alias("n"))
    return CA.exclude_seen(found, _listed(spark, folder))


def first_source_wins(spark, folder):
    pages = V.hits(spark, folder).withColumn("page", F.call_function("div", F.col("page_id"), F.lit(5)))
    one = pages.where(F.col("url").endswith(".html")).select("query", "page", "url", "title", "content")
    two = pages.where(F.col("url").contains("?")).select(
        "query", "page", "url", "title", F.col("content").alias("description")
    )
    three = pages.where(~F.col("url").endswith(".html") & ~F.col("url").contains("?")).select(
        "query", "page", F.col("url").alias("href"), "title", F.col("content").alias("snippet")
    )
    hits = CA.union_hits(
        CA.normalize_hits(one, "metasearch", 1),
        CA.normalize_hits(two, "api", 2, content="description"),
        CA.normalize_hits(three, "html", 3, url="href", content="snippet"),
    )
    kept = CA.first_nonempty_source(hits)
    return kept.groupBy("query", "page", "provider").agg(F.count("*").alias("n"))


def serp_rows(spark, folder):
    """Page links dressed as redirect links, then read back as result rows."""
    host = F.regexp_extract("url", "://([^/]+)", 1)
    dressed = F.replace(
        F.col("html"),
        F.lit('href="/'),
        F.concat(F.lit('href="//redirect.test/l/?uddg=https%3A%2F%2F'), host, F.lit("%2F")),
    )
    pages = text_table(spark, folder, "pages", "page_id").select("page_id", dressed.alias("html"))
    return RP.parse_result_pages(pages).select("page_id", "pos", "url", "title")


def search_phrases(spark, folder):
    c = V.clients(spark, folder).select("industry", F.col("country").alias("location"))
    return RP.build_phrases(c).select("industry", "location", "phrase")


QUERIES = {
    f.__name__: f
    for f in (
        candidate_domains, candidate_filter, candidate_first_per_domain, candidate_funnel,
        candidate_running_totals, candidate_rule_table, candidate_seen, first_source_wins,
        serp_rows, search_phrases,
    )
}

_LISTED = f"SELECT DISTINCT {V.sql_domain('url')} AS domain FROM pages WHERE contains(url, '/de/')"
FIRST = f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, domain ORDER BY page, pos) AS nth
                 FROM ({V.CANDIDATES}) WHERE reject_reason IS NULL) WHERE nth = 1"""

SQL = {
    "candidate_domains": f"SELECT page_id, domain FROM ({V.HITS})",
    "candidate_filter": f"SELECT page_id, domain, reject_reason FROM ({V.CANDIDATES})",
    "candidate_first_per_domain": f"""
        SELECT query, page, pos, domain FROM (
          SELECT query, page, pos, domain, row_number() OVER (PARTITION BY query, page ORDER BY page, pos) AS k
          FROM ({FIRST})) WHERE k <= 20""",
    "candidate_funnel": f"""
        WITH c AS ({V.CANDIDATES}),
        r AS (SELECT *, row_number() OVER (PARTITION BY domain, reject_reason ORDER BY page, pos) AS k FROM c)
        SELECT CASE WHEN reject_reason IS NOT NULL THEN reject_reason
                    WHEN k = 1 THEN 'kept' ELSE 'repeat' END AS reject_reason, count(*) AS n
        FROM r GROUP BY 1""",
    "candidate_running_totals": f"""
        WITH p AS (SELECT query, page, count(*) AS processed,
                          count(*) FILTER (reject_reason IS NULL) AS qualified
                   FROM ({V.CANDIDATES}) GROUP BY query, page)
        SELECT query, page, processed, qualified,
               CAST(sum(processed) OVER (PARTITION BY query ORDER BY page) AS BIGINT) AS processed_total,
               CAST(sum(qualified) OVER (PARTITION BY query ORDER BY page) AS BIGINT) AS qualified_total
        FROM p""",
    "candidate_rule_table": f"""
        WITH h AS ({V.HITS}), l AS ({_LISTED}),
        bad AS (SELECT DISTINCT h.domain FROM h, l WHERE h.domain = l.domain OR ends_with(h.domain, '.' || l.domain))
        SELECT page_id, domain FROM h WHERE domain NOT IN (SELECT domain FROM bad)""",
    "candidate_seen": f"""
        SELECT domain, count(*) AS n FROM ({V.HITS}) WHERE domain NOT IN ({_LISTED}) GROUP BY domain""",
    "first_source_wins": f"""
        WITH h AS (SELECT query, page_id // 5 AS page,
                     CASE WHEN ends_with(url, '.html') THEN 1 WHEN contains(url, '?') THEN 2 ELSE 3 END AS r
                   FROM ({V.HITS}))
        SELECT query, page, ['metasearch', 'api', 'html'][r] AS provider, count(*) AS n
        FROM (SELECT *, min(r) OVER (PARTITION BY query, page) AS best FROM h) WHERE r = best
        GROUP BY query, page, r""",
    "serp_rows": f"""
        WITH p AS (SELECT page_id, replace(html, 'href="/',
                     'href="//redirect.test/l/?uddg=https%3A%2F%2F' || regexp_extract(url, '://([^/]+)', 1) || '%2F') AS h
                   FROM pages),
        m AS (SELECT page_id, regexp_extract_all(h, '<a[^>]*href="([^"]+)"[^>]*>([\\s\\S]*?)</a>', 1) AS hs,
                     regexp_extract_all(h, '<a[^>]*href="([^"]+)"[^>]*>([\\s\\S]*?)</a>', 2) AS ts FROM p),
        u AS (SELECT page_id, generate_subscripts(hs, 1) - 1 AS pos, unnest(hs) AS href, unnest(ts) AS t FROM m),
        r AS (SELECT page_id, pos,
                url_decode(replace(regexp_extract(href, 'uddg=([^"&\\s]+)', 1), '+', '%2B')) AS url,
                {V.sql_strip("regexp_replace(t, '<[^>]+>', '', 'g')")} AS t FROM u)
        SELECT page_id, CAST(pos AS INTEGER) AS pos, url,
               CASE WHEN t <> '' THEN t ELSE upper(left(split_part({V.sql_domain('url')}, '.', 1), 1)) ||
                    substr(split_part({V.sql_domain('url')}, '.', 1), 2) END AS title
        FROM r WHERE starts_with(url, 'http') AND length(url) > 10""",
    "search_phrases": f"""
        WITH c AS (SELECT DISTINCT industry, country AS location FROM ({V.CLIENTS})),
        t AS (SELECT unnest(['official website', 'corporate site', 'homepage']) AS t)
        SELECT industry, location, industry || ' ' || t || ' in ' || location AS phrase FROM c, t""",
}
