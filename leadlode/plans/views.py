"""The standard tables seen as search hits, clients, e-mail log, leads and events.

Every view exists twice: as a DataFrame and as the SQL text of a sub-query.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlode import rules
from leadlode.functions import text as TX
from leadlode.sources.readers import table, text_table

# Hosts of the test pages lie under example.com, .net and .org.
EXCLUDED = (*rules.STARTER_EXCLUDED_DOMAINS, "spam-farm.example.org", "tiontion.example.com", "example.org")
NO_WORDS = ("noreply", "sentry")
AS_OF = "2001-08-01 12:00:00"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def words_regex(words) -> str:
    return "(" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + ")"


def plain_any_of(patterns) -> str:
    return "(?i)(" + "|".join(patterns) + ")"


def has_word(expr: str, words) -> str:
    return f"regexp_matches({expr}, {q(words_regex(words))})"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def sql_squeeze(expr: str) -> str:
    return sql_strip(f"regexp_replace({expr}, '[\\s\\p{{Z}}]+', ' ', 'g')")


def sql_domain(url: str) -> str:
    return (
        f"regexp_replace(split_part(lower(CASE WHEN starts_with({url}, 'http') THEN "
        f"regexp_extract({url}, '^[a-zA-Z]+://([^/?#]*)', 1) ELSE split_part({url}, '/', 1) END), ':', 1), '^www\\.', '')"
    )


def sql_path(url: str) -> str:
    return f"regexp_extract({url}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"


# ---- search hits ------------------------------------------------------------
def hits(spark: SparkSession, folder: str) -> DataFrame:
    return text_table(spark, folder, "pages", "page_id").select(
        "page_id",
        F.regexp_extract("url", "://[^/]+/([a-z]{2})/", 1).alias("query"),
        F.call_function("div", F.col("page_id"), F.lit(50)).alias("page"),
        (F.col("page_id") % 50).alias("pos"),
        "url",
        TX.html_title(F.col("html")).alias("title"),
        F.lit("").alias("content"),
    )


HITS = f"""
  SELECT page_id, regexp_extract(url, '://[^/]+/([a-z]{{2}})/', 1) AS query, page_id // 50 AS page, page_id % 50 AS pos, url,
         {sql_squeeze("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
         {sql_domain("url")} AS domain
  FROM pages"""


def _under(expr: str, roots) -> str:
    return f"regexp_matches({expr}, {q('(^|[.])' + words_regex(roots) + '$')})"


def sql_reason(excluded) -> str:
    path = f"rtrim(lower({sql_path('url')}), '/')"
    segments = f"len(list_filter(string_split({path}, '/'), lambda s: s <> ''))"
    tlds = [t for t in rules.PLAUSIBLE_TLDS]
    return f"""CASE
      WHEN domain = '' THEN 'no_domain'
      WHEN {_under("domain", excluded)} THEN 'excluded_domain'
      WHEN contains(domain, '.gov') OR contains(domain, '.mil') THEN 'government'
      WHEN {has_word("lower(url)", rules.URL_SKIP_FRAGMENTS)} THEN 'url_pattern'
      WHEN regexp_matches(title, {q(plain_any_of(rules.LISTICLE_PATTERNS))}) THEN 'listicle_title'
      WHEN NOT (NOT regexp_matches(domain, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$')
                AND regexp_matches(domain, '(^|\\.)[^.]{{2,}}\\.[^.]+$')
                AND NOT regexp_matches(domain, '\\.\\d+$')
                AND NOT {_under("domain", rules.PLATFORM_ROOTS)}
                AND (regexp_matches(domain, '\\.\\p{{L}}{{2,6}}$')
                     OR string_split(domain, '.')[-1] IN {in_list(tlds)})) THEN 'implausible_domain'
      WHEN NOT ({path} IN {in_list(rules.LANDING_PATHS)}
                OR (NOT {has_word(path, rules.EDITORIAL_PATH_FRAGMENTS)} AND {segments} <= 2)) THEN 'not_homepage'
    END"""


CANDIDATES = f"SELECT *, {sql_reason(EXCLUDED)} AS reject_reason FROM ({HITS})"


# ---- clients and their e-mail log ------------------------------------------
STATUSES = (
    "Pending", "Qualified", "Contacted", "In Negotiation", "Won", "Cold", "Awaiting Outreach", "Closed Won",
)


def _pick(index: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def trust(balance: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(balance / 100))).cast("int")


def clients(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    key = F.col("c_custkey")
    return c.join(n, "c_nationkey", "left").select(
        key.alias("id"),
        F.col("c_nationkey").alias("company_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("https://c"), key.cast("string"), F.lit(".example.com")).alias("website"),
        F.col("c_mktsegment").alias("industry"),
        F.col("n_name").alias("country"),
        trust(F.col("c_acctbal")).alias("trust_score"),
        _pick(key % len(STATUSES), STATUSES).alias("status"),
        F.when(
            F.col("c_acctbal") > 3000, F.concat(F.lit("desk"), key.cast("string"), F.lit("@mail.example"))
        ).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        F.when(F.col("c_acctbal") > 0, F.lower("c_mktsegment")).alias("relevance_reason"),
        F.date_format(
            F.date_add(F.lit("1995-01-01").cast("date"), (key % 2500).cast("int")), "yyyy-MM-dd'T'00:00:00"
        ).alias("created_at"),
    )


CLIENTS = f"""
  SELECT c_custkey AS id, c_nationkey AS company_id, c_name AS name,
         'https://c' || c_custkey || '.example.com' AS website, c_mktsegment AS industry, n_name AS country,
         CAST(least(100, greatest(0, floor(c_acctbal / 100))) AS INTEGER) AS trust_score,
         [{", ".join(q(s) for s in STATUSES)}][c_custkey % {len(STATUSES)} + 1] AS status,
         CASE WHEN c_acctbal > 3000 THEN 'desk' || c_custkey || '@mail.example' END AS email,
         CASE WHEN c_acctbal > 0 THEN lower(c_mktsegment) END AS relevance_reason,
         strftime(DATE '1995-01-01' + CAST(c_custkey % 2500 AS INTEGER), '%Y-%m-%dT00:00:00') AS created_at
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"""

MAIL_TYPES = ("outreach", "followup", "negotiation", "note")


def mail_log(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as e-mails; the company comes from the client."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return o.join(c, "o_custkey").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("client_id"),
        F.col("c_nationkey").alias("company_id"),
        _pick(F.col("o_orderkey") % 4, MAIL_TYPES).alias("email_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )


MAIL_LOG = f"""
  SELECT o_orderkey AS id, o_custkey AS client_id, c_nationkey AS company_id,
         [{", ".join(q(s) for s in MAIL_TYPES)}][o_orderkey % 4 + 1] AS email_type,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at, o_orderdate AS mailed
  FROM orders JOIN customer ON c_custkey = o_custkey"""


# ---- leads and e-mail events -------------------------------------------------
EVENT_OF = {"view": "email.opened", "click": "email.clicked", "error": "email.bounced"}


def events(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.lit("email.delivered")
    for name, event in EVENT_OF.items():
        kind = F.when(F.col("event_type") == name, event).otherwise(kind)
    return table(spark, folder, "events").select(
        F.col("user_id").alias("lead"), "ts", "event_id", kind.alias("type")
    )


EVENTS = """
  SELECT user_id AS lead, ts, event_id,
         CASE event_type WHEN 'view' THEN 'email.opened' WHEN 'click' THEN 'email.clicked'
              WHEN 'error' THEN 'email.bounced' ELSE 'email.delivered' END AS type,
         CASE event_type WHEN 'view' THEN 20 WHEN 'click' THEN 25 ELSE 0 END AS delta
  FROM events"""


def leads(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as leads: every user without one is an unknown recipient."""
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("lead"),
        F.least(F.lit(60), F.greatest(F.lit(20), trust(F.col("s_acctbal")))).alias("probability_score"),
        F.lit(False).alias("opened"),
        F.lit(False).alias("clicked"),
        (F.col("s_acctbal") < 0).alias("bounced"),
    )


LEADS = """
  SELECT s_suppkey AS lead,
         CAST(least(60, greatest(20, least(100, greatest(0, floor(s_acctbal / 100))))) AS INTEGER) AS start,
         s_acctbal < 0 AS was_bounced
  FROM supplier"""
