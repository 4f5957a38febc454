"""Candidate cleaning: search hits -> rule filters -> one row per domain -> top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlode import rules
from leadlode.functions import text, urls
from leadlode.functions.common import text_or_empty
from leadlode.operators.ordered import running_sums


def normalize_hits(
    hits: DataFrame,
    provider: str,
    rank: int,
    url: str = "url",
    title: str = "title",
    content: str = "content",
) -> DataFrame:
    """Bring one provider's hits to ``url, title, content`` + provider columns."""
    keep = [c for c in hits.columns if c not in {url, title, content, "provider", "provider_rank"}]
    return hits.select(
        *keep,
        F.col(url).alias("url"),
        text_or_empty(F.col(title)).alias("title"),
        text_or_empty(F.col(content)).alias("content"),
        F.lit(provider).alias("provider"),
        F.lit(rank).alias("provider_rank"),
    )


def union_hits(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def first_nonempty_source(hits: DataFrame, keys=("query", "page")) -> DataFrame:
    """Per result page keep the hits of the best-ranked provider that had any."""
    best = hits.groupBy(*keys).agg(F.min("provider_rank").alias("provider_rank"))
    return hits.join(best, [*keys, "provider_rank"], "left_semi")


def with_domain(hits: DataFrame) -> DataFrame:
    return hits.withColumn("domain", urls.clean_domain(F.col("url")))


def domains_under(domains: DataFrame, rule_domains: DataFrame) -> DataFrame:
    """Distinct ``domain`` values that equal a rule domain or lie below one.

    For rule tables too large to fold into the plan: the suffix test becomes an
    equi-join on every parent of each distinct domain.
    """
    parents = domains.select("domain").distinct().select(
        "domain", F.explode(urls.parent_suffixes(F.col("domain"))).alias("suffix")
    )
    listed = rule_domains.select(F.col("domain").alias("suffix")).distinct()
    return parents.join(listed, "suffix", "left_semi").select("domain").distinct()


def drop_listed_domains(hits: DataFrame, rule_domains: DataFrame) -> DataFrame:
    """Remove hits whose domain is under one of a table of domains."""
    return hits.join(domains_under(hits, rule_domains), "domain", "left_anti")


def exclude_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Remove candidates whose domain was handled in an earlier run."""
    return candidates.join(seen.select("domain"), "domain", "left_anti")


def reject_reason(
    url: Column,
    title: Column,
    domain: Column,
    excluded=rules.STARTER_EXCLUDED_DOMAINS,
    url_fragments=rules.URL_SKIP_FRAGMENTS,
    title_patterns=rules.LISTICLE_PATTERNS,
    strict_government: bool = False,
) -> Column:
    """Name of the first rule that rejects a hit; NULL when it passes them all."""
    return (
        F.when(domain == "", "no_domain")
        .when(urls.under_any(domain, excluded), "excluded_domain")
        .when(urls.is_government(domain, strict_government), "government")
        .when(urls.has_skip_fragment(url, url_fragments), "url_pattern")
        .when(text.matches(text_or_empty(title), title_patterns), "listicle_title")
        .when(~urls.is_plausible_domain(domain), "implausible_domain")
        .when(~urls.is_homepage_like(url), "not_homepage")
    )


def filter_candidates(hits: DataFrame, **rule_options) -> DataFrame:
    """Add ``domain`` and ``reject_reason`` to every hit."""
    return with_domain(hits).withColumn(
        "reject_reason",
        reject_reason(F.col("url"), F.col("title"), F.col("domain"), **rule_options),
    )


def passed(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("reject_reason").isNull())


def dedupe_candidates(
    candidates: DataFrame, run_cols, per_page: int | None = None, order=("page", "pos")
) -> DataFrame:
    """First passing hit per domain of a run, then the first ``per_page`` of each page if asked for.

    ``run_cols`` names what is one run (a query, a request): domains seen and pages are counted inside it.

    Both ranks are filtered by a constant, so Spark limits every group on the map
    side: a domain with a third of all hits ships one row per map task.
    """
    run_cols = list(run_cols)
    first = Window.partitionBy(*run_cols, "domain").orderBy(*order)
    kept = (
        passed(candidates)
        .withColumn("_nth", F.row_number().over(first))
        .where(F.col("_nth") == 1)
        .drop("_nth")
    )
    if per_page is None:
        return kept
    on_page = Window.partitionBy(*run_cols, "page").orderBy(*order)
    return (
        kept.withColumn("_nth", F.row_number().over(on_page))
        .where(F.col("_nth") <= per_page)
        .drop("_nth")
    )


def candidate_funnel(candidates: DataFrame) -> DataFrame:
    """How many hits each rule removed, how many were repeats, how many are left."""
    per_domain = candidates.groupBy("reject_reason", "domain").agg(F.count("*").alias("n"))
    is_passed = F.col("reject_reason").isNull()
    outcome = F.array(
        F.struct(
            F.coalesce("reject_reason", F.lit("kept")).alias("reject_reason"),
            F.when(is_passed, F.lit(1).cast("bigint")).otherwise(F.col("n")).alias("n"),
        ),
        F.struct(
            F.lit("repeat").alias("reject_reason"),
            F.when(is_passed, F.col("n") - 1).otherwise(F.lit(0).cast("bigint")).alias("n"),
        ),
    )
    return (
        per_domain.select(F.inline(outcome))
        .where(F.col("n") > 0)
        .groupBy("reject_reason")
        .agg(F.sum("n").alias("n"))
    )


def running_totals(candidates: DataFrame, run_cols=("query",), accepted: str = "accepted") -> DataFrame:
    """Accepted and processed counts per page with totals up to that page."""
    run_cols = list(run_cols)
    per_page = candidates.groupBy(*run_cols, "page").agg(
        F.count("*").alias("processed"), F.count_if(F.col(accepted)).alias("qualified")
    )
    return running_sums(
        per_page, run_cols, "page", {"processed": "processed_total", "qualified": "qualified_total"}
    )


def take_target(
    leads: DataFrame, n: int = 10, run_cols=("query",), order=("page", "pos")
) -> DataFrame:
    """The first ``n`` accepted leads of every run, in page order."""
    w = Window.partitionBy(*run_cols).orderBy(*order)
    return leads.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= n)
