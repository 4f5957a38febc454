"""Outreach text: mail merge, draft and reply parsing, recipient choice."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlode import rules
from leadlode.functions.common import or_none, strip, str_array, text_or_empty
from leadlode.functions.text import strip_code_fence, word_count
from leadlode.functions.urls import clean_domain

INITIAL, FOLLOW_UP = rules.INITIAL_MAIL, rules.FOLLOW_UP_MAIL


def fill(template: str, values: dict[str, Column]) -> Column:
    """A ``{slot}`` template as one concat of literals and columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(
        *[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    )


def recipient(primary: Column, saved: Column, website: Column) -> Column:
    """``struct(email, is_guessed)``: found, else saved, else ``contact@domain``."""
    found = F.coalesce(or_none(primary), or_none(saved))
    domain = or_none(clean_domain(text_or_empty(website)))
    return F.struct(
        F.coalesce(found, F.concat(F.lit("contact@"), domain), F.lit("contact@company.com")).alias("email"),
        found.isNull().alias("is_guessed"),
    )


def mail_merge(clients: DataFrame, sender: str, service: str, follow_up: Column | None = None) -> DataFrame:
    """Subject and body for every client; a follow-up where the condition holds."""
    values = {
        "name": text_or_empty(F.col("name")),
        "industry": F.coalesce(or_none(F.col("industry")), F.lit("your industry")),
        "reason": F.coalesce(or_none(F.col("relevance_reason")), F.lit("scaling their operations")),
        "sender": F.lit(sender),
        "service": F.lit(service),
    }

    def text(part):
        first = fill(INITIAL[part], values)
        return first if follow_up is None else F.when(follow_up, fill(FOLLOW_UP[part], values)).otherwise(first)

    to = recipient(F.lit(None).cast("string"), F.col("email"), F.col("website"))
    return clients.select(
        F.col("id").alias("client_id"),
        to["email"].alias("recipient"),
        to["is_guessed"].alias("is_guessed"),
        text("subject").alias("subject"),
        text("body").alias("body"),
    )


def parse_drafts(drafts: DataFrame, text_col: str = "text", default_subject: str = "") -> DataFrame:
    """Split a draft into its last ``Subject:`` line and the remaining body."""
    lines = F.split(text_or_empty(F.col(text_col)), "\n")
    is_subject = lambda l: F.lower(l).startswith("subject:")
    subjects = F.filter(lines, is_subject)
    body = strip(F.array_join(F.filter(lines, lambda l: ~is_subject(l)), "\n"))
    return (
        drafts.withColumn(
            "subject",
            F.coalesce(
                strip(F.regexp_replace(F.get(F.reverse(subjects), 0), "^[^:]*:", "")),
                F.lit(default_subject),
            ),
        )
        .withColumn("body", body)
        .withColumn("n_words", word_count(F.col("body")))
    )


REPLY_FIELDS = ("objection_type", "detected_intent", "strategy_hint", "subject", "body")


def parse_reply(raw: Column, defaults: dict[str, Column]) -> Column:
    """Five reply fields of an answer; text that is no JSON object becomes the body."""
    schema = ", ".join(f"{f} string" for f in REPLY_FIELDS) + ", _bad string"
    p = F.from_json(raw, schema, {"columnNameOfCorruptRecord": "_bad"})
    broken = p.isNull() | p["_bad"].isNotNull()
    return F.struct(
        *[
            F.coalesce(or_none(F.when(~broken, p[f])), raw if f == "body" else defaults[f]).alias(f)
            for f in REPLY_FIELDS
        ]
    )


def parse_suggestions(raw: Column) -> Column:
    """``array<struct(industry, reason)>`` of an answer.

    A JSON list, else the first list inside a JSON object, else objects found by
    pattern in broken JSON.
    """
    t = strip(F.regexp_replace(F.regexp_replace(raw, "(?i)```json", ""), "```", ""))
    item = "array<struct<industry: string, reason: string>>"
    listed = F.from_json(F.when(t.startswith("["), t), item)
    inner = F.from_json(F.when(t.startswith("{"), t), "map<string,string>")
    lists = F.filter(F.map_values(inner), lambda v: strip(v).startswith("["))
    nested = F.from_json(F.get(lists, 0), item)
    shape = r'(?i)\{\s*"industry"\s*:\s*"([^"]+)"\s*,\s*"reason"\s*:\s*"([^"]+)"\s*\}'
    rescued = F.zip_with(
        F.regexp_extract_all(t, F.lit(shape), F.lit(1)),
        F.regexp_extract_all(t, F.lit(shape), F.lit(2)),
        lambda a, b: F.struct(a.alias("industry"), b.alias("reason")),
    )
    is_json = F.try_parse_json(t).isNotNull()
    rows = F.when(is_json, F.coalesce(listed, nested, F.array().cast(item))).otherwise(rescued)
    cleaned = F.transform(
        rows,
        lambda r: F.struct(
            strip(text_or_empty(r["industry"])).alias("industry"),
            strip(text_or_empty(r["reason"])).alias("reason"),
        ),
    )
    return F.filter(cleaned, lambda r: r["industry"] != "")


def industry_tags(raw: Column, limit: int = 6, defaults=rules.DEFAULT_INDUSTRY_TAGS) -> Column:
    """Up to six suggested tags, or the default ones when the answer has no list."""
    p = F.from_json(strip_code_fence(raw), "suggested_industries array<string>")
    tags = p["suggested_industries"]
    clean = F.slice(F.filter(F.transform(tags, strip), lambda t: t != ""), 1, limit)
    return F.when(F.size(tags) > 0, clean).otherwise(str_array(defaults))


def profile_text(services, description, target_customers, industry) -> Column:
    """Fallback profile of a company from the columns it filled in."""

    def first(*cols):
        return F.coalesce(*[or_none(c) for c in cols[:-1]], F.lit(cols[-1]))

    return F.concat(
        F.lit("CORE BUSINESS: "), first(services, description, rules.DEFAULT_SERVICES),
        F.lit("\nIDEAL CUSTOMER PROFILE: "), first(target_customers, "B2B Clients"),
        F.lit("\nVALUE PROPOSITION: High quality solutions in "), first(industry, "B2B"), F.lit("."),
    )


def effective_services(enriched, services, description) -> Column:
    return F.coalesce(
        or_none(enriched), or_none(services), or_none(description), F.lit(rules.DEFAULT_SERVICES)
    )


def outreach_suggestion(email: Column, profile: Column, form_url: Column) -> Column:
    return (
        F.when(
            or_none(email).isNotNull(),
            F.concat(F.lit(rules.EMAIL_HINT[0]), email, F.lit(rules.EMAIL_HINT[1])),
        )
        .when(
            or_none(profile).isNotNull(),
            F.lit(rules.PROFILE_HINT),
        )
        .otherwise(F.concat(F.lit(rules.FORM_HINT[0]), form_url, F.lit(rules.FORM_HINT[1])))
    )
