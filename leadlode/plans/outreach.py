"""Outreach-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlode.functions.urls import website_or_guess
from leadlode.operators import outreach as OU
from leadlode.plans import views as V
from leadlode.sources.readers import table


def mail_merge(spark, folder):
    merged = OU.mail_merge(
        V.clients(spark, folder), "Northwind", "cold storage", follow_up=F.col("status") == "Contacted"
    )
    return merged.select("client_id", "recipient", "is_guessed", "subject", F.md5("body").alias("digest"))


def _talk(spark, folder):
    return table(spark, folder, "conversations")


def draft_parse(spark, folder):
    """Each turn as a draft: a subject line, its text, and for users a second subject."""
    draft = F.concat(
        F.lit("Subject: About "), "role", F.lit("\n"), "text",
        F.when(F.col("role") == "user", F.concat(F.lit("\nSUBJECT:  again: "), F.col("turn").cast("string"))).otherwise(""),
    )
    d = _talk(spark, folder).select("conv_id", "turn", draft.alias("text"))
    return OU.parse_drafts(d).select(
        "conv_id", "turn", "subject", F.col("n_words").cast("bigint").alias("n_words"), F.md5("body").alias("digest")
    )


def reply_fields(spark, folder):
    """Assistant turns answer in JSON, the others in plain text."""
    raw = F.when(
        F.col("role") == "assistant",
        F.to_json(F.struct(F.lit("Price").alias("objection_type"), F.lit("").alias("subject"), F.col("text").alias("body"))),
    ).otherwise(F.concat(F.lit("> "), "text"))
    defaults = {
        "objection_type": F.lit("General Interest"),
        "detected_intent": F.lit("Client responded to outreach."),
        "strategy_hint": F.lit("Offer a pilot."),
        "subject": F.concat(F.lit("Re: "), F.col("conv_id").cast("string")),
    }
    r = OU.parse_reply(F.col("raw"), defaults)
    return _talk(spark, folder).select("conv_id", "turn", raw.alias("raw")).select(
        "conv_id", "turn", r["objection_type"].alias("objection_type"), r["subject"].alias("subject"),
        r["strategy_hint"].alias("strategy_hint"), F.md5(r["body"]).alias("digest"),
    )


def suggestion_rows(spark, folder):
    """Suggestions written as a list, inside an object, or as broken JSON."""
    c = V.clients(spark, folder)
    item = F.struct(F.concat(F.lit(" "), "industry").alias("industry"), F.col("country").alias("reason"))
    listed = F.to_json(F.array(item))
    raw = (
        F.when(F.col("trust_score") < 30, F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
        .when(F.col("trust_score") < 60, F.concat(F.lit('{"note": "x", "list": '), listed, F.lit("}")))
        .otherwise(F.concat(F.lit("Here: "), listed, F.lit(" and")))
    )
    s = c.select("id", F.inline(OU.parse_suggestions(raw)))
    return s.select("id", "industry", "reason")


def outreach_hints(spark, folder):
    """Whom to write to, what to try first, and a guessed site where none is stored."""
    c = V.clients(spark, folder)
    site = F.when(F.col("trust_score") % 2 == 0, F.col("website"))
    guess = website_or_guess(site, F.col("name"))
    profile = F.when(F.col("trust_score") > 40, "https://linkedin.com/company/x")
    return c.select(
        "id", guess["url"].alias("url"), guess["is_guessed"].alias("is_guessed"),
        OU.outreach_suggestion(F.col("email"), profile, guess["url"]).alias("hint"),
    )


def company_profiles(spark, folder):
    c = V.clients(spark, folder)
    services = F.when(F.col("trust_score") > 50, F.lower("industry")).otherwise("")
    text = OU.profile_text(services, F.col("relevance_reason"), F.lit(None).cast("string"), F.col("industry"))
    return c.select(
        "id", text.alias("profile"),
        OU.effective_services(F.lit(""), services, F.col("relevance_reason")).alias("services"),
    )


QUERIES = {f.__name__: f for f in (mail_merge, draft_parse, reply_fields, suggestion_rows, outreach_hints, company_profiles)}


def _filled(template: str) -> str:
    slots = {
        "name": "name", "industry": "industry", "reason": "coalesce(relevance_reason, 'scaling their operations')",
        "sender": "'Northwind'", "service": "'cold storage'",
    }
    text = V.q(template)
    for slot, expr in slots.items():
        text = text.replace("{" + slot + "}", f"' || {expr} || '")
    return text


SQL = {
    "mail_merge": f"""
        SELECT id AS client_id, coalesce(email, 'contact@c' || id || '.example.com') AS recipient, email IS NULL AS is_guessed,
          CASE WHEN status = 'Contacted' THEN {_filled(OU.FOLLOW_UP["subject"])} ELSE {_filled(OU.INITIAL["subject"])} END AS subject,
          md5(CASE WHEN status = 'Contacted' THEN {_filled(OU.FOLLOW_UP["body"])} ELSE {_filled(OU.INITIAL["body"])} END) AS digest
        FROM ({V.CLIENTS})""",
    "draft_parse": f"""
        WITH b AS (SELECT *, {V.sql_strip("text")} AS body FROM conversations)
        SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'again: ' || turn ELSE 'About ' || role END AS subject,
          len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '')) AS n_words, md5(body) AS digest FROM b""",
    "reply_fields": """
        SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'Price' ELSE 'General Interest' END AS objection_type,
          'Re: ' || conv_id AS subject, 'Offer a pilot.' AS strategy_hint,
          md5(CASE role WHEN 'assistant' THEN text ELSE '> ' || text END) AS digest FROM conversations""",
    "outreach_hints": f"""
        WITH g AS (SELECT *, CASE WHEN trust_score % 2 = 0 THEN website ELSE 'https://www.' || lower(replace(name, '#', '')) || '.com' END AS url FROM ({V.CLIENTS}))
        SELECT id, url, trust_score % 2 <> 0 AS is_guessed,
          CASE WHEN email IS NOT NULL THEN 'Primary email (' || email || ') verified. Suggested: Cold Email outreach + LinkedIn connect.'
               WHEN trust_score > 40 THEN 'No public email found. Suggested: LinkedIn Company Outreach & InMail.'
               ELSE 'Contact via website form at ' || url || '.' END AS hint FROM g""",
    "company_profiles": f"""
        WITH g AS (SELECT *, coalesce(CASE WHEN trust_score > 50 THEN lower(industry) END, relevance_reason, 'B2B Products & Services') AS s FROM ({V.CLIENTS}))
        SELECT id, 'CORE BUSINESS: ' || s || chr(10) || 'IDEAL CUSTOMER PROFILE: B2B Clients' || chr(10) ||
          'VALUE PROPOSITION: High quality solutions in ' || industry || '.' AS profile, s AS services FROM g""",
    "suggestion_rows": f"SELECT id, industry, country AS reason FROM ({V.CLIENTS})",
}
