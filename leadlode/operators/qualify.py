"""Qualification: junk rules, verdict rows, acceptance gate, card fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlode import rules
from leadlode.functions import contacts as C
from leadlode.functions import names
from leadlode.functions import text as TX
from leadlode.functions import urls
from leadlode.functions.common import contains_any, distinct_by, let, or_none, strip, text_or_empty


def junk_match(text: Column) -> Column:
    """The directory or listicle phrase found in a text, else NULL."""
    return F.coalesce(
        TX.matched_phrase(text, rules.DIRECTORY_PATTERNS),
        TX.matched_phrase(text, rules.LISTICLE_PATTERNS),
    )


def flag_junk(docs: DataFrame, *parts: str) -> DataFrame:
    """Add ``is_junk`` and ``matched``, looked up in the joined text of ``parts``."""
    joined = F.concat_ws(" ", *[text_or_empty(F.col(p)) for p in (parts or ("text",))])
    return docs.withColumn("matched", junk_match(joined)).withColumn(
        "is_junk", F.col("matched").isNotNull()
    )


def parse_verdict(raw: Column) -> Column:
    """Verdict struct of an answer text; NULL for broken JSON or a missing junk flag."""
    fields = (
        "is_junk string, industry_match string, lead_type string, confidence string,"
        " reason string, official_company_name string, detected_country string, _bad string"
    )
    v = F.from_json(
        TX.strip_code_fence(raw), fields, {"columnNameOfCorruptRecord": "_bad"}
    )
    return F.when(
        v["_bad"].isNull() & v["is_junk"].isNotNull(),
        F.struct(
            (v["is_junk"] == "true").alias("is_junk"),
            F.coalesce(v["industry_match"] == "true", F.lit(False)).alias("industry_match"),
            v["industry_match"].isNull().alias("match_missing"),
            F.upper(strip(text_or_empty(v["lead_type"]))).alias("lead_type"),
            F.coalesce(v["confidence"].try_cast("double").cast("int"), F.lit(0)).alias("confidence"),
            strip(text_or_empty(v["reason"])).alias("reason"),
            strip(text_or_empty(v["official_company_name"])).alias("official_company_name"),
            strip(text_or_empty(v["detected_country"])).alias("detected_country"),
        ),
    )


def targets_software(industry: str, words=rules.SOFTWARE_TARGET_WORDS) -> bool:
    return any(w in industry.lower() for w in words)


def outcome_label(is_junk: Column, industry_match: Column, lead_type: Column) -> Column:
    return (
        F.when(is_junk, "JUNK")
        .when(~industry_match, "INDUSTRY_MISMATCH")
        .when(lead_type.isin(list(rules.LEAD_TYPES)), lead_type)
        .otherwise("UNKNOWN")
    )


def apply_verdicts(
    candidates: DataFrame,
    verdicts: DataFrame,
    target_industry: str,
    key: str = "domain",
    country: str = "",
    min_confidence: int = rules.MIN_CONFIDENCE,
) -> DataFrame:
    """Join candidates with raw verdicts and apply every rule around them.

    ``candidates`` has ``name, snippet, scraped`` beside the key; ``verdicts`` has
    one ``raw_json`` per key.  Order: junk rule, then the verdict with its
    corrections; a candidate with no verdict row is accepted at confidence 75.
    """
    # The texts are scanned before the join, so that only the findings are shuffled.
    text = F.concat_ws(" ", *[text_or_empty(F.col(c)) for c in ("name", "snippet", "scraped")])
    body = F.lower(F.concat_ws(" ", *[text_or_empty(F.col(c)) for c in ("snippet", "scraped")]))
    similar_pattern = rules.any_of(rules.SIMILAR_SERVICE_PATTERNS, "")
    with_software = not targets_software(target_industry)

    def software_in(c):
        return contains_any(c, rules.SOFTWARE_PHRASES) if with_software else F.lit(False)

    # A phrase may begin at the end of the text and end in the reason.  The leading
    # letter keeps a cut word from looking like a whole one.
    reach = max(len(p) for p in (*rules.SIMILAR_SERVICE_PATTERNS, *rules.SOFTWARE_PHRASES))
    tail = F.concat(F.when(F.length("_body") > reach, "x").otherwise(""), F.right("_body", F.lit(reach)))
    scanned = (
        candidates.withColumn("junk_phrase", junk_match(text))
        .withColumn("_body", F.when(F.col("junk_phrase").isNull(), body).otherwise(""))
        .withColumns(
            {
                "_software": software_in(F.col("_body")),
                "_similar": F.col("_body").rlike(similar_pattern),
                "_tail": tail,
            }
        )
        .drop("_body")
    )
    answered = text_or_empty(F.col("raw_json")) != ""
    v = F.col("v")
    joined = scanned.join(verdicts.select(key, "raw_json"), key, "left").withColumn(
        "v", F.when(answered, parse_verdict(F.col("raw_json")))
    )
    said = F.concat(F.col("_tail"), F.lit(" "), F.lower(text_or_empty(v["reason"])))
    d = joined.withColumn("_said", said).withColumns(
        {
            "software": F.col("_software") | software_in(F.col("_said")),
            "similar": F.col("_similar") | F.col("_said").rlike(similar_pattern),
        }
    )
    software, similar = F.col("software"), F.col("similar")
    by_rule = F.col("junk_phrase").isNotNull()
    believed = v["industry_match"] | v["match_missing"]
    lead_type = (
        F.when(similar, "HAS_SIMILAR_SERVICE")
        .when(v["lead_type"].isin(list(rules.LEAD_TYPES)), v["lead_type"])
        .otherwise(F.when(believed, "NEEDS_SERVICE").otherwise(""))
    )
    unsure = (v["confidence"] < min_confidence) & ~v["is_junk"]

    def ruled(no_answer, mismatch, verdict):
        """Pick by stage (callers put the junk rule first); NULL for a broken answer."""
        return (
            F.when(~answered, no_answer)
            .when(v.isNotNull() & software, mismatch)
            .when(v.isNotNull(), verdict)
        )

    d = d.select(
        *[c for c in candidates.columns],
        "junk_phrase",
        (by_rule | ~answered | v.isNotNull()).alias("evaluated"),
        F.when(by_rule, True)
        .otherwise(ruled(F.lit(False), v["is_junk"], v["is_junk"]))
        .alias("is_junk"),
        F.when(by_rule, False)
        .otherwise(ruled(F.lit(True), F.lit(False), v["industry_match"] & ~unsure))
        .alias("industry_match"),
        F.when(by_rule, "")
        .otherwise(
            ruled(F.lit("NEEDS_SERVICE"), F.lit(""), F.when(unsure, "").otherwise(lead_type))
        )
        .alias("lead_type"),
        F.when(by_rule, 0)
        .otherwise(ruled(F.lit(75), F.lit(0), v["confidence"]))
        .alias("confidence"),
        F.when(
            by_rule,
            F.concat(F.lit(rules.JUNK_REASON[0]), F.col("junk_phrase"), F.lit(rules.JUNK_REASON[1])),
        )
        .otherwise(
            ruled(
                F.concat(
                    F.lit(rules.UNANSWERED_REASON.format(industry=target_industry)),
                    F.col(key).cast("string"), F.lit(")"),
                ),
                F.lit(rules.SOFTWARE_REASON.format(industry=target_industry)),
                v["reason"],
            )
        )
        .alias("reason"),
        ruled(F.col("name"), v["official_company_name"], v["official_company_name"]).alias(
            "official_company_name"
        ),
        ruled(
            F.lit(country or "Global"), v["detected_country"], v["detected_country"]
        ).alias("detected_country"),
        F.when(by_rule, "rule-engine")
        .when(~answered, "local-fallback")
        .otherwise("verdict")
        .alias("verdict_source"),
    )
    return d.withColumn(
        "outcome",
        F.when(
            F.col("evaluated"),
            outcome_label(F.col("is_junk"), F.col("industry_match"), F.col("lead_type")),
        ).otherwise("UNKNOWN"),
    )


def accepted(evaluated: DataFrame, min_confidence: int = rules.MIN_CONFIDENCE) -> DataFrame:
    """The acceptance gate."""
    return evaluated.where(
        F.col("evaluated")
        & ~F.col("is_junk")
        & F.col("industry_match")
        & (F.col("confidence") >= min_confidence)
        & F.col("lead_type").isin(list(rules.LEAD_TYPES))
    )


def card_snippet(
    snippet: Column, reason: Column, name: Column, industry: Column,
    titles=rules.EXECUTIVE_TITLES, limit: int = 280,
) -> Column:
    """Card text: the snippet, replaced by the reason when it is a bio or too short."""
    why = F.substring(text_or_empty(reason), 1, limit)

    def instead(sentence):
        return F.coalesce(or_none(why), F.concat(name, F.lit(sentence[0]), industry, F.lit(sentence[1])))

    cut = F.substring(text_or_empty(snippet), 1, limit)
    no_bio = F.when(
        cut.rlike(r"(?i)\b(?:" + "|".join(titles) + r")\b"),
        instead(rules.BIO_CARD),
    ).otherwise(cut)
    return F.when(
        F.length(no_bio) < 25, instead(rules.SHORT_CARD)
    ).otherwise(no_bio)


def card_contacts(evidence: Column, title: Column, snippet: Column) -> Column:
    """Contacts of a card, mined from the evidence text, else from title and snippet.

    ``struct(email, phone, phones, emails, linkedin, context)``: the first valid address, phone number and
    profile, all addresses and numbers, and the text around the first address.
    """
    text = F.coalesce(or_none(strip(evidence)), F.concat_ws(" ", text_or_empty(title), text_or_empty(snippet)))

    def of(text):
        sighted = F.filter(C.sighted_emails(text), lambda e: C.is_valid_email(e["email"]))
        return F.struct(
            distinct_by(sighted, lambda e: F.lower(e["email"])).alias("emails"),
            C.find_phones(text).alias("phones"),
            C.find_profiles(text)["best"].alias("linkedin"),
        )

    return let(
        let(text, of),
        lambda m: F.struct(
            F.get(m["emails"], 0)["email"].alias("email"),
            F.get(m["phones"], 0).alias("phone"),
            m["phones"].alias("phones"),
            F.transform(m["emails"], lambda e: e["email"]).alias("emails"),
            m["linkedin"].alias("linkedin"),
            F.get(m["emails"], 0)["context"].alias("context"),
        ),
    )


def company_cards(
    qualified: DataFrame, industry: str, country: str = "", city: str = "",
    overrides: dict[str, str] | None = None, evidence: str | None = None,
) -> DataFrame:
    """Accepted candidates as the cards a reader sees.

    With ``evidence``, the column of the text gathered about a candidate, cards have their contacts:
    ``email, phone, phones, emails, linkedin`` and ``contactSource``, the page they were found on.
    """
    contacts = {}
    if evidence is not None:
        qualified = qualified.withColumn("_found", card_contacts(F.col(evidence), F.col("title"), F.col("snippet")))
        page = urls.page_name(F.col("url"))
        source = F.struct(F.col("url"), page.alias("page"), page.alias("label"), F.col("_found.context").alias("context"))
        contacts = {c: F.col(f"_found.{c}") for c in ("email", "phone", "phones", "emails", "linkedin")}
        contacts["contactSource"] = F.when(F.col("_found.email").isNotNull(), source)
    name = names.resolve_name(F.col("official_company_name"), F.col("title"), F.col("domain"), overrides)
    return qualified.withColumn("name", name).select(
        F.lit("company").alias("type"),
        "name",
        F.col("url").alias("website"),
        F.col("domain").alias("displayUrl"),
        "domain",
        F.lit(industry).alias("industry"),
        names.resolve_country(F.col("detected_country"), F.lit(country)).alias("country"),
        F.lit(city).alias("city"),
        card_snippet(F.col("snippet"), F.col("reason"), F.col("name"), F.lit(industry)).alias("snippet"),
        F.coalesce(or_none(F.col("reason")), F.lit(f"Authentic prospect in {industry}.")).alias("matchReason"),
        F.col("confidence").alias("matchConfidence"),
        F.col("confidence").alias("trustScore"),
        F.lit("Verified Company").alias("trustStatus"),
        F.lower("lead_type").alias("leadType"),
        F.col("verdict_source").alias("source"),
        *[v.alias(c) for c, v in contacts.items()],
        *[c for c in ("query", "page", "pos") if c in qualified.columns],
    )


def passes_reader_gate(min_trust: float) -> Column:
    """Confidence, else trust score, reaches the reader's minimum."""
    return F.coalesce(F.col("matchConfidence"), F.col("trustScore"), F.lit(0)) >= min_trust


def reviewed_and_scored() -> Column:
    """Gate of the whole-list form: not pending review, and some score."""
    return ~F.col("trustStatus").eqNullSafe("Pending Review") & passes_reader_gate(1e-9)


def resolve_company_name(
    candidates: DataFrame, id_col: str = "page_id", overrides: dict[str, str] | None = None
) -> DataFrame:
    """``id, name`` from the page title and the domain."""
    verdict_name = (
        F.col("official_company_name") if "official_company_name" in candidates.columns else F.lit("")
    )
    return candidates.select(
        id_col,
        names.resolve_name(verdict_name, F.col("title"), F.col("domain"), overrides).alias("name"),
    )


def apply_batch_fn(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Hook for a user's own classifier or drafter over Arrow batches."""
    return df.mapInPandas(fn, schema)
