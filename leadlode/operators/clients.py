"""Client views: scans, lookups, search, bands, export rows, contact overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlode import rules, schemas
from leadlode.functions.common import or_none, strip, text_or_empty


def scan(
    df: DataFrame,
    order: str | None = None,
    **equal,
) -> DataFrame:
    """Rows with the given column values (``None`` means any), newest first."""
    for column, value in equal.items():
        if value is not None and value != "":
            df = df.where(F.col(column) == value)
    return df if order is None else df.orderBy(F.col(order).desc())


def lookup(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Point lookups as one job: the rows whose key is wanted."""
    return df.join(keys.select(*([on] if isinstance(on, str) else on)).distinct(), on, "left_semi")


def client_by_id(clients: DataFrame, keys: DataFrame, allow_cross_tenant: bool = False) -> DataFrame:
    """Clients by id inside their company; the unscoped fall-back is off by default."""
    strict = lookup(clients, keys, ["id", "company_id"])
    if not allow_cross_tenant:
        return strict
    missing = keys.join(clients, ["id", "company_id"], "left_anti")
    return strict.unionByName(lookup(clients, missing, "id"))


def search_clients(
    clients: DataFrame,
    q: str = "",
    status: str | None = None,
    industry: str | None = None,
    min_score: int = 0,
) -> DataFrame:
    """Free text over name, industry and country plus the three list filters."""
    if q:
        hit = F.lit(False)
        for c in ("name", "industry", "country"):
            hit = hit | F.lower(text_or_empty(F.col(c))).contains(q.lower())
        clients = clients.where(hit)
    if status:
        clients = clients.where(F.col("status") == status)
    if industry:
        clients = clients.where(F.lower(text_or_empty(F.col("industry"))).contains(industry.lower()))
    return clients.where(F.coalesce(F.col("trust_score"), F.lit(0)) >= min_score)


def band_of(score: Column, cuts=rules.INTENT_BANDS, lowest: str = "Low Intent") -> Column:
    """Name of the first cut-off the score reaches (cut-offs from high to low)."""
    band = F.lit(lowest)
    for floor, name in reversed(cuts):
        band = F.when(score >= floor, name).otherwise(band)
    return band


def band_scores(clients: DataFrame, cuts=rules.INTENT_BANDS, lowest: str = "Low Intent") -> DataFrame:
    return clients.groupBy(band_of(F.col("trust_score"), cuts, lowest).alias("band")).agg(
        F.count("*").alias("n")
    )


CLIENT_EXPORT = (
    ("Client Name", "name", False), ("Website", "website", False), ("Industry", "industry", False),
    ("Country", "country", False), ("Trust Score (%)", "trust_score", False), ("Status", "status", False),
    ("Email", "email", True), ("Phone", "phone", True),
    ("Relevance Reason", "relevance_reason", True), ("Created At", "created_at", False),
)
CARD_EXPORT = (
    ("Company Name", "name", False), ("Website", "website", False), ("Domain", "domain", False),
    ("Industry", "industry", False), ("Country", "country", False),
    ("AI Fit Score (%)", "trustScore", False), ("Trust Status", "trustStatus", False),
    ("Email", "email", True), ("Phone", "phone", True), ("LinkedIn", "linkedin", True),
    ("Contact Source Page", "contactSource.page", True),
    ("Source Context", "contactSource.context", True), ("Summary", "snippet", False),
)


def export_projection(df: DataFrame, layout=CLIENT_EXPORT) -> DataFrame:
    """Text columns of an export: '' for NULL, or N/A in the contact columns."""
    return df.select(
        *[
            (
                F.coalesce(or_none(F.col(source).cast("string")), F.lit("N/A"))
                if contact
                else text_or_empty(F.col(source).cast("string"))
            ).alias(title)
            for title, source, contact in layout
        ]
    )


def stage2_overlay(clients: DataFrame) -> DataFrame:
    """Contacts of each client: the deep-crawl JSON over the base columns."""
    ctx = F.col("contact_source_context")
    is_object = ctx.startswith("{") & F.try_parse_json(ctx).isNotNull()
    deep = F.from_json(F.when(is_object, ctx), schemas.CONTACT_BUNDLE)
    d = clients.withColumn("_deep", deep)
    has = F.col("_deep.all_emails").isNotNull()
    base_phones = F.filter(
        F.transform(F.split(text_or_empty(F.col("phones")), ","), strip), lambda p: p != ""
    )
    one_phone = F.array_compact(F.array(or_none(F.col("phone"))))
    empty = F.array().cast("array<string>")
    phones = F.when(has & (F.size(F.col("_deep.phones")) > 0), F.col("_deep.phones")).otherwise(
        F.when(F.size(base_phones) > 0, base_phones).otherwise(F.when(has, empty).otherwise(one_phone))
    )
    site = or_none(F.regexp_replace(text_or_empty(F.col("website")), "/+$", ""))
    d = d.select(
        *clients.columns,
        F.coalesce(or_none(F.get(F.col("_deep.all_emails"), 0)), or_none(F.col("email"))).alias("primary_email"),
        phones.alias("phone_list"),
        F.coalesce(or_none(F.col("_deep.linkedin_company")), or_none(F.col("linkedin_company"))).alias("company_profile"),
        F.coalesce(F.col("_deep.linkedin_people"), empty).alias("people_profiles"),
        F.coalesce(
            or_none(F.col("_deep.contact_page_url")),
            or_none(F.col("contact_source_url")),
            F.concat(site, F.lit("/contact-us")),
        ).alias("contact_page_url"),
        F.when(has, F.coalesce(F.col("_deep.source_label"), F.lit("Stage 2 Deep Crawl")))
        .otherwise(F.coalesce(or_none(F.col("contact_source_label")), F.lit("Stage 1 (fast crawl)")))
        .alias("source_label"),
    )
    return d.withColumn(
        "found",
        F.col("primary_email").isNotNull()
        | (F.size("phone_list") > 0)
        | F.col("company_profile").isNotNull()
        | (F.size("people_profiles") > 0),
    )


def overlay_enrichment(cards: DataFrame, enriched: DataFrame, key: str = "domain") -> DataFrame:
    """Fresh contacts over a card; what is empty keeps the card's own value."""
    first_of_all = (
        [or_none(F.get("all_emails", 0))] if "all_emails" in enriched.columns else []
    )
    e = enriched.select(
        key,
        F.coalesce(or_none(F.col("primary_email")), *first_of_all).alias("_email"),
        F.get("phones", 0).alias("_phone"),
        F.col("linkedin_company").alias("_linkedin"),
        F.col("contact_page_url").alias("_url"),
        F.col("source_label").alias("_label"),
        F.col("source_context").alias("_context"),
        F.lit(True).alias("enriched"),
    )
    fresh = {"email": "_email", "phone": "_phone", "linkedin": "_linkedin"}
    source = F.when(
        or_none(F.col("_url")).isNotNull(),
        F.struct(
            F.col("_url").alias("url"),
            F.lit(None).cast("string").alias("page"),
            F.coalesce(or_none(F.col("_label")), F.lit("Contact Page")).alias("label"),
            F.col("_context").alias("context"),
        ),
    )
    old_source = F.col("contactSource") if "contactSource" in cards.columns else F.lit(None)
    return (
        cards.join(e, key, "left")
        .withColumns({c: F.coalesce(or_none(F.col(n)), F.col(c)) for c, n in fresh.items()})
        .withColumn("contactSource", F.coalesce(source, old_source))
        .withColumn("enriched", F.coalesce("enriched", F.lit(False)))
        .select(*dict.fromkeys([*cards.columns, "contactSource", "enriched"]))
    )


def country_cities(countries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cities of the wanted countries, names compared without case."""
    flat = countries.select(F.lower("country").alias("_key"), "country", "code", F.explode_outer("cities").alias("city"))
    return flat.join(wanted.select(F.lower("country").alias("_key")).distinct(), "_key", "left_semi").drop("_key")
