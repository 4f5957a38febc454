"""Contact mining over crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlode import rules
from leadlode.functions import contacts as C
from leadlode.functions import text as TX
from leadlode.functions import urls
from leadlode.functions.common import distinct_by, or_none, text_or_empty


def extract_emails(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    blocked_words=rules.BLOCKED_EMAIL_WORDS,
    asset_extensions=rules.ASSET_EXTENSIONS,
) -> DataFrame:
    """``id, pos, email, context``: valid addresses per document, first spelling of each.

    ``context`` is the text around the first place that holds exactly this address.
    """
    found = F.filter(
        C.sighted_emails(text_or_empty(F.col(text_col))),
        lambda e: C.is_valid_email(e["email"], blocked_words, asset_extensions),
    )
    first = distinct_by(found, lambda e: F.lower(e["email"]))
    return docs.select(id_col, F.posexplode(first).alias("pos", "e")).select(id_col, "pos", "e.email", "e.context")


def extract_phones(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.posexplode(C.find_phones(F.col(text_col))).alias("pos", "phone"))


def mine_pages(
    pages: DataFrame,
    blocked_words=rules.BLOCKED_EMAIL_WORDS,
    asset_extensions=rules.ASSET_EXTENSIONS,
) -> DataFrame:
    """Page rows with their contacts: ``site, url, page_id, emails, headed, phones, ...``.

    ``headed`` has the addresses below a heading; it costs nothing unless selected.
    """
    html = text_or_empty(F.col("html"))
    return (
        pages.select(
            "page_id", "url", urls.clean_domain(F.col("url")).alias("site"), html.alias("html")
        )
        .withColumn("text", TX.html_text(F.col("html")))
        .select(
            "page_id",
            "url",
            "site",
            C.page_emails(F.col("text"), F.col("html"), blocked_words, asset_extensions).alias("emails"),
            C.headed_emails(F.col("html"), blocked_words, asset_extensions).alias("headed"),
            C.find_phones(F.col("text")).alias("phones"),
            C.find_profiles(F.col("html")).alias("profiles"),
            TX.has_contact_section(F.col("text")).alias("has_contact_section"),
        )
    )


def contact_values(mined: DataFrame, headings: bool = False) -> DataFrame:
    """One row per contact and page: ``site, kind, value, key, context, url, page_id, pos``.

    Every page also gives a ``page`` row, and a ``section`` row when it shows a contact section, so that
    one pass over the pages answers for a whole site.  With ``headings`` there is a ``heading`` row for
    each place where an address stands below a heading, the heading as its value.  All of it comes from
    arrays that were built in one pass over the page: the work grows with its length, not with its
    length times its addresses.
    """

    def of_kind(kind, values, value=lambda v: v, key=lambda v: v, context=lambda v: F.lit(None).cast("string")):
        return F.transform(
            values,
            lambda v, i: F.struct(
                F.lit(kind).alias("kind"),
                value(v).alias("value"),
                key(v).alias("key"),
                i.alias("pos"),
                context(v).alias("context"),
            ),
        )

    blank = F.array(F.lit(""))
    address = lambda v: F.lower(v["email"])
    rows = [
        of_kind("page", blank),
        of_kind("section", F.when(F.col("has_contact_section"), blank).otherwise(F.slice(blank, 1, 0))),
        of_kind("email", F.col("emails"), lambda v: v["email"], address, lambda v: v["context"]),
        of_kind("phone", F.col("phones")),
        of_kind("company_profile", F.array_compact(F.array(F.col("profiles.company")))),
        of_kind("people_profile", F.col("profiles.people")),
    ]
    if headings:
        rows.append(of_kind("heading", F.col("headed"), lambda v: v["heading"], address))
    return mined.select("site", "url", "page_id", F.inline(F.concat(*rows)))


def distinct_contacts(values: DataFrame) -> DataFrame:
    """First sight of each contact on a site, with its number of source pages."""
    sight = F.struct("page_id", "pos")
    return values.groupBy("site", "kind", "key").agg(
        F.min_by("value", sight).alias("value"),
        F.min_by("url", sight).alias("source_url"),
        F.min_by("context", sight).alias("context"),
        F.min(sight).alias("first_seen"),
        F.count("*").alias("n_sources"),
    )


def email_sources(values: DataFrame) -> DataFrame:
    """``site, email, url, page, label, page_id, pos``: a row for each page an address was found on.

    ``label`` is the first heading that the address stands below, else the name of the page; it needs the
    ``heading`` rows of ``contact_values``.  A page that was crawled several times counts once, with its
    first sight; ``page_id, pos`` give the order.  Nothing is gathered per address, so one on millions of
    pages is as many rows.  ``values`` is read twice; pass a written table, not a pending mining job.
    """
    seen = values.where(F.col("kind").isin("email", "heading"))
    is_email = F.col("kind") == "email"
    sight = F.struct("page_id", "pos")
    spelled = seen.where(is_email).groupBy("site", "key").agg(F.min_by("value", sight).alias("email"))
    per_page = (
        seen.groupBy("site", "key", "url")
        .agg(F.min(F.when(is_email, sight)).alias("first"), F.min_by("value", F.when(~is_email, sight)).alias("heading"))
        .where(F.col("first").isNotNull())
    )
    page = urls.page_name(F.col("url"))
    return per_page.join(spelled, ["site", "key"]).select(
        "site", "email", "url", page.alias("page"), F.coalesce("heading", page).alias("label"), "first.page_id", "first.pos"
    )


def contact_bundle(pages: DataFrame, **options) -> DataFrame:
    """One row per site: primary contacts, counts and where they were found."""
    found = distinct_contacts(contact_values(mine_pages(pages, **options)))
    kind = F.col("kind")

    def first(column, wanted):
        return F.min_by(column, F.when(kind == wanted, F.col("first_seen")))

    per_site = found.groupBy("site").agg(
        F.max(F.when(kind == "page", F.col("n_sources"))).alias("n_pages"),
        F.max(kind == "section").alias("has_contact_section"),
        F.count_if(kind == "email").alias("n_emails"),
        F.count_if(kind == "phone").alias("n_phones"),
        F.count_if(kind.isin("company_profile", "people_profile")).alias("n_profiles"),
        first("value", "email").alias("primary_email"),
        first("value", "phone").alias("primary_phone"),
        first("value", "company_profile").alias("company_profile"),
        first("value", "people_profile").alias("people_profile"),
        first("source_url", "email").alias("email_url"),
        first("context", "email").alias("email_context"),
    )
    usual_page = F.concat(F.lit("https://"), F.col("site"), F.lit("/contact-us"))
    return per_site.select(
        "site",
        "n_pages",
        "n_emails",
        "n_phones",
        "n_profiles",
        "primary_email",
        "primary_phone",
        F.coalesce("company_profile", "people_profile").alias("profile"),
        F.coalesce("email_url", usual_page).alias("contact_url"),
        F.when(F.col("primary_email").isNotNull(), urls.page_name(F.col("email_url")))
        .when(F.col("has_contact_section"), rules.SECTION_LABEL)
        .otherwise(rules.NOTHING_LABEL)
        .alias("source_label"),
        F.when(F.col("primary_email").isNotNull(), F.col("email_context"))
        .when(
            F.col("has_contact_section"),
            rules.SECTION_CONTEXT,
        )
        .otherwise(rules.NO_CONTEXT)
        .alias("source_context"),
        (F.col("n_emails") + F.col("n_phones") + F.col("n_profiles") > 0).alias("found"),
    )


def mask_contacts(df: DataFrame, email: str = "email", phone: str | None = None) -> DataFrame:
    """Hide the personal part of addresses and numbers for wider sharing."""
    df = df.withColumn(email, C.mask_email(F.col(email)))
    return df if phone is None else df.withColumn(phone, C.mask_phone(F.col(phone)))


def pick_external_contact(contacts: DataFrame, keys=("domain",), pos: str = "pos") -> DataFrame:
    """Best contact of an outside provider: confidence, +10 when a position is known."""
    score = F.coalesce(F.col("confidence"), F.lit(0)) + F.when(
        or_none(text_or_empty(F.col("position"))).isNotNull(), 10
    ).otherwise(0)
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(pos))
    return (
        contacts.withColumn("score", score)
        .withColumn("rnk", F.row_number().over(w))
        .where(F.col("rnk") == 1)
        .drop("rnk")
    )


def fill_from_external(
    bundles: DataFrame, external: DataFrame, label: str = "External contact data"
) -> DataFrame:
    """Use an outside contact (``site, email``) where a site showed none; of several the first in letter order."""
    given = external.groupBy("site").agg(F.min(or_none(F.col("email"))).alias("_given"))
    use = F.col("primary_email").isNull() & F.col("_given").isNotNull()
    return (
        bundles.join(given, "site", "left")
        .withColumn("source_label", F.when(use, label).otherwise(F.col("source_label")))
        .withColumn("n_emails", F.col("n_emails") + F.when(use, 1).otherwise(0))
        .withColumn("found", F.col("found") | use)
        .withColumn("primary_email", F.coalesce("primary_email", "_given"))
        .drop("_given")
    )


def attach_email_meta(emails: DataFrame, meta: DataFrame, pos: str = "pos") -> DataFrame:
    """Left-join each address to its first metadata row, ignoring case."""
    w = Window.partitionBy("_key").orderBy(pos)
    first = (
        meta.withColumn("_key", F.lower("email"))
        .withColumn("_nth", F.row_number().over(w))
        .where(F.col("_nth") == 1)
        .drop("_nth", "email", pos)
    )
    return emails.withColumn("_key", F.lower("email")).join(first, "_key", "left").drop("_key")
