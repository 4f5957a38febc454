"""Client-table queries: labels, upserts, lookups, search, export, overlays."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadlode.operators import clients as CL
from leadlode.operators import crm
from leadlode.operators import leads as LE
from leadlode.plans import views as V
from leadlode.plans.board import LABELS
from leadlode.session import checkpoint_dir
from leadlode.sources.readers import table
from leadlode.sources.versions import VersionedTable


def email_labels(spark, folder):
    return crm.label_emails(V.mail_log(spark, folder)).select("id", "label")


def email_labels_continued(spark, folder):
    """The mails from 1998 on, labelled after the older log of the same clients."""
    log = V.mail_log(spark, folder)
    older = log.where(F.col("created_at") < "1998")
    newer = log.where(F.col("created_at") >= "1998")
    now = F.lit(V.AS_OF).cast("timestamp_ntz")
    return crm.append_history(older, newer, now).select("id", "label", "status")


def _incoming(spark, folder):
    """Saves to the client table: every order re-saves its client, every supplier is new."""
    o = table(spark, folder, "orders")
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_name")
    again = o.join(c, "o_custkey").select(
        F.col("c_nationkey").alias("company_id"),
        F.upper("c_name").alias("name"),
        F.lit(None).cast("string").alias("website"),
        F.when(F.col("o_orderstatus") == "F", "Won").when(F.col("o_orderstatus") == "O", "Contacted").alias("status"),
        F.when(
            F.col("o_orderpriority") == "1-URGENT", F.least(F.lit(100), F.floor(F.col("o_totalprice") / 5000))
        ).cast("int").alias("trust_score"),
        (F.col("o_orderkey") + 1).alias("seq"),
    )
    # The suppliers of a nation share one website, so they are one client.
    fresh = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("company_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("https://n"), F.col("s_nationkey").cast("string"), F.lit(".Supplier.example")).alias("website"),
        F.lit(None).cast("string").alias("status"),
        V.trust(F.col("s_acctbal")).alias("trust_score"),
        (F.lit(10**12) + F.col("s_suppkey") + 1).alias("seq"),
    )
    return again.unionByName(fresh)


def upsert_clients(spark, folder):
    old = V.clients(spark, folder).select("id", "company_id", "name", "website", "status", "trust_score")
    return crm.upsert_clients(old, _incoming(spark, folder), F.lit(V.AS_OF).cast("timestamp_ntz"))


def client_versions(spark, folder):
    """A stored client table after a batch of saves, beside what it held before."""
    old = V.clients(spark, folder).select("id", "company_id", "name", "website", "status", "trust_score")
    stored = VersionedTable.create(old, f"{checkpoint_dir(spark)}/clients-{uuid.uuid4().hex}", "id", buckets=16)
    version = crm.save_clients(stored, _incoming(spark, folder), F.lit(V.AS_OF).cast("timestamp_ntz"))
    before = stored.read(version - 1).select("id", F.col("status").alias("old_status"), F.col("trust_score").alias("old_trust"))
    return stored.read(version).join(before, "id", "left").select("id", "name", "status", "trust_score", "old_status", "old_trust")


def update_clients(spark, folder):
    o = table(spark, folder, "orders")
    latest = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("o_orderkey"))
    changes = (
        latest.join(V.clients(spark, folder).select("id", "company_id"), "id")
        .select(
            "id", "company_id",
            F.when(F.col("o_orderkey") % 2 == 0, "Won").alias("status"),
            F.lit("phone ").alias("phone"),
        )
    )
    return crm.update_clients(V.clients(spark, folder), changes).select("id", "status", "phone", "trust_score")


def mark_contacted(spark, folder):
    sent = V.mail_log(spark, folder).select(F.col("client_id").alias("id"), "company_id")
    moved = crm.mark_contacted(V.clients(spark, folder), sent)
    return moved.groupBy("company_id", "status").agg(F.count("*").alias("n"))


def _lead_rows(spark, folder):
    return table(spark, folder, "customer").select(
        F.concat(F.lit("lead-"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("company_name"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@mail.example")).alias("contact_email"),
        (F.col("c_acctbal") > 5000).alias("opened"),
        F.lit(False).alias("clicked"), F.lit(False).alias("replied"), F.lit(False).alias("bounced"),
        V.trust(F.col("c_acctbal")).alias("probability_score"),
        F.col("c_nationkey").alias("company_id"),
    )


def upsert_leads(spark, folder):
    o = table(spark, folder, "orders")
    new = o.select(
        F.concat(F.lit("lead-"), F.call_function("div", F.col("o_orderkey"), F.lit(3)).cast("string")).alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("company_name"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@mail.example")).alias("contact_email"),
        F.lit(1).alias("company_id"),
        (F.col("o_orderkey") + 1).alias("seq"),
    )
    return LE.upsert_leads(_lead_rows(spark, folder), new).select(
        "id", "company_name", "contact_email", "opened", "probability_score", "company_id"
    )


def lead_lookup(spark, folder):
    """Leads of the recipients seen in the event log."""
    wanted = table(spark, folder, "events").select(
        F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit("@mail.example")).alias("contact_email")
    )
    return CL.lookup(_lead_rows(spark, folder), wanted, "contact_email").select(
        "id", "contact_email", "probability_score"
    )


def client_lookup(spark, folder):
    """Lookups by (id, company), where some ask under the wrong company."""
    o = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 25).cast("int").alias("company_id")
    )
    return CL.client_by_id(V.clients(spark, folder), o.distinct()).select("id", "company_id", "name")


def client_scan(spark, folder):
    return CL.scan(V.clients(spark, folder), order="id", company_id=7, status=None).select("id", "name")


def client_search(spark, folder):
    c = CL.search_clients(V.clients(spark, folder), q="tion_1", industry="mach", min_score=20)
    return c.select("id", "name", "industry", "country", "trust_score", "status")


def export_rows(spark, folder):
    rows = CL.export_projection(V.clients(spark, folder))
    return rows.toDF(*[n.lower().replace(" (%)", "").replace(" ", "_") for n in rows.columns])


def contact_overlay(spark, folder):
    """Deep-crawl results over the client's own columns."""
    c = V.clients(spark, folder)
    key = F.col("id").cast("string")
    deep = F.to_json(
        F.struct(
            F.array(F.concat(F.lit("a"), key, F.lit("@deep.example"))).alias("all_emails"),
            F.array(F.concat(F.lit("+49 30 "), key)).alias("phones"),
            F.lit("https://linkedin.com/company/x").alias("linkedin_company"),
        )
    )
    c = c.select(
        "id", "website", "email", "phone", F.concat(key, F.lit(", ,"), key).alias("phones"),
        F.lit(None).cast("string").alias("linkedin_company"),
        F.lit(None).cast("string").alias("contact_source_url"),
        F.lit(None).cast("string").alias("contact_source_label"),
        F.when(F.col("trust_score") > 50, deep).when(F.col("trust_score") > 20, F.lit("{broken")).alias("contact_source_context"),
    )
    return CL.stage2_overlay(c).select(
        "id", "primary_email", F.array_join("phone_list", ";").alias("phone_text"),
        "company_profile", "contact_page_url", "source_label", "found",
    )


def region_places(spark, folder):
    """Country rows with their places, looked up by name without case."""
    n = table(spark, folder, "nation")
    r = table(spark, folder, "region")
    countries = (
        r.join(n, n.n_regionkey == r.r_regionkey)
        .groupBy(F.col("r_name").alias("country"))
        .agg(F.min("r_regionkey").cast("string").alias("code"), F.collect_list("n_name").alias("cities"))
    )
    wanted = r.where(F.col("r_name").contains("A")).select(F.initcap("r_name").alias("country"))
    return CL.country_cities(countries, wanted)


QUERIES = {
    f.__name__: f
    for f in (
        email_labels, email_labels_continued, upsert_clients, client_versions, update_clients, mark_contacted, upsert_leads,
        lead_lookup, client_lookup, client_scan, client_search, export_rows, contact_overlay, region_places,
    )
}

_LEAD_ROWS = """
  SELECT 'lead-' || c_custkey AS id, c_name AS company_name, 'c' || c_custkey || '@mail.example' AS contact_email,
    c_acctbal > 5000 AS opened, CAST(least(100, greatest(0, floor(c_acctbal / 100))) AS INTEGER) AS probability_score,
    c_nationkey AS company_id FROM customer"""

SQL = {
    "email_labels": f"SELECT id, label FROM ({LABELS})",
    "upsert_clients": f"""
        WITH o AS (SELECT o_custkey, arg_max(st, o_orderkey) FILTER (st IS NOT NULL) AS st,
                          arg_max(ts, o_orderkey) FILTER (ts IS NOT NULL) AS ts FROM (
            SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Won' WHEN 'O' THEN 'Contacted' END AS st,
              CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(least(100, floor(o_totalprice / 5000)) AS INTEGER) END AS ts FROM orders)
          GROUP BY o_custkey)
        SELECT id, company_id, CASE WHEN o_custkey IS NULL THEN name ELSE upper(name) END AS name, website,
               coalesce(st, status) AS status, coalesce(ts, trust_score) AS trust_score
        FROM ({V.CLIENTS}) LEFT JOIN o ON o_custkey = id
        UNION ALL
        SELECT (SELECT max(c_custkey) FROM customer) + 1000000000000 + min(s_suppkey) + 1, s_nationkey, arg_max(s_name, s_suppkey),
               'https://n' || s_nationkey || '.Supplier.example', 'Pending',
               CAST(least(100, greatest(0, floor(arg_max(s_acctbal, s_suppkey) / 100))) AS INTEGER)
        FROM supplier GROUP BY s_nationkey""",
    "update_clients": f"""
        SELECT id, CASE WHEN k % 2 = 0 THEN 'Won' ELSE status END AS status,
               CASE WHEN k IS NOT NULL THEN 'phone ' END AS phone, trust_score
        FROM ({V.CLIENTS}) LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1) ON o_custkey = id""",
    "mark_contacted": f"""
        SELECT company_id, CASE WHEN status = 'Pending' AND id IN (SELECT o_custkey FROM orders) THEN 'Contacted' ELSE status END AS status,
               count(*) AS n FROM ({V.CLIENTS}) GROUP BY ALL""",
    "upsert_leads": f"""
        WITH a AS (
          SELECT *, 0 AS seq FROM ({_LEAD_ROWS}) UNION ALL
          SELECT 'lead-' || (o_orderkey // 3), 'Order ' || o_orderkey, 'c' || o_custkey || '@mail.example', false, 20, 1, o_orderkey + 1
          FROM orders)
        SELECT id, company_name, contact_email, opened, probability_score, company_id FROM (
          SELECT *, max(seq) OVER (PARTITION BY id) AS by_id, max(seq) OVER (PARTITION BY contact_email) AS by_mail FROM a)
        WHERE seq = by_id AND seq = by_mail""",
    "lead_lookup": f"""
        SELECT id, contact_email, probability_score FROM ({_LEAD_ROWS})
        WHERE contact_email IN (SELECT 'c' || user_id || '@mail.example' FROM events)""",
    "client_lookup": f"""
        SELECT id, company_id, name FROM ({V.CLIENTS}) c
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.id AND o_orderkey % 25 = c.company_id)""",
    "client_scan": f"SELECT id, name FROM ({V.CLIENTS}) WHERE company_id = 7",
    "client_search": f"""
        SELECT id, name, industry, country, trust_score, status FROM ({V.CLIENTS})
        WHERE (contains(lower(name), 'tion_1') OR contains(lower(industry), 'tion_1') OR contains(lower(country), 'tion_1'))
          AND contains(lower(industry), 'mach') AND trust_score >= 20""",
    "export_rows": f"""
        SELECT name AS client_name, website, industry, country, CAST(trust_score AS VARCHAR) AS trust_score, status,
               coalesce(email, 'N/A') AS email, 'N/A' AS phone, coalesce(relevance_reason, 'N/A') AS relevance_reason, created_at
        FROM ({V.CLIENTS})""",
    "contact_overlay": f"""
        SELECT id, CASE WHEN trust_score > 50 THEN 'a' || id || '@deep.example' ELSE email END AS primary_email,
               CASE WHEN trust_score > 50 THEN '+49 30 ' || id ELSE id || ';' || id END AS phone_text,
               CASE WHEN trust_score > 50 THEN 'https://linkedin.com/company/x' END AS company_profile,
               website || '/contact-us' AS contact_page_url,
               CASE WHEN trust_score > 50 THEN 'Stage 2 Deep Crawl' ELSE 'Stage 1 (fast crawl)' END AS source_label,
               true AS found
        FROM ({V.CLIENTS})""",
    "region_places": """
        SELECT r_name AS country, CAST(r_regionkey AS VARCHAR) AS code, n_name AS city
        FROM region JOIN nation ON n_regionkey = r_regionkey WHERE contains(r_name, 'A')""",
}
_WORD = """CASE email_type WHEN 'outreach' THEN 'Cold Outreach' WHEN 'followup' THEN 'Follow-up'
  WHEN 'negotiation' THEN 'Negotiation Reply' ELSE 'Email' END"""
SQL["email_labels_continued"] = f"""
    SELECT id, {_WORD} || ' ' || (old + row_number() OVER (PARTITION BY client_id, company_id, email_type ORDER BY id)) AS label,
           'Draft' AS status
    FROM (SELECT l.*, (SELECT count(*) FROM ({V.MAIL_LOG}) o WHERE o.created_at < '1998' AND o.client_id = l.client_id
                         AND o.email_type = l.email_type) AS old
          FROM ({V.MAIL_LOG}) l WHERE created_at >= '1998')"""
SQL["client_versions"] = f"""
  SELECT n.id, n.name, n.status, n.trust_score, b.status AS old_status, b.trust_score AS old_trust
  FROM ({SQL["upsert_clients"]}) n LEFT JOIN ({V.CLIENTS}) b ON b.id = n.id"""
