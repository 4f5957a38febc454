"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlode import rules
from leadlode.operators import clients as CL
from leadlode.operators import crm
from leadlode.operators import dashboard as DA
from leadlode.plans import views as V


def dashboard_kpis(spark, folder):
    return DA.dashboard_kpis(V.clients(spark, folder), V.mail_log(spark, folder))


def weekly_chart(spark, folder):
    return DA.weekly_chart(V.clients(spark, folder), V.mail_log(spark, folder), V.AS_OF)


def activity_feed(spark, folder):
    return DA.activity_feed(V.clients(spark, folder), V.mail_log(spark, folder), V.AS_OF)


def pipeline_stages(spark, folder):
    return crm.pipeline_stages(V.clients(spark, folder))


def trust_bands(spark, folder):
    return CL.band_scores(V.clients(spark, folder))


def trust_band_kinds(spark, folder):
    """Clients per combination of the three band scales."""
    s = F.col("trust_score")
    return (
        V.clients(spark, folder)
        .groupBy(
            CL.band_of(s).alias("intent"),
            CL.band_of(s, rules.CARD_BANDS, "red").alias("card"),
            CL.band_of(s, rules.CLIENT_BANDS, "red").alias("client"),
        )
        .agg(F.count("*").alias("n"))
    )


QUERIES = {
    f.__name__: f
    for f in (dashboard_kpis, weekly_chart, activity_feed, pipeline_stages, trust_bands, trust_band_kinds)
}

LABELS = f"""
  SELECT *, CASE email_type WHEN 'outreach' THEN 'Cold Outreach' WHEN 'followup' THEN 'Follow-up'
                 WHEN 'negotiation' THEN 'Negotiation Reply' ELSE 'Email' END || ' ' ||
            row_number() OVER (PARTITION BY client_id, company_id, email_type ORDER BY id) AS label
  FROM ({V.MAIL_LOG})"""

_WEEK = f"""CASE WHEN t >= TIMESTAMP '{V.AS_OF}' - INTERVAL 7 DAY THEN 4 WHEN t >= TIMESTAMP '{V.AS_OF}' - INTERVAL 14 DAY THEN 3
  WHEN t >= TIMESTAMP '{V.AS_OF}' - INTERVAL 21 DAY THEN 2 WHEN t >= TIMESTAMP '{V.AS_OF}' - INTERVAL 28 DAY THEN 1 END"""


def _band(cuts, lowest):
    return "CASE " + " ".join(f"WHEN trust_score >= {c} THEN {V.q(n)}" for c, n in cuts) + f" ELSE {V.q(lowest)} END"


SQL = {
    "dashboard_kpis": f"""
        WITH c AS (SELECT company_id, count(*) AS n, count(*) FILTER (status IN {V.in_list(rules.QUALIFIED_STATUSES)} OR trust_score >= 80) AS qs,
                     count(*) FILTER (status IN {V.in_list(rules.ACTIVE_STATUSES)}) AS act, avg(trust_score) AS a FROM ({V.CLIENTS}) GROUP BY 1),
        h AS (SELECT company_id, count(DISTINCT client_id) AS m, count(*) AS e FROM ({V.MAIL_LOG}) GROUP BY 1)
        SELECT company_id, coalesce(n, 0) AS total_companies_found, greatest(coalesce(m, 0), coalesce(qs, 0)) AS qualified_leads,
          greatest(coalesce(e, 0), coalesce(act, 0)) AS active_outreach,
          CASE WHEN a > 0 THEN round(a, 1) ELSE 0.0::DOUBLE END AS avg_trust_score, coalesce(e, 0) AS total_emails_generated
        FROM c FULL JOIN h USING (company_id)""",
    "weekly_chart": f"""
        WITH co AS (SELECT DISTINCT company_id FROM ({V.CLIENTS})), w AS (SELECT company_id, unnest([1, 2, 3, 4]) AS week FROM co),
        h AS (SELECT company_id, {_WEEK} AS week FROM (SELECT company_id, mailed AS t FROM ({V.MAIL_LOG}))),
        c AS (SELECT company_id, status, {_WEEK} AS week FROM (SELECT company_id, status, CAST(created_at AS TIMESTAMP) AS t FROM ({V.CLIENTS}))),
        he AS (SELECT company_id, week, count(*) AS emails FROM h GROUP BY ALL),
        ce AS (SELECT company_id, week, count(*) FILTER (status = 'Contacted') AS calls,
                 count(*) FILTER (status IN ('In Negotiation', 'Won')) AS meetings FROM c GROUP BY ALL)
        SELECT company_id, week, coalesce(emails, 0) AS emails, coalesce(calls, 0) AS calls, coalesce(meetings, 0) AS meetings
        FROM w LEFT JOIN he USING (company_id, week) LEFT JOIN ce USING (company_id, week)""",
    "activity_feed": f"""
        WITH m AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY id DESC) AS nth FROM ({LABELS})),
        c AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY id DESC) AS nth FROM ({V.CLIENTS})),
        a AS (
          SELECT m.company_id, label || ' Generated' AS title,
            CASE email_type WHEN 'outreach' THEN 'Cold Outreach' WHEN 'followup' THEN 'Follow-up' ELSE 'Negotiation Reply' END
              || ' for ' || coalesce(k.name, 'Prospect') AS subtitle, m.created_at AS ts,
            CASE email_type WHEN 'outreach' THEN 'auto_awesome' WHEN 'followup' THEN 'sync' ELSE 'handshake' END AS icon,
            email_type AS type, 0 AS src, m.nth
          FROM m LEFT JOIN ({V.CLIENTS}) k ON k.id = m.client_id WHERE m.nth <= 5
          UNION ALL
          SELECT company_id, 'Prospect Saved: ' || name, 'Fit Score: ' || trust_score || '% · Status: ' || status, created_at,
            'corporate_fare', 'saved', 1, nth FROM c WHERE nth <= 5)
        SELECT company_id, CAST(rnk AS INTEGER) AS rnk, title, subtitle, ts, icon, type FROM (
          SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY ts DESC, src, nth) AS rnk FROM a) WHERE rnk <= 6""",
    "pipeline_stages": f"""
        SELECT company_id, CASE WHEN lower(status) IN ('pending', 'qualified') THEN 'New Leads'
            WHEN lower(status) IN ('contacted', 'awaiting outreach') THEN 'Contacted'
            WHEN lower(status) = 'in negotiation' THEN 'In Negotiation'
            WHEN lower(status) IN ('won', 'closed won') THEN 'Closed Won' END AS stage, count(*) AS n
        FROM ({V.CLIENTS}) GROUP BY ALL""",
    "trust_bands": f"SELECT {_band(rules.INTENT_BANDS, 'Low Intent')} AS band, count(*) AS n FROM ({V.CLIENTS}) GROUP BY 1",
    "trust_band_kinds": f"""
        SELECT {_band(rules.INTENT_BANDS, 'Low Intent')} AS intent, {_band(rules.CARD_BANDS, 'red')} AS card,
          {_band(rules.CLIENT_BANDS, 'red')} AS client, count(*) AS n FROM ({V.CLIENTS}) GROUP BY ALL""",
}
