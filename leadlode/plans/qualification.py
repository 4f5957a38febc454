"""Junk, verdict, name, relevance and accuracy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlode import rules
from leadlode.functions import text as TX
from leadlode.operators import clients as CL
from leadlode.operators import candidates as CA
from leadlode.operators import leads as LE
from leadlode.operators import metrics as ME
from leadlode.operators import qualify as QU
from leadlode.operators import relevance as RE
from leadlode.plans import candidates as PC
from leadlode.plans import contacts as CP
from leadlode.plans import views as V
from leadlode.sources.readers import table, text_table

PROFILE = "That tion with the heer and est une der die und les enting erre with services"
MIN_MATCH = 0.25
STOP_WORDS = ("the", "and", "of", "to", "in")
INDUSTRY = "Pharma"


def junk_rule(spark, folder):
    d = text_table(spark, folder, "documents", "doc_id").select("doc_id", "text")
    return QU.flag_junk(d).select("doc_id", "is_junk", "matched")


def junk_metrics(spark, folder):
    flagged = junk_rule(spark, folder).select("doc_id", F.col("is_junk").alias("predicted"))
    truth = table(spark, folder, "labels").select("doc_id", (F.col("quality") == 0).alias("actual"))
    return ME.classification_metrics(flagged, truth, "doc_id")


def company_names(spark, folder):
    c = CA.with_domain(V.hits(spark, folder))
    return QU.resolve_company_name(c)


def relevance(spark, folder):
    return RE.relevance_score(text_table(spark, folder, "documents", "doc_id"), PROFILE, STOP_WORDS)


def relevance_vs_label(spark, folder):
    scores = RE.relevance_score(text_table(spark, folder, "documents", "doc_id"), PROFILE, STOP_WORDS, digits=None)
    truth = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("rating"))
    return ME.score_agreement(scores, truth, "doc_id").select(
        "n", F.round("r", 6).alias("r"), F.round("mae", 6).alias("mae")
    )


def profile_matches(spark, folder):
    """All texts against the profiles of many companies at once, here the items of ``benchmark``."""
    profiles = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("profile"))
    docs = text_table(spark, folder, "documents", "doc_id")
    return RE.profile_matches(docs, profiles, MIN_MATCH, STOP_WORDS, profile_col="item_id", digits=6)


def _answers(key, folder_table):
    """Raw answers as a model might give them: fenced, broken, unsure, missing."""
    i = F.col(key)
    reason = (
        F.when(i % 13 == 0, "They run our fleet themselves")
        .when(i % 17 == 0, "A B2B SaaS for sales")
        .otherwise("Makes things")
    )
    kind = F.element_at(
        F.array(*[F.lit(v) for v in ("NEEDS_SERVICE", "has_similar_service", "maybe", "")]),
        (i % 4 + 1).cast("int"),
    )
    body = F.to_json(
        F.struct(
            (i % 11 == 0).alias("is_junk"),
            (i % 3 != 0).alias("industry_match"),
            kind.alias("lead_type"),
            (i * 37 % 101).alias("confidence"),
            reason.alias("reason"),
            F.when(i % 5 == 0, F.concat(F.lit("Acme "), i.cast("string"))).otherwise("").alias("official_company_name"),
            F.when(i % 2 == 0, "France").otherwise("unknown").alias("detected_country"),
        )
    )
    raw = (
        F.when(i % 7 == 0, F.lit(None).cast("string"))
        .when(i % 19 == 0, F.concat(F.lit("Sorry: "), body))
        .when(i % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body)
    )
    return folder_table.select(key, raw.alias("raw_json"))


def verdicts(spark, folder):
    d = text_table(spark, folder, "documents", "doc_id")
    c = d.select(
        "doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("name"),
        F.col("text").alias("snippet"), F.lit("").alias("scraped"),
    )
    e = QU.apply_verdicts(c, _answers("doc_id", d.select("doc_id")), INDUSTRY, key="doc_id")
    return e.select(
        "doc_id", "outcome", "is_junk", "industry_match", "lead_type",
        F.col("confidence").cast("bigint").alias("confidence"), "detected_country",
    )


def _evaluated(spark, folder):
    """Hits -> rules -> one per domain -> page text -> verdict -> gate."""
    cleaned = CA.filter_candidates(V.hits(spark, folder), excluded=V.EXCLUDED)
    kept = CA.dedupe_candidates(cleaned, ["query"])
    # Tags are removed after the join, from the pages that were kept.
    html = text_table(spark, folder, "pages", "page_id").select("page_id", "html")
    c = kept.join(html, "page_id").select(
        "page_id", "query", "page", "pos", "url", "domain", "title",
        F.col("title").alias("name"), F.col("content").alias("snippet"),
        TX.html_text(F.col("html")).alias("scraped"),
    )
    answers = _answers("page_id", text_table(spark, folder, "pages", "page_id").select("page_id"))
    return QU.accepted(QU.apply_verdicts(c, answers, INDUSTRY, key="page_id"))


def qualified_cards(spark, folder):
    cards = QU.company_cards(_evaluated(spark, folder), INDUSTRY)
    gated = cards.where(QU.passes_reader_gate(60) & QU.reviewed_and_scored())
    return gated.select(
        "domain", "name", "country", "snippet", "matchReason", "leadType",
        F.col("matchConfidence").cast("bigint").alias("matchConfidence"),
    )


def card_export(spark, folder):
    """Cards as an export, with the contacts of their evidence: four documents for odd pages, else the title."""
    d = text_table(spark, folder, "documents", "doc_id")
    four = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    texts = d.groupBy(F.call_function("div", F.col("doc_id"), F.lit(4)).alias("page_id")).agg(
        F.array_join(F.transform(four, lambda x: x["text"]), "\n").alias("evidence")
    )
    found = _evaluated(spark, folder).join(texts.where(F.col("page_id") % 2 == 1), "page_id", "left")
    return CL.export_projection(QU.company_cards(found, INDUSTRY, evidence="evidence"), CL.CARD_EXPORT)


def top_leads(spark, folder):
    return CA.take_target(_evaluated(spark, folder), n=10).select("query", "rnk", "domain", "lead_type")


def new_leads(spark, folder):
    cards = QU.company_cards(_evaluated(spark, folder), INDUSTRY)
    return LE.leads_from_companies(cards).select(
        "id", "company_name", "contact_email", "is_guessed", "subject", "suggested_action"
    )


QUERIES = {
    f.__name__: f
    for f in (
        junk_rule, junk_metrics, company_names, relevance, relevance_vs_label, profile_matches, verdicts,
        qualified_cards, card_export, top_leads, new_leads,
    )
}

_DIR = V.q(V.plain_any_of(rules.DIRECTORY_PATTERNS))
_LIST = V.q(V.plain_any_of(rules.LISTICLE_PATTERNS))


def sql_junk(text: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({text}, {_DIR}, 1), ''), nullif(regexp_extract({text}, {_LIST}, 1), ''))"
    )


def _tokens() -> str:
    values = ", ".join(f"({V.q(w)}, {n})" for w, n in sorted(RE.profile_counts(PROFILE, STOP_WORDS).items()))
    w2 = repr(RE.LONE_WEIGHT * RE.LONE_WEIGHT)
    return f"""
      prof(t, m) AS (VALUES {values}),
      tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS t FROM documents),
      cnt AS (SELECT doc_id, t, count(*) AS n FROM tok WHERE t NOT IN {V.in_list(STOP_WORDS)} GROUP BY doc_id, t),
      agg AS (SELECT doc_id, coalesce(sum(n * m), 0) AS dot,
                coalesce(sum(n * n) FILTER (m IS NOT NULL), 0) AS bd, coalesce(sum(n * n) FILTER (m IS NULL), 0) AS od,
                coalesce(sum(m * m), 0) AS bp FROM cnt LEFT JOIN prof USING (t) GROUP BY doc_id),
      score AS (SELECT d.doc_id, CASE WHEN {V.sql_strip('text')} = '' THEN 0.5::DOUBLE WHEN a.doc_id IS NULL THEN 0.0::DOUBLE
                ELSE CAST(dot AS DOUBLE) / (sqrt(CAST(bd AS DOUBLE) + CAST(od AS DOUBLE) * {w2}::DOUBLE)
                  * sqrt(CAST(bp AS DOUBLE) + CAST((SELECT sum(m * m) FROM prof) - bp AS DOUBLE) * {w2}::DOUBLE)) END AS score
                FROM documents d LEFT JOIN agg a ON a.doc_id = d.doc_id)"""


def sql_evaluated(key: str, source: str) -> str:
    """Outcome columns of ``source`` (key, name, snippet, scraped) by the made-up answers."""
    i = key
    text = "name || ' ' || snippet || ' ' || scraped"
    reason = (
        f"CASE WHEN {i} % 13 = 0 THEN 'They run our fleet themselves' "
        f"WHEN {i} % 17 = 0 THEN 'A B2B SaaS for sales' ELSE 'Makes things' END"
    )
    ev = f"lower(snippet || ' ' || scraped || ' ' || {reason})"
    return f"""
      SELECT *, CASE WHEN broken THEN 'UNKNOWN' WHEN is_junk THEN 'JUNK' WHEN NOT industry_match THEN 'INDUSTRY_MISMATCH'
                     WHEN lead_type IN ('NEEDS_SERVICE', 'HAS_SIMILAR_SERVICE') THEN lead_type ELSE 'UNKNOWN' END AS outcome
      FROM (
        SELECT *, byrule IS NULL AND NOT none AND bad AS broken,
          CASE WHEN byrule IS NOT NULL THEN true WHEN none THEN false WHEN bad THEN NULL ELSE {i} % 11 = 0 END AS is_junk,
          CASE WHEN byrule IS NOT NULL THEN false WHEN none THEN true WHEN bad THEN NULL WHEN soft THEN false
               ELSE {i} % 3 <> 0 AND NOT unsure END AS industry_match,
          CASE WHEN byrule IS NOT NULL THEN '' WHEN none THEN 'NEEDS_SERVICE' WHEN bad THEN NULL WHEN soft OR unsure THEN ''
               WHEN simil OR {i} % 4 = 1 THEN 'HAS_SIMILAR_SERVICE' WHEN {i} % 4 = 0 OR {i} % 3 <> 0 THEN 'NEEDS_SERVICE'
               ELSE '' END AS lead_type,
          CAST(CASE WHEN byrule IS NOT NULL THEN 0 WHEN none THEN 75 WHEN bad THEN NULL WHEN soft THEN 0 ELSE {i} * 37 % 101 END AS BIGINT) AS confidence,
          CASE WHEN byrule IS NOT NULL THEN 'JUNK: Directory, marketplace, or listicle article detected (''' || byrule || ''')'
               WHEN none THEN 'Verified operating business in {INDUSTRY} (' || {i} || ')' WHEN bad THEN NULL
               WHEN soft THEN 'INDUSTRY MISMATCH: Candidate is a software/CRM SaaS platform, not operating in ''{INDUSTRY}''' ELSE rsn END AS reason,
          CASE WHEN none THEN name WHEN bad THEN NULL WHEN {i} % 5 = 0 THEN 'Acme ' || {i} ELSE '' END AS official,
          CASE WHEN none THEN 'Global' WHEN bad THEN NULL WHEN {i} % 2 = 0 THEN 'France' ELSE 'unknown' END AS detected_country
        FROM (
          SELECT *, {sql_junk(text)} AS byrule, {i} % 7 = 0 AS none, {i} % 19 = 0 AS bad, {reason} AS rsn,
            {V.has_word(ev, rules.SOFTWARE_PHRASES)} AS soft,
            regexp_matches({ev}, {V.q('|'.join(rules.SIMILAR_SERVICE_PATTERNS))}) AS simil,
            {i} * 37 % 101 < 50 AND {i} % 11 <> 0 AS unsure
          FROM ({source})))"""


def sql_invalid_name(n: str) -> str:
    t = V.sql_strip(n)
    return f"""(length({n}) < 2 OR length({n}) > 55 OR lower({t}) IN {V.in_list(rules.GENERIC_NAMES)}
      OR regexp_matches({t}, {V.q(rules.YEAR_TAG_PATTERN)}) OR regexp_matches({t}, {V.q(rules.SERVICE_PHRASE_PATTERN)})
      OR ends_with({t}, '.') OR len(list_filter(regexp_split_to_array({t}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) > 7)"""


def sql_named(source: str) -> str:
    """Adds ``title_name`` and ``domain_name`` to rows with ``title`` and ``domain``."""
    return f"""
      SELECT *, coalesce(list_filter(parts, lambda p: contains(lower(regexp_replace(p, '[^a-zA-Z0-9]', '', 'g')), base)
                           OR contains(base, lower(regexp_replace(p, '[^a-zA-Z0-9]', '', 'g'))))[1],
                         list_sort(list_transform(parts, lambda p, i: {{'n': -length(p), 'i': i, 'p': p}}))[1].p,
                         domain_name) AS title_name
      FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(title, {V.q(rules.TITLE_SEPARATORS)}), lambda p: {V.sql_strip('p')}),
                                  lambda p: p <> '' AND NOT {sql_invalid_name('p')}) AS parts,
              replace(replace(split_part(domain, '.', 1), '-', ''), '_', '') AS base,
              array_to_string(list_transform(regexp_extract_all(replace(replace(split_part(domain, '.', 1), '-', ' '), '_', ' '),
                '\\p{{L}}+|[^\\p{{L}}]+'), lambda s: upper(s[1]) || substr(s, 2)), '') AS domain_name
            FROM ({source}))"""


from leadlode.plans.contacts import sql_text  # noqa: E402

_KEPT = f"""
  SELECT page_id, query, page, pos, url, domain, title, title AS name, '' AS snippet, scraped FROM ({PC.FIRST}) JOIN
    (SELECT page_id, {sql_text('html')} AS scraped FROM pages) USING (page_id)"""
_ACCEPTED = f"""
  SELECT * FROM ({sql_evaluated('page_id', _KEPT)})
  WHERE NOT broken AND NOT is_junk AND industry_match AND confidence >= 50
    AND lead_type IN ('NEEDS_SERVICE', 'HAS_SIMILAR_SERVICE')"""
_RESOLVED = f"""
  SELECT *, CASE WHEN NOT {sql_invalid_name("official")} THEN official
                 WHEN NOT {sql_invalid_name("title_name")} THEN title_name ELSE domain_name END AS final_name
  FROM ({sql_named(_ACCEPTED)})"""

SQL = {
    "junk_rule": f"""
        SELECT doc_id, m IS NOT NULL AS is_junk, m AS matched FROM (SELECT doc_id, {sql_junk('text')} AS m FROM documents)""",
    "junk_metrics": f"""
        WITH c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp,
                          count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn
                   FROM (SELECT {sql_junk('text')} IS NOT NULL AS p, quality = 0 AS a FROM documents JOIN labels USING (doc_id)))
        SELECT *, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy, tp / nullif(tp + fp, 0) AS precision,
          tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity,
          2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c""",
    "company_names": f"""
        SELECT page_id, CASE WHEN NOT {sql_invalid_name('title_name')} THEN title_name ELSE domain_name END AS name
        FROM ({sql_named(V.HITS)})""",
    "relevance": f"WITH {_tokens()} SELECT doc_id, round(score, 3) AS score FROM score",
    "relevance_vs_label": f"""
        WITH {_tokens()}
        SELECT count(*) AS n, round(corr(score, quality), 6) AS r, round(avg(abs(score - quality)), 6) AS mae
        FROM score JOIN labels USING (doc_id)""",
    "profile_matches": f"""
        WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS t FROM documents),
        dc AS (SELECT doc_id, t, count(*) AS n FROM dt WHERE t NOT IN {V.in_list(STOP_WORDS)} GROUP BY ALL),
        pt AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS t FROM benchmark),
        pc AS (SELECT item_id, t, count(*) AS m FROM pt WHERE t NOT IN {V.in_list(STOP_WORDS)} GROUP BY ALL),
        da AS (SELECT doc_id, sum(n * n) AS a FROM dc GROUP BY 1), pa AS (SELECT item_id, sum(m * m) AS a FROM pc GROUP BY 1),
        met AS (SELECT item_id, doc_id, sum(n * m) AS dot, sum(n * n) AS bd, sum(m * m) AS bp FROM dc JOIN pc USING (t) GROUP BY ALL),
        s AS (SELECT item_id, doc_id, CAST(dot AS DOUBLE)
                / (sqrt(CAST(bd AS DOUBLE) + CAST(da.a - bd AS DOUBLE) * {RE.LONE_WEIGHT**2!r}::DOUBLE)
                 * sqrt(CAST(bp AS DOUBLE) + CAST(pa.a - bp AS DOUBLE) * {RE.LONE_WEIGHT**2!r}::DOUBLE)) AS score
              FROM met JOIN da USING (doc_id) JOIN pa USING (item_id))
        SELECT item_id, doc_id, round(score, 6) AS score FROM s WHERE score >= {MIN_MATCH}""",
    "verdicts": "SELECT doc_id, outcome, is_junk, industry_match, lead_type, confidence, detected_country FROM ("
    + sql_evaluated("doc_id", "SELECT doc_id, 'Doc ' || doc_id AS name, text AS snippet, '' AS scraped FROM documents") + ")",
    "qualified_cards": f"""
        SELECT domain, final_name AS name, CASE WHEN detected_country = 'unknown' THEN 'Global' ELSE detected_country END AS country,
          CASE WHEN length('') < 25 THEN reason END AS snippet, reason AS "matchReason", lower(lead_type) AS "leadType",
          confidence AS "matchConfidence" FROM ({_RESOLVED}) WHERE confidence >= 60""",
    "top_leads": f"""
        SELECT query, CAST(rnk AS INTEGER) AS rnk, domain, lead_type FROM (
          SELECT *, row_number() OVER (PARTITION BY query ORDER BY page, pos) AS rnk FROM ({_ACCEPTED})) WHERE rnk <= 10""",
    "new_leads": f"""
        SELECT 'co-' || domain AS id, final_name AS company_name, 'contact@' || domain AS contact_email, true AS is_guessed,
          'Outreach opportunity for ' || final_name AS subject, reason AS suggested_action FROM ({_RESOLVED})""",
}

_CARD_TEXT = f"""
  SELECT r.*, coalesce(t.text, r.title || ' ') AS ev FROM ({_RESOLVED}) r LEFT JOIN (
    SELECT doc_id // 4 AS page_id, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1) t
  ON t.page_id = r.page_id AND r.page_id % 2 = 1"""
SQL["card_export"] = f"""
    WITH cards AS ({_CARD_TEXT}),
    em AS (SELECT page_id, email, {CP.sql_context("ev")} AS ctx
           FROM (SELECT page_id, email FROM ({CP.sql_emails("cards", "page_id", "ev", rules.BLOCKED_EMAIL_WORDS)}) WHERE pos = 0)
           JOIN cards USING (page_id)),
    ph AS (SELECT page_id, phone FROM ({CP.sql_phones("cards", "page_id", "ev")}) WHERE pos = 0)
    SELECT final_name AS "Company Name", url AS "Website", domain AS "Domain", {V.q(INDUSTRY)} AS "Industry",
      CASE WHEN detected_country = 'unknown' THEN 'Global' ELSE detected_country END AS "Country",
      confidence::VARCHAR AS "AI Fit Score (%)", 'Verified Company' AS "Trust Status", coalesce(email, 'N/A') AS "Email",
      coalesce(phone, 'N/A') AS "Phone", 'N/A' AS "LinkedIn",
      CASE WHEN email IS NULL THEN 'N/A' ELSE {CP.sql_page_name("url")} END AS "Contact Source Page",
      coalesce(nullif(ctx, ''), 'N/A') AS "Source Context", reason AS "Summary"
    FROM cards LEFT JOIN em USING (page_id) LEFT JOIN ph USING (page_id)"""
