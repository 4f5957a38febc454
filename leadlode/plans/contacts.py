"""Contact, link and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlode import rules
from leadlode.functions import text as TX
from leadlode.functions import urls
from leadlode.functions.common import last_value_distinct_by
from leadlode.operators import contacts as CO
from leadlode.operators import evidence as EV
from leadlode.operators import links as LI
from leadlode.operators import metrics as ME
from leadlode.plans import views as V
from leadlode.session import cut_lineage
from leadlode.sources.readers import table, text_table

# Words that do occur in the links of the test pages.
LINK_WORDS = ("the", "los")
SUB_WORDS = ("the", "de", "in", "and")
SUB_SKIP = ("was", "inly")


def page_text(spark, folder):
    t = EV.html_to_text(text_table(spark, folder, "pages", "page_id"))
    return t.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def page_text_decoded(spark, folder):
    t = EV.html_to_text(text_table(spark, folder, "pages", "page_id"), decode=True)
    return t.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def page_summaries(spark, folder):
    t = EV.html_to_text(text_table(spark, folder, "pages", "page_id"))
    return t.select("page_id", TX.page_summary(F.col("text"), F.lit("X")).alias("summary"))


def doc_emails(spark, folder):
    d = text_table(spark, folder, "documents", "doc_id")
    return CO.extract_emails(d, blocked_words=V.NO_WORDS).select("doc_id", "email")


def doc_emails_default(spark, folder):
    return CO.extract_emails(text_table(spark, folder, "documents", "doc_id")).select("doc_id", "email")


def doc_phones(spark, folder):
    return CO.extract_phones(text_table(spark, folder, "documents", "doc_id")).select("doc_id", "pos", "phone")


def email_context(spark, folder):
    d = text_table(spark, folder, "documents", "doc_id")
    return CO.extract_emails(d, blocked_words=V.NO_WORDS).select("doc_id", "email", "context")


def email_first_source(spark, folder):
    """Each address of a document with the first document that showed it."""
    d = text_table(spark, folder, "documents", "doc_id")
    e = cut_lineage(CO.extract_emails(d, blocked_words=V.NO_WORDS).select("doc_id", "pos", "email"))
    meta = e.select("email", F.col("doc_id").alias("source_doc"), F.struct("doc_id", "pos").alias("at"))
    return CO.attach_email_meta(e, meta, pos="at").select("doc_id", "email", "source_doc")


def _pages_with_docs(spark, folder):
    """Pages and, as further pages of their source, the documents."""
    p = text_table(spark, folder, "pages", "page_id")
    d = text_table(spark, folder, "documents", "doc_id").select(
        (F.col("doc_id") + 10**9).alias("page_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("html"),
    )
    return p.select("page_id", "url", "html").unionByName(d)


def _bundles(spark, folder):
    return CO.contact_bundle(_pages_with_docs(spark, folder), blocked_words=V.NO_WORDS)


def contact_bundle(spark, folder):
    return _bundles(spark, folder).select(
        "site", "n_pages", "n_emails", "n_phones", "primary_email", "primary_phone",
        "contact_url", "source_label", "source_context", "found",
    )


def contact_sources(spark, folder):
    mined = CO.mine_pages(_pages_with_docs(spark, folder), blocked_words=V.NO_WORDS)
    values = CO.contact_values(mined, headings=True).where(F.col("kind").isin("email", "heading"))
    return CO.email_sources(cut_lineage(values)).select(
        "site", "email", "url", F.col("page").alias("source_label"), F.col("label").alias("heading"), "page_id", "pos"
    )


def extraction_yield(spark, folder):
    b = _bundles(spark, folder)
    email, phone = F.col("primary_email").isNotNull(), F.col("primary_phone").isNotNull()
    return ME.extraction_yield(
        b,
        {
            "email": (email, F.col("primary_email").contains(".com")),
            "phone": (phone, F.length("primary_phone") >= 12),
            "any": (F.col("found"), email | phone),
        },
    )


def contact_links(spark, folder):
    return LI.rank_contact_links(text_table(spark, folder, "pages", "page_id"), words=LINK_WORDS)


def subpages(spark, folder):
    return LI.discover_subpages(text_table(spark, folder, "pages", "page_id"), words=SUB_WORDS, skip_words=SUB_SKIP)


def evidence(spark, folder):
    p = text_table(spark, folder, "pages", "page_id")
    ranked = p.select(
        urls.clean_domain(F.col("url")).alias("site"),
        "url",
        F.col("page_id").alias("rank"),
        "html",
    )
    e = EV.assemble_evidence(ranked, min_chars=800)
    return e.select(
        "site", F.length("evidence").cast("bigint").alias("n_chars"),
        F.md5("evidence").alias("digest"), "source_label",
    )


def _crawl(pages):
    """The pages, and at the address of a page's first three links the page some places before it."""
    links = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(LI.HREF), F.lit(1))).alias("k", "href"))
    led_to = links.where(F.col("k") < 3).select(
        (F.col("page_id") - F.col("k") - 1).alias("from_id"),
        (F.col("page_id") * 10 + F.col("k") + 10**9).alias("page_id"),
        urls.absolutise(F.col("href"), F.col("url")).alias("url"),
    )
    html = pages.select(F.col("page_id").alias("from_id"), "html")
    return pages.select("page_id", "url", "html").unionByName(led_to.join(html, "from_id").drop("from_id"))


def _homes(pages):
    site = urls.clean_domain(F.col("url"))
    first = Window.partitionBy("site").orderBy("page_id")
    ranked = pages.select("page_id", site.alias("site"), "url", "html").withColumn("nth", F.row_number().over(first))
    return ranked.where(F.col("nth") == 1).drop("nth")


def evidence_linked(spark, folder):
    """Home pages with the pages of a crawl that they link to."""
    p = text_table(spark, folder, "pages", "page_id")
    e = EV.gather_evidence(_homes(p), _crawl(p), min_chars=800, words=SUB_WORDS, skip_words=SUB_SKIP)
    return e.select(
        "site", F.length("evidence").cast("bigint").alias("n_chars"),
        F.md5("evidence").alias("digest"), "source_label",
    )


def contact_pages(spark, folder):
    """Addresses to visit for contacts: the usual ones, then the page's best links."""
    p = text_table(spark, folder, "pages", "page_id")
    site = F.concat(F.lit("https://"), urls.clean_domain(F.col("url")), F.lit("/"))
    best = F.transform(LI.contact_links(F.col("html"), F.col("url"), 8, words=LINK_WORDS), lambda l: l["url"])
    return p.select("page_id", F.posexplode(LI.candidate_pages(site, best)).alias("pos", "url"))


def evidence_choice(spark, folder):
    d = text_table(spark, folder, "documents", "doc_id")
    snippet = F.regexp_extract("text", r"^([^\n]*)", 1)
    page = F.when(F.col("lang") == "en", F.col("text")).otherwise("")
    e = EV.choose_evidence(page, snippet, F.when(F.col("lang") == "de", "never used"))
    return d.select("doc_id", e.alias("e")).select("doc_id", F.md5("e.text").alias("digest"), "e.source")


def last_spellings(spark, folder):
    """Distinct words of a turn: first place, last spelling."""
    c = table(spark, folder, "conversations")
    words = last_value_distinct_by(F.split("text", " "), F.lower)
    return c.select("conv_id", "turn", F.md5(F.array_join(words, " ")).alias("digest"))


def external_contact(spark, folder):
    c = V.clients(spark, folder).select(
        F.col("country").alias("domain"), F.col("email").alias("value"),
        F.col("trust_score").alias("confidence"), F.col("relevance_reason").alias("position"),
        F.col("id").alias("pos"),
    )
    return CO.pick_external_contact(c).select("domain", "pos", F.col("score").cast("bigint").alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        page_text, page_text_decoded, page_summaries, doc_emails, doc_emails_default, doc_phones,
        email_context, email_first_source, contact_bundle, contact_sources, extraction_yield,
        contact_links, subpages, evidence, evidence_linked, external_contact, contact_pages, evidence_choice, last_spellings,
    )
}


def sql_text(html: str) -> str:
    t = f"regexp_replace({html}, '(?i)<script[\\s\\S]*?</script>', '', 'g')"
    t = f"regexp_replace({t}, '(?i)<style[\\s\\S]*?</style>', '', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    return V.sql_strip(f"regexp_replace({t}, '\\s{{2,}}', ' ', 'g')")


def _valid(email: str, blocked) -> str:
    e = f"lower({email})"
    host = f"split_part({e}, '@', 2)"
    return f"""(regexp_full_match({e}, '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,10}}')
        AND NOT regexp_matches({host}, {V.q('(^|[.])' + V.words_regex(rules.ASSET_EXTENSIONS) + '([.]|$)')})
        AND NOT regexp_matches({host}, '^[0-9]')
        AND NOT regexp_matches({e}, '@[0-9]+(\\.[0-9]+)?x')
        AND NOT {V.has_word(e, blocked)})"""


def sql_context(text: str) -> str:
    s = f"strpos(lower({text}), lower(email))"
    a, z = f"greatest({s} - 50, 1)", f"least({s} + length(email) + 50, length({text}) + 1)"
    cut = f"replace(substr({text}, CAST({a} AS BIGINT), CAST({z} - {a} AS BIGINT)), chr(10), ' ')"
    return f"CASE WHEN {s} > 0 THEN left({V.sql_strip(cut)}, 100) ELSE 'Extracted from page content' END"


def sql_emails(source: str, key: str, text: str, blocked) -> str:
    """Valid addresses, first per lower-case spelling, with their position."""
    return f"""
      SELECT {key}, email, row_number() OVER (PARTITION BY {key} ORDER BY p) - 1 AS pos FROM (
        SELECT {key}, email, p, row_number() OVER (PARTITION BY {key}, lower(email) ORDER BY p) AS nth FROM (
          SELECT {key}, unnest(l) AS email, generate_subscripts(l, 1) AS p FROM (
            SELECT {key}, regexp_extract_all({text}, {V.q(rules.EMAIL_PATTERN)}) AS l FROM {source}))
        WHERE {_valid("email", blocked)}) WHERE nth = 1"""


def sql_phones(source: str, key: str, text: str) -> str:
    return f"""
      SELECT {key}, phone, row_number() OVER (PARTITION BY {key} ORDER BY p) - 1 AS pos FROM (
        SELECT {key}, phone, min(p) AS p FROM (
          SELECT {key}, {V.sql_strip("ph")} AS phone, p FROM (
            SELECT {key}, unnest(l) AS ph, generate_subscripts(l, 1) AS p FROM (
              SELECT {key}, regexp_extract_all({text}, {V.q(rules.PHONE_PATTERN)}, 1) AS l FROM {source})))
        WHERE length(phone) >= 9 AND NOT regexp_matches(phone, '123456|987654|000000')
        GROUP BY {key}, phone)"""


_EMAILS = sql_emails("documents", "doc_id", "text", V.NO_WORDS)
_ALL_PAGES = f"""
  SELECT page_id, url, html FROM pages UNION ALL
  SELECT doc_id + 1000000000, 'https://' || source || '.example/doc/' || doc_id, text FROM documents"""
_MINED = f"""
  pg AS (SELECT page_id, url, {V.sql_domain('url')} AS site, {sql_text('html')} AS text, html FROM ({_ALL_PAGES})),
  em AS ({sql_emails("pg", "page_id", "text || ' ' || html", V.NO_WORDS)}),
  ph AS ({sql_phones("pg", "page_id", "text")}),
  e1 AS (SELECT site, lower(email) AS k, email, url, page_id, pos, {sql_context('text')} AS ctx FROM em JOIN pg USING (page_id)),
  p1 AS (SELECT site, phone, url, page_id, pos FROM ph JOIN pg USING (page_id))"""
# Headings cut a page into pieces; an address is labelled by the first heading it stands below.
_HEADED = f"""
  cut AS (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '(?i)(<h[1-3](?:\\s[^>]*)?>)', chr(1) || '\\1', 'g'),
            '(?m)^(#{{1,3}}[ \\t]+)', chr(1) || '\\1', 'g'), chr(1)) AS l FROM pg WHERE contains(html, '@')),
  pieces AS (SELECT page_id, unnest(l) AS piece, generate_subscripts(l, 1) AS s FROM cut),
  named_pieces AS (SELECT *, last_value(nullif(head, '') IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY s) AS heading FROM (
    SELECT *, CASE WHEN starts_with(piece, '#') THEN {V.sql_squeeze("regexp_extract(piece, '^#{1,3}[ \\t]+([^\\n]+)', 1)")}
      WHEN s > 1 THEN {V.sql_squeeze("regexp_replace(regexp_extract(piece, '(?is)^<h[1-3][^>]*>(.*?)(</h[1-3]\\s*>|$)', 1), '<[^>]+>', ' ', 'g')")}
      END AS head FROM pieces)),
  headed AS (SELECT site, lower(e) AS k, url, arg_min(heading, (page_id, s)) AS heading FROM (
    SELECT page_id, s, heading, unnest(regexp_extract_all(piece, {V.q(rules.EMAIL_PATTERN)})) AS e FROM named_pieces WHERE heading IS NOT NULL)
    JOIN pg USING (page_id) GROUP BY ALL)"""
_NAME = """CASE WHEN rtrim(P, '/') = '' THEN 'Homepage' WHEN contains(lower(P), 'contact') THEN 'Contact Page'
  WHEN contains(lower(P), 'about') THEN 'About Page' WHEN contains(lower(P), 'team') THEN 'Team Page'
  ELSE rtrim(P, '/') END"""


def sql_page_name(url: str) -> str:
    return _NAME.replace("P,", f"{V.sql_path(url)},").replace("(P)", f"({V.sql_path(url)})")


_BUNDLE = f"""
  WITH {_MINED},
  s AS (SELECT site, count(*) AS n_pages,
          bool_or({V.has_word('lower(text)', rules.CONTACT_SECTION_WORDS)}) AS sect FROM pg GROUP BY site),
  e2 AS (SELECT site, count(DISTINCT k) AS n_emails, arg_min(email, (page_id, pos)) AS primary_email,
           arg_min(url, (page_id, pos)) AS email_url, arg_min(ctx, (page_id, pos)) AS ctx FROM e1 GROUP BY site),
  p2 AS (SELECT site, count(DISTINCT phone) AS n_phones, arg_min(phone, (page_id, pos)) AS primary_phone
         FROM p1 GROUP BY site)
  SELECT site, n_pages, coalesce(n_emails, 0) AS n_emails, coalesce(n_phones, 0) AS n_phones,
    primary_email, primary_phone, coalesce(email_url, 'https://' || site || '/contact-us') AS contact_url,
    CASE WHEN primary_email IS NOT NULL THEN {sql_page_name('email_url')}
         WHEN sect THEN 'Contact page available — visit directly'
         ELSE 'No direct contact info found' END AS source_label,
    CASE WHEN primary_email IS NOT NULL THEN ctx WHEN sect THEN 'Interactive or structured contact section available on website'
         ELSE 'Extracted from page content' END AS source_context,
    coalesce(n_emails, 0) + coalesce(n_phones, 0) > 0 AS found
  FROM s LEFT JOIN e2 USING (site) LEFT JOIN p2 USING (site)"""

_ABS = """CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h
  WHEN starts_with(h, '//') THEN regexp_extract(url, '^([a-z]+):', 1) || ':' || h
  WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h
  ELSE regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || h END"""
_LINK_HOST = "replace(lower(regexp_extract(u, '://([^/?#]*)', 1)), 'www.', '')"
_BASE_HOST = "replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), 'www.', '')"
_AFTER_HOST = "lower(regexp_extract(u, '://[^/?#]*([^#]*)', 1))"

def _decoded(html: str) -> str:
    t = f"regexp_replace({html}, '<!--[\\s\\S]*?-->', '', 'g')"
    t = f"regexp_replace({t}, '(?i)<(script|style)[^>]*>[\\s\\S]*?</(script|style)>', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"')):
        t = f"replace({t}, '{entity}', '{char}')"
    return V.sql_squeeze(f"regexp_replace({t}, '&amp;?', '&', 'g')")


_DECODED = _decoded("html")
_LINKS = f"""
        WITH h AS (SELECT page_id, url,
            regexp_extract_all(regexp_extract(html, '(?i)<footer[^>]*>([\\s\\S]*?)</footer>', 1), {V.q(LI.HREF)}, 1) ||
            regexp_extract_all(regexp_extract(html, '(?i)<nav[^>]*>([\\s\\S]*?)</nav>', 1), {V.q(LI.HREF)}, 1) AS framed,
            regexp_extract_all(html, {V.q(LI.HREF)}, 1) AS every FROM pages),
        x AS (SELECT page_id, url, len(framed) AS nf, unnest(framed || every) AS h,
                     generate_subscripts(framed || every, 1) AS p FROM h),
        a AS (SELECT *, {_ABS} AS u FROM x
              WHERE NOT regexp_matches(h, '^(mailto:|tel:|javascript:)')
                AND NOT regexp_matches(h, '(?i)\\.(pdf|jpg|jpeg|png|gif|svg|zip|mp4|webp|ico|css|js|xml|txt)$')),
        d AS (SELECT page_id, u, min(p) AS p, bool_or(p <= nf) AS framed FROM a
              WHERE {_LINK_HOST} IN ('', {_BASE_HOST}) GROUP BY page_id, u),
        s AS (SELECT page_id, u, p, CASE WHEN framed THEN 5 ELSE 0 END +
                     CASE WHEN {V.has_word(_AFTER_HOST, LINK_WORDS)} THEN 3 ELSE 0 END AS score FROM d),
        ranked AS (SELECT page_id, u AS url, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, p) AS rnk
                   FROM s WHERE score > 0)"""
_USUAL = ", ".join(V.q(p) for p in rules.CONTACT_PAGE_PATHS)

SQL = {
    "contact_pages": f"""
        {_LINKS},
        pg AS (SELECT page_id, 'https://' || {V.sql_domain('url')} AS base FROM pages),
        c AS (SELECT page_id, base || '/' AS url, 0 AS o FROM pg UNION ALL
              SELECT page_id, base || unnest([{_USUAL}]), unnest(range(1, {len(rules.CONTACT_PAGE_PATHS) + 1})) FROM pg UNION ALL
              SELECT page_id, url, 100 + rnk FROM ranked WHERE rnk <= 8),
        g AS (SELECT page_id, url, min(o) AS o FROM c GROUP BY page_id, url)
        SELECT page_id, CAST(k - 1 AS INTEGER) AS pos, url FROM (
          SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o) AS k FROM g) WHERE k <= 14""",
    "evidence_choice": f"""
        WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN {V.sql_strip("text")} ELSE '' END AS t,
                          {V.sql_strip("split_part(text, chr(10), 1)")} AS s FROM documents)
        SELECT doc_id, md5(CASE WHEN length(t) > 200 THEN t WHEN length(s) > 30 THEN s ELSE '(no content available)' END) AS digest,
          CASE WHEN length(t) > 200 THEN 'scraped website content' WHEN length(s) > 30 THEN 'search snippet only' ELSE 'none' END AS source
        FROM d""",
    "last_spellings": """
        WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM conversations),
        g AS (SELECT conv_id, turn, min(p) AS p, arg_max(w, p) AS w FROM w GROUP BY conv_id, turn, lower(w))
        SELECT conv_id, turn, md5(string_agg(w, ' ' ORDER BY p)) AS digest FROM g GROUP BY conv_id, turn""",
    "page_text": f"""
        SELECT page_id, length(t) AS n_chars, md5(t) AS digest
        FROM (SELECT page_id, {sql_text('html')} AS t FROM pages)""",
    # The test pages hold four kinds of entities, some of the first without semicolon.
    "page_text_decoded": f"""
        WITH t AS (SELECT page_id, {_DECODED} AS t FROM pages)
        SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM t""",
    "page_summaries": f"""
        WITH t AS (SELECT page_id, {V.sql_squeeze(
            "regexp_replace(regexp_replace(" + sql_text('html') +
            r", '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[#*`_-]', ' ', 'g')")} AS t FROM pages)
        SELECT page_id, CASE WHEN length(t) > 200 THEN left(t, 200) || '...' WHEN t <> '' THEN t
          ELSE 'X is a leading provider in their industry, specializing in high-quality professional services.'
          END AS summary FROM t""",
    "doc_emails": f"SELECT doc_id, email FROM ({_EMAILS})",
    "doc_emails_default": "SELECT doc_id, email FROM ("
    + sql_emails("documents", "doc_id", "text", rules.BLOCKED_EMAIL_WORDS) + ")",
    "doc_phones": "SELECT doc_id, CAST(pos AS INTEGER) AS pos, phone FROM (" + sql_phones("documents", "doc_id", "text") + ")",
    "email_context": f"""
        SELECT doc_id, email, {sql_context("text")} AS context FROM ({_EMAILS}) JOIN documents USING (doc_id)""",
    "email_first_source": f"""
        WITH e AS ({_EMAILS})
        SELECT doc_id, email, min(doc_id) OVER (PARTITION BY lower(email)) AS source_doc FROM e""",
    "contact_bundle": _BUNDLE,
    "contact_sources": f"""
        WITH {_MINED}, {_HEADED},
        named AS (SELECT site, k, arg_min(email, (page_id, pos)) AS email FROM e1 GROUP BY site, k),
        first AS (SELECT site, k, url, min((page_id, pos)) AS seen FROM e1 GROUP BY site, k, url)
        SELECT site, email, url, {sql_page_name('url')} AS source_label, coalesce(heading, {sql_page_name('url')}) AS heading,
          seen[1] AS page_id, seen[2] AS pos
        FROM first JOIN named USING (site, k) LEFT JOIN headed USING (site, k, url)""",
    "extraction_yield": f"""
        WITH b AS ({_BUNDLE}),
        f AS (
          SELECT 'email' AS field, primary_email IS NOT NULL AS found, contains(primary_email, '.com') AS ok FROM b
          UNION ALL SELECT 'phone', primary_phone IS NOT NULL, length(primary_phone) >= 12 FROM b
          UNION ALL SELECT 'any', found, primary_email IS NOT NULL OR primary_phone IS NOT NULL FROM b)
        SELECT field, count(*) AS n, count(*) FILTER (found) AS found, count(*) FILTER (found AND ok) AS valid,
          count(*) FILTER (found) / count(*) AS rate,
          count(*) FILTER (found AND ok) / count(*) FILTER (found) AS precision
        FROM f GROUP BY field""",
    "contact_links": f"""
        {_LINKS} SELECT page_id, url, score, CAST(rnk AS INTEGER) AS rnk FROM ranked WHERE rnk <= 10""",
    "subpages": f"""
        WITH h AS (SELECT page_id, url, regexp_extract_all(html, {V.q(LI.ANCHOR)}, 1) AS hs,
                          regexp_extract_all(html, {V.q(LI.ANCHOR)}, 2) AS ts FROM pages),
        x AS (SELECT page_id, url, unnest(hs) AS h, unnest(ts) AS t, generate_subscripts(hs, 1) AS p FROM h),
        a AS (SELECT *, {_ABS} AS u FROM x WHERE h <> ''),
        w AS (SELECT page_id, p, rtrim(regexp_extract(u, '^([^?#;]*)', 1), '/') AS u,
                     {_AFTER_HOST} || '? ' || lower({V.sql_strip("regexp_replace(t, '<[^>]+>', ' ', 'g')")}) AS seen,
                     {_LINK_HOST} AS host, {_BASE_HOST} AS base, rtrim(url, '/') AS home,
                     rtrim(lower({V.sql_path('u')}), '/') AS path FROM a),
        k AS (SELECT page_id, u, min(p) AS p FROM w
              WHERE (host = base OR ends_with(host, '.' || base)) AND u <> home
                AND path NOT IN ('', '/en', '/us', '/home', '/index.html', '/index.php')
                AND NOT {V.has_word('seen', SUB_SKIP)} AND {V.has_word('seen', SUB_WORDS)}
              GROUP BY page_id, u)
        SELECT page_id, u AS url, CAST(rnk AS INTEGER) AS rnk FROM (
          SELECT page_id, u, row_number() OVER (PARTITION BY page_id ORDER BY p) AS rnk FROM k) WHERE rnk <= 2""",
    "evidence": f"""
        WITH p AS (SELECT {V.sql_domain('url')} AS site, url, page_id, {sql_text('html')} AS t FROM pages),
        r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS nth FROM p),
        k AS (SELECT * FROM r WHERE nth = 1 OR (nth <= 3 AND length({V.sql_strip('t')}) > 800)),
        b AS (SELECT site, string_agg(CASE WHEN nth = 1 THEN t ELSE chr(10) || chr(10) || '--- SUBPAGE EVIDENCE (' ||
                 {V.sql_path('url')} || ') ---' || chr(10) || t END, '' ORDER BY nth) AS e,
               CASE WHEN count(*) = 1 THEN 'homepage only' ELSE
                 string_agg(CASE WHEN nth = 1 THEN 'homepage' ELSE {V.sql_path('url')} END, ' + ' ORDER BY nth) END AS source_label
              FROM k GROUP BY site)
        SELECT site, length(e) AS n_chars, md5(e) AS digest, source_label FROM b""",
    "external_contact": f"""
        SELECT domain, pos, score FROM (
          SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, pos) AS nth FROM (
            SELECT country AS domain, id AS pos,
              CAST(trust_score + CASE WHEN relevance_reason IS NOT NULL THEN 10 ELSE 0 END AS BIGINT) AS score
            FROM ({V.CLIENTS}))) WHERE nth = 1""",
}

_KEY = f"({V.sql_domain('url')} || rtrim({V.sql_path('url')}, '/'))"
SQL["evidence_linked"] = f"""
    WITH hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, {V.q(LI.HREF)}, 1)[:3]) AS h,
                     generate_subscripts(regexp_extract_all(html, {V.q(LI.HREF)}, 1)[:3], 1) - 1 AS k FROM pages),
    crawl AS (SELECT page_id, url, html FROM pages UNION ALL
      SELECT l.page_id * 10 + k + 1000000000, u, p.html FROM (SELECT *, {_ABS} AS u FROM hrefs) l JOIN pages p ON p.page_id = l.page_id - k - 1),
    homes AS (SELECT {V.sql_domain('url')} AS site, arg_min(page_id, page_id) AS page_id FROM pages GROUP BY 1),
    links AS (SELECT site, s.url, rnk, {_KEY.replace("url", "s.url")} AS key FROM ({SQL["subpages"]}) s JOIN homes USING (page_id)),
    held AS (SELECT {_KEY} AS key, arg_min(html, page_id) AS html FROM crawl GROUP BY 1),
    parts AS (
      SELECT site, url, 1 AS nth, {sql_text('html')} AS t FROM homes JOIN pages USING (page_id) UNION ALL
      SELECT site, url, rnk + 1, {sql_text('html')} FROM links JOIN held USING (key)),
    k AS (SELECT * FROM parts WHERE nth = 1 OR length({V.sql_strip('t')}) > 800),
    b AS (SELECT site, string_agg(CASE WHEN nth = 1 THEN t ELSE chr(10) || chr(10) || '--- SUBPAGE EVIDENCE (' ||
             {V.sql_path('url')} || ') ---' || chr(10) || t END, '' ORDER BY nth) AS e,
           CASE WHEN count(*) = 1 THEN 'homepage only' ELSE
             string_agg(CASE WHEN nth = 1 THEN 'homepage' ELSE {V.sql_path('url')} END, ' + ' ORDER BY nth) END AS source_label
          FROM k GROUP BY site)
    SELECT site, length(e) AS n_chars, md5(e) AS digest, source_label FROM b"""
