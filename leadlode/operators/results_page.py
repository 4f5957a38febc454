"""Saved results pages -> hit rows, and search phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlode import rules
from leadlode.functions.common import or_none, strip, text_or_empty
from leadlode.functions.urls import clean_domain

DEFAULT_SNIPPET = rules.DEFAULT_SNIPPET


def _plain(fragment: Column) -> Column:
    return strip(F.regexp_replace(fragment, "<[^>]+>", ""))


def _unwrap(href: Column) -> Column:
    """Follow a redirect parameter, add a missing scheme, decode the URL."""
    target = F.regexp_extract(href, r"uddg=([^\"&\s]+)", 1)
    raw = (
        F.when(target != "", target)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .otherwise(href)
    )
    # A plus sign is literal in a path; only percent escapes are decoded.
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def parse_result_pages(
    pages: DataFrame,
    html: str = "html",
    link_class: str | None = None,
    snippet_class: str | None = None,
) -> DataFrame:
    """One row per result link of a page: ``pos, url, title, content``.

    ``link_class`` / ``snippet_class`` narrow the anchors and snippets to an HTML
    class.  Anchors without the class are a redirect list as a fall-back.
    """
    body = text_or_empty(F.col(html))
    marker = "" if link_class is None else f'class="{link_class}"[^>]*'
    anchor = rf'<a[^>]*{marker}href="([^"]+)"[^>]*>([\s\S]*?)</a>'
    hrefs = F.regexp_extract_all(body, F.lit(anchor), F.lit(1))
    titles = F.regexp_extract_all(body, F.lit(anchor), F.lit(2))
    if link_class is not None:
        bare = F.regexp_extract_all(body, F.lit(r'uddg=([^"&\s]+)'), F.lit(1))
        bare_titles = F.regexp_extract_all(
            body, F.lit(rf'class="{link_class}"[^>]*>([\s\S]*?)</a>'), F.lit(1)
        )
        titles = F.when(F.size(hrefs) > 0, titles).otherwise(bare_titles)
        hrefs = F.when(F.size(hrefs) > 0, hrefs).otherwise(bare)
    snippets = (
        F.array().cast("array<string>")
        if snippet_class is None
        else F.regexp_extract_all(
            body, F.lit(rf'class="{snippet_class}[^"]*"[^>]*>([\s\S]*?)</'), F.lit(1)
        )
    )
    nodes = F.transform(
        hrefs,
        lambda h, i: F.struct(
            _unwrap(h).alias("url"),
            _plain(text_or_empty(F.get(titles, i))).alias("title"),
            _plain(text_or_empty(F.get(snippets, i))).alias("content"),
        ),
    )
    keep = [c for c in pages.columns if c not in (html, "url", "title", "content", "pos")]
    node = F.col("node")
    url = node["url"]
    return (
        pages.select(*keep, F.posexplode(nodes).alias("pos", "node"))
        .where(url.startswith("http") & (clean_domain(url) != "") & (F.length(url) > 10))
        .select(
            *keep,
            "pos",
            url.alias("url"),
            F.coalesce(
                or_none(node["title"]), F.initcap(F.substring_index(clean_domain(url), ".", 1))
            ).alias("title"),
            F.coalesce(or_none(node["content"]), F.lit(DEFAULT_SNIPPET)).alias("content"),
        )
    )


def clean_phrases(raw: Column, limit: int = 3, preambles=rules.PHRASE_PREAMBLES) -> Column:
    """Search phrases out of a bulleted answer: no bullets, preambles or headings."""
    lines = F.transform(
        F.split(text_or_empty(raw), r"\r?\n"), lambda l: strip(F.regexp_replace(strip(l), r"^[-*•\d.\s]+", ""))
    )
    opening = rules.any_of(["^" + p.replace(".", r"\.") for p in preambles])
    return F.slice(
        F.filter(
            lines, lambda l: (F.length(l) > 5) & ~l.endswith(":") & ~F.lower(l).rlike(opening)
        ),
        1,
        limit,
    )


def location_text(city: Column, country: Column) -> Column:
    return F.concat_ws(
        ", ", or_none(strip(text_or_empty(city))), or_none(strip(text_or_empty(country)))
    )


def build_phrases(requests: DataFrame, templates=rules.PHRASE_TEMPLATES) -> DataFrame:
    """The fixed search phrases of every distinct request (``industry, location``)."""
    place = F.when(F.col("location") != "", F.concat(F.lit(" in "), F.col("location"))).otherwise("")
    phrases = F.array(
        *[F.concat(strip(F.col("industry")), F.lit(" " + t), place) for t in templates]
    )
    return (
        requests.select("industry", text_or_empty(F.col("location")).alias("location"))
        .distinct()
        .select("industry", "location", F.posexplode(phrases).alias("variation", "phrase"))
    )
