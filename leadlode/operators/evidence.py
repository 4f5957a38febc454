"""Evidence text of a site, put together from its home page and sub-pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlode.functions import text as TX
from leadlode.functions import urls
from leadlode.functions.common import or_none, strip, text_or_empty
from leadlode.operators import links as LI

#: Sites that link to one page before its text is sent to several tasks.
HUB_LINKS = 1 << 14


def _cut(c: Column, limit: int | None) -> Column:
    return c if limit is None else F.substring(c, 1, limit)


def html_to_text(pages: DataFrame, decode: bool = False, limit: int | None = None) -> DataFrame:
    html = text_or_empty(F.col("html"))
    body = TX.html_text_decoded(html) if decode else TX.html_text(html)
    return pages.select("page_id", "url", _cut(body, limit).alias("text"))


def assemble_evidence(
    pages: DataFrame,
    max_subpages: int = 2,
    min_chars: int = 100,
    home_chars: int | None = None,
    sub_chars: int | None = None,
    to_text: Callable[[Column], Column] = TX.html_text,
) -> DataFrame:
    """One evidence block per site out of ``site, url, rank, html`` rows.

    The lowest rank of a site is its home page; the next ``max_subpages`` are its
    sub-pages, used when they hold more than ``min_chars`` characters.  The rank
    filter is applied per map task, so a huge site ships only a few rows, and only
    the pages it keeps are turned into text.
    """
    w = Window.partitionBy("site").orderBy("rank")
    chosen = (
        pages.withColumn("nth", F.row_number().over(w))
        .where(F.col("nth") <= max_subpages + 1)
        .select("site", "url", "nth", to_text(text_or_empty(F.col("html"))).alias("text"))
    )
    return _blocks(chosen, min_chars, home_chars, sub_chars)


def site_links(homes: DataFrame, k: int | None = 2, **options) -> DataFrame:
    """``site, rnk, target, key``: the company pages that the home pages (``site, url, html``) link to."""
    found = LI.subpage_links(text_or_empty(F.col("html")), F.col("url"), k, **options)
    return homes.select("site", F.posexplode(found).alias("_i", "target")).select(
        "site", (F.col("_i") + 1).alias("rnk"), "target", urls.canonical(F.col("target")).alias("key")
    )


def linked_pages(links: DataFrame, pages: DataFrame, hub_links: int = HUB_LINKS, to_text: Callable[[Column], Column] = TX.html_text) -> DataFrame:
    """``site, rnk, target, text``: the links that lead to a page of the crawl (``page_id, url, html``).

    Addresses are compared in canonical form; of several captures of a page the lowest ``page_id`` counts.
    Only linked pages leave the crawl table, as text.  A page that over ``hub_links`` sites link to is sent to
    as many tasks as that takes.
    """
    salts = links.groupBy("key").agg(F.ceil(F.count("*") / hub_links).cast("int").alias("salts"))
    captures = pages.select(urls.canonical(F.col("url")).alias("key"), "page_id", "html").join(salts, "key")
    first = Window.partitionBy("key").orderBy("page_id")
    texts = (
        captures.withColumn("_nth", F.row_number().over(first))
        .where(F.col("_nth") == 1)
        .select("key", "salts", to_text(text_or_empty(F.col("html"))).alias("text"))
        .select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "text")
    )
    hubs = salts.where(F.col("salts") > 1).select(F.col("key").alias("_hub"), F.col("salts").alias("_salts"))
    salt = F.pmod(F.xxhash64("site"), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = links.join(hubs, F.col("key") == F.col("_hub"), "left").withColumn("salt", salt)
    return dealt.join(texts, ["key", "salt"]).select("site", "rnk", "target", "text")


def gather_evidence(
    homes: DataFrame,
    pages: DataFrame,
    max_subpages: int = 2,
    min_chars: int = 100,
    home_chars: int | None = None,
    sub_chars: int | None = None,
    to_text: Callable[[Column], Column] = TX.html_text,
    hub_links: int = HUB_LINKS,
    **options,
) -> DataFrame:
    """One evidence block per site: its home page (``site, url, html``) and the pages of the crawl it links to.

    The first ``max_subpages`` company links of a home page are followed by one hop; a link that the crawl does
    not hold, or whose text has at most ``min_chars`` characters, is left out.  Each page table is scanned once.
    """
    links = site_links(homes, max_subpages, **options)
    subs = linked_pages(links, pages, hub_links, to_text).select("site", F.col("target").alias("url"), (F.col("rnk") + 1).alias("nth"), "text")
    own = homes.select("site", "url", F.lit(1).alias("nth"), to_text(text_or_empty(F.col("html"))).alias("text"))
    return _blocks(own.unionByName(subs), min_chars, home_chars, sub_chars)


def _blocks(chosen: DataFrame, min_chars: int, home_chars: int | None, sub_chars: int | None) -> DataFrame:
    """Evidence and its sources per site, from ``site, url, nth, text`` rows; the home page has ``nth`` 1."""
    chosen = chosen.where((F.col("nth") == 1) | (F.length(strip(F.col("text"))) > min_chars))
    path = F.coalesce(or_none(urls.url_path(F.col("url"))), F.col("url"))
    home = F.col("nth") == 1
    part = F.struct(
        "nth",
        F.when(home, "homepage").otherwise(path).alias("name"),
        F.when(home, _cut(F.col("text"), home_chars))
        .otherwise(
            F.concat(
                F.lit("\n\n--- SUBPAGE EVIDENCE ("), path, F.lit(") ---\n"),
                _cut(F.col("text"), sub_chars),
            )
        )
        .alias("body"),
    )
    parts = F.col("parts")
    return (
        chosen.groupBy("site")
        .agg(F.sort_array(F.collect_list(part)).alias("parts"))
        .select(
            "site",
            F.array_join(F.transform(parts, lambda p: p["body"]), "").alias("evidence"),
            F.when(F.size(parts) == 1, "homepage only")
            .otherwise(F.array_join(F.transform(parts, lambda p: p["name"]), " + "))
            .alias("source_label"),
        )
    )


def home_and_about(
    home: DataFrame, about: DataFrame, limit: int | None = None
) -> DataFrame:
    """Older two-page form: home text, blank line, text of ``/about``."""
    both = F.concat(
        text_or_empty(F.col("home_text")), F.lit("\n\n"), text_or_empty(F.col("about_text"))
    )
    return (
        home.select("site", F.col("text").alias("home_text"))
        .join(about.select("site", F.col("text").alias("about_text")), "site", "left")
        .select("site", _cut(strip(both), limit).alias("text"))
    )


def choose_evidence(
    scraped: Column,
    snippet: Column,
    label: Column,
    scraped_chars: int | None = None,
    snippet_chars: int | None = None,
) -> Column:
    """``struct(text, source)``: page text, else the snippet, else a placeholder."""
    s, n = text_or_empty(scraped), text_or_empty(snippet)
    long_page = F.length(strip(s)) > 200
    long_snippet = F.length(strip(n)) > 30
    return F.struct(
        F.when(long_page, strip(_cut(s, scraped_chars)))
        .when(long_snippet, strip(_cut(n, snippet_chars)))
        .otherwise("(no content available)")
        .alias("text"),
        F.when(long_page, F.coalesce(or_none(label), F.lit("scraped website content")))
        .when(long_snippet, "search snippet only")
        .otherwise("none")
        .alias("source"),
    )
