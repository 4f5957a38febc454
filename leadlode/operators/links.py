"""Link discovery.  A page's links never leave its row: no shuffle at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlode import rules
from leadlode.functions import urls
from leadlode.functions.common import contains_any, distinct_by, str_array, strip, text_or_empty

HREF = r"""(?i)href=["']([^"'\s#>]+)["']"""
ANCHOR = r"""(?i)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>([\s\S]*?)</a>"""


def _hrefs(fragment: Column) -> Column:
    return F.regexp_extract_all(fragment, F.lit(HREF), F.lit(1))


def _plain_host(url: Column) -> Column:
    return F.replace(F.lower(urls.authority(url)), F.lit("www."), F.lit(""))


def _target_text(url: Column) -> Column:
    return F.lower(F.concat(urls.url_path(url), F.lit("?"), urls.url_query(url)))


def contact_links(
    html: Column,
    base: Column,
    limit: int | None = 10,
    same_site_only: bool = True,
    words=rules.CONTACT_LINK_WORDS,
    skip_extensions=rules.LINK_SKIP_EXTENSIONS,
    skip_hosts=rules.LINK_SKIP_HOSTS,
) -> Column:
    """Ranked ``array<struct(score, url)>`` of a page's likely contact links.

    Five points for a link in the footer or menu, three for a contact word.
    """
    framed = F.concat(
        _hrefs(F.regexp_extract(html, r"(?i)<footer[^>]*>([\s\S]*?)</footer>", 1)),
        _hrefs(F.regexp_extract(html, r"(?i)<nav[^>]*>([\s\S]*?)</nav>", 1)),
    )
    n_framed = F.size(framed)
    home = _plain_host(base)
    suffix = "(?i)" + "(?:" + "|".join(e.replace(".", r"\.") for e in skip_extensions) + r")\z"

    links = F.transform(
        F.concat(framed, _hrefs(html)),
        lambda h, i: F.struct(
            urls.absolutise(h, base).alias("url"), h.alias("href"), i.alias("pos")
        ),
    )
    usable = F.filter(
        links, lambda l: ~l["href"].rlike(r"^(?:mailto:|tel:|javascript:)") & ~l["href"].rlike(suffix)
    )

    def on_site(l):
        host = _plain_host(l["url"])
        same = (host == "") | (host == home)
        if same_site_only:
            return same
        return same | ~contains_any(host, skip_hosts)

    # An address first seen in the frame part keeps the frame bonus.
    unique = distinct_by(F.filter(usable, on_site), lambda l: l["url"])
    scored = F.transform(
        unique,
        lambda l: F.struct(
            (
                F.when(l["pos"] < n_framed, 5).otherwise(0)
                + F.when(contains_any(_target_text(l["url"]), words), 3).otherwise(0)
            ).alias("score"),
            l["pos"].alias("pos"),
            l["url"].alias("url"),
        ),
    )
    ranked = F.transform(
        F.sort_array(
            F.transform(
                F.filter(scored, lambda l: l["score"] > 0),
                lambda l: F.struct((-l["score"]).alias("s"), l["pos"].alias("p"), l["url"].alias("u")),
            )
        ),
        lambda l: F.struct((-l["s"]).alias("score"), l["u"].alias("url")),
    )
    return ranked if limit is None else F.slice(ranked, 1, limit)


def rank_contact_links(pages: DataFrame, k: int | None = 10, **options) -> DataFrame:
    """``page_id, url, score, rnk`` of each page's best contact links."""
    found = contact_links(text_or_empty(F.col("html")), F.col("url"), k, **options)
    return pages.select("page_id", F.posexplode(found).alias("i", "link")).select(
        "page_id",
        F.col("link.url").alias("url"),
        F.col("link.score").alias("score"),
        (F.col("i") + 1).alias("rnk"),
    )


def subpage_links(
    html: Column,
    home: Column,
    limit: int | None = 2,
    words=rules.SUBPAGE_WORDS,
    skip_words=rules.SUBPAGE_SKIP_WORDS,
) -> Column:
    """Addresses of a site's own company pages, in document order."""
    hrefs = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    labels = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))
    home_host = _plain_host(home)
    home_url = F.regexp_replace(home, "/+$", "")
    anchors = F.filter(
        F.zip_with(
            hrefs,
            labels,
            lambda h, t: F.struct(
                strip(h).alias("href"),
                F.lower(strip(F.regexp_replace(t, "<[^>]+>", " "))).alias("label"),
            ),
        ),
        lambda a: (a["href"] != "") & ~a["href"].rlike(r"(?i)^(?:#|javascript:|mailto:|tel:)"),
    )
    resolved = F.transform(
        anchors, lambda a: F.struct(urls.absolutise(a["href"], home).alias("url"), a["label"].alias("label"))
    )

    def wanted(a):
        host = _plain_host(a["url"])
        path = F.regexp_replace(F.lower(urls.url_path(a["url"])), "/+$", "")
        seen = F.concat(_target_text(a["url"]), F.lit(" "), a["label"])
        return (
            ((host == home_host) | host.endswith(F.concat(F.lit("."), home_host)))
            & ~path.isin(list(rules.SUBPAGE_HOME_PATHS))
            & ~contains_any(seen, skip_words)
            & contains_any(seen, words)
        )

    bare = F.transform(
        F.filter(resolved, wanted),
        lambda a: F.regexp_replace(F.regexp_extract(a["url"], r"^([^?#;]*)", 1), "/+$", ""),
    )
    found = F.array_distinct(F.filter(bare, lambda u: u != home_url))
    return found if limit is None else F.slice(found, 1, limit)


def discover_subpages(pages: DataFrame, k: int | None = 2, **options) -> DataFrame:
    """``page_id, url, rnk`` of the company pages linked from each page."""
    found = subpage_links(text_or_empty(F.col("html")), F.col("url"), k, **options)
    return pages.select("page_id", F.posexplode(found).alias("i", "url")).select(
        "page_id", "url", (F.col("i") + 1).alias("rnk")
    )


def candidate_pages(site: Column, discovered: Column, limit: int = 14) -> Column:
    """Pages worth fetching for contacts: usual addresses, then discovered links."""
    base = F.regexp_replace(site, "/+$", "")
    usual = F.transform(str_array(rules.CONTACT_PAGE_PATHS), lambda p: F.concat(base, p))
    return F.slice(F.array_distinct(F.concat(F.array(site), usual, discovered)), 1, limit)
