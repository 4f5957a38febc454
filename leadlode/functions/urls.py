"""URL and domain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlode import rules
from leadlode.functions.common import contains_any, or_none, strip, text_or_empty

AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def authority(url: Column) -> Column:
    """``host[:port]`` of an absolute URL, empty otherwise."""
    return F.regexp_extract(url, AUTHORITY, 1)


def url_path(url: Column) -> Column:
    """Path of a URL without query, fragment or trailing ``;parameters``."""
    return F.regexp_replace(F.regexp_extract(url, PATH, 1), r";[^/]*$", "")


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def clean_domain(url: Column) -> Column:
    """Lower-case host without port and leading ``www.``; '' when there is none."""
    url = text_or_empty(url)
    host = F.when(url.startswith("http"), authority(url)).otherwise(F.substring_index(url, "/", 1))
    return F.regexp_replace(F.substring_index(F.lower(host), ":", 1), r"^www\.", "")


def canonical(url: Column) -> Column:
    """What the spellings of one page share: host without ``www.`` and port, path without closing slashes."""
    return F.concat(clean_domain(url), F.regexp_replace(url_path(url), "/+$", ""))


def parent_suffixes(domain: Column) -> Column:
    """The domain itself and every parent of it: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(domain, r"\.")
    return F.transform(
        labels, lambda _label, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")
    )


def under_any(domain: Column, roots) -> Column:
    """True when the domain equals one of the roots or lies below one.

    The list is folded into the plan as a hash set: no join, no shuffle.
    """
    roots = list(roots)
    if not roots:
        return F.lit(False)
    return F.exists(parent_suffixes(domain), lambda s: s.isin(roots))


def is_government(domain: Column, strict: bool = False) -> Column:
    """``.gov`` / ``.mil`` anywhere in the domain; ``strict`` needs a whole label."""
    if strict:
        return domain.rlike(r"\.(?:gov|mil)(?:\.|$)")
    return domain.contains(".gov") | domain.contains(".mil")


def has_skip_fragment(url: Column, fragments=rules.URL_SKIP_FRAGMENTS) -> Column:
    return contains_any(F.lower(url), fragments)


def is_plausible_domain(
    domain: Column, tlds=rules.PLAUSIBLE_TLDS, platforms=rules.PLATFORM_ROOTS
) -> Column:
    """Does the domain look like a company's own home?"""
    d = F.lower(strip(text_or_empty(domain)))
    labels = F.split(d, r"\.")
    n = F.size(labels)
    tld = F.element_at(labels, -1)
    second = F.get(labels, n - 2)
    well_formed = (
        (d != "")
        & ~d.rlike(r"[:/]")
        & ~d.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
        & (n >= 2)
        & ~tld.rlike(r"^\d+$")
        & (F.length(second) >= 2)
    )
    two_part = F.concat_ws(".", second, tld)
    known = tld.isin(list(tlds)) | ((n >= 3) & two_part.isin(list(tlds)))
    return F.coalesce(
        well_formed & ~under_any(d, platforms) & (known | tld.rlike(r"^\p{L}{2,6}$")), F.lit(False)
    )


def is_homepage_like(
    url: Column, landing=rules.LANDING_PATHS, editorial=rules.EDITORIAL_PATH_FRAGMENTS
) -> Column:
    """A landing path, or a short path that does not look editorial."""
    path = F.regexp_replace(F.lower(url_path(url)), "/+$", "")
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    return F.coalesce(
        (url != "") & (path.isin(list(landing)) | (~contains_any(path, editorial) & (depth <= 2))),
        F.lit(False),
    )


def page_name(url: Column) -> Column:
    """Readable name of a page: Homepage, Contact Page, ... or its path."""
    raw = text_or_empty(url)
    path = F.regexp_replace(F.when(raw.startswith("http"), url_path(raw)).otherwise(raw), "/+$", "")
    low = F.lower(path)
    return (
        F.when(path == "", "Homepage")
        .when(low.contains("contact"), "Contact Page")
        .when(low.contains("about"), "About Page")
        .when(low.contains("team"), "Team Page")
        .when(path.startswith("/"), path)
        .otherwise(F.concat(F.lit("/"), path))
    )


def _resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments from an absolute path."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        F.slice(segments, 2, F.size(segments)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def absolutise(href: Column, base: Column) -> Column:
    """Resolve a link against the address of the page that holds it."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), authority(base))
    base_path = F.regexp_extract(base, PATH, 1)
    folder = F.coalesce(or_none(F.regexp_extract(base_path, r"^(.*/)", 1)), F.lit("/"))
    link_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    link_tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    joined = F.when(href.startswith("/"), link_path).otherwise(F.concat(folder, link_path))
    resolved = F.when(joined.rlike(r"/\.{1,2}(/|$)"), _resolve_dots(joined)).otherwise(joined)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href == "", base)
        .when(link_path == "", F.concat(root, base_path, link_tail))
        .otherwise(F.concat(root, resolved, link_tail))
    )


def with_scheme(website: Column) -> Column:
    site = strip(text_or_empty(website))
    return F.when(site.rlike("^https?://"), site).otherwise(F.concat(F.lit("https://"), site))


def website_or_guess(website: Column, name: Column) -> Column:
    """``struct(url, is_guessed)``: the given site, else one guessed from the name."""
    site = text_or_empty(website)
    slug = F.regexp_replace(F.lower(text_or_empty(name)), "[^a-z0-9]", "")
    given = F.when(site.startswith("http"), site).otherwise(F.concat(F.lit("https://"), site))
    return F.struct(
        F.when(site != "", given)
        .when(text_or_empty(name) != "", F.concat(F.lit("https://www."), slug, F.lit(".com")))
        .alias("url"),
        ((site == "") & (text_or_empty(name) != "")).alias("is_guessed"),
    )
