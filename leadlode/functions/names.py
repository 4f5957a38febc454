"""Company-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlode import rules
from leadlode.functions.common import SPACE, let, or_none, strip, text_or_empty
from leadlode.functions.urls import clean_domain


def is_invalid_name(name: Column, generic=rules.GENERIC_NAMES) -> Column:
    """Too short or long, a place or menu word, a tagline, or a sentence."""
    n = text_or_empty(name)
    t = strip(n)
    words = F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")
    return (
        (F.length(n) < 2)
        | (F.length(n) > 55)
        | F.lower(t).isin(list(generic))
        | t.rlike(rules.YEAR_TAG_PATTERN)
        | t.rlike(rules.SERVICE_PHRASE_PATTERN)
        | t.endswith(".")
        | (F.size(words) > 7)
    )


def domain_base(domain: Column) -> Column:
    return F.substring_index(clean_domain(domain), ".", 1)


def name_from_domain(domain: Column, overrides: dict[str, str] | None = None) -> Column:
    """Display name of a domain: ``big-foods.com`` -> ``Big Foods``.

    ``overrides`` maps a domain base to the exact brand spelling.
    """
    base = domain_base(domain)
    runs = F.regexp_extract_all(
        F.lower(F.translate(base, "-_", "  ")), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)
    )
    name = F.array_join(F.transform(runs, F.initcap), "")
    for key, spelling in (overrides or {}).items():
        name = F.when(F.lower(base) == key, spelling).otherwise(name)
    return name


def name_from_title(
    title: Column, domain: Column, overrides: dict[str, str] | None = None
) -> Column:
    """Best part of a page title: one that agrees with the domain, else the longest."""
    base = F.translate(domain_base(domain), "-_", "")
    parts = F.filter(
        F.transform(F.split(text_or_empty(title), rules.TITLE_SEPARATORS), strip),
        lambda p: (p != "") & ~is_invalid_name(p),
    )

    def agrees(p):
        plain = F.lower(F.regexp_replace(p, "[^a-zA-Z0-9]", ""))
        return plain.contains(base) | F.contains(base, plain)

    def best(valid):
        longest_first = F.sort_array(
            F.transform(
                valid, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p"))
            )
        )
        return F.coalesce(F.get(F.filter(valid, agrees), 0), F.get(longest_first, 0)["p"])

    return F.coalesce(let(parts, best), name_from_domain(domain, overrides))


def resolve_name(
    verdict_name: Column,
    title: Column,
    domain: Column,
    overrides: dict[str, str] | None = None,
) -> Column:
    """First valid of: the verdict's name, the title's name, the domain's name."""

    def if_valid(name):
        return let(name, lambda n: F.when(~is_invalid_name(n), n))

    return F.coalesce(
        if_valid(strip(text_or_empty(verdict_name))),
        if_valid(name_from_title(title, domain, overrides)),
        name_from_domain(domain, overrides),
    )


def resolve_country(detected: Column, requested: Column) -> Column:
    d = strip(text_or_empty(detected))
    return F.coalesce(
        F.when((F.length(d) > 1) & ~F.lower(d).isin("unknown", "none"), d),
        or_none(strip(text_or_empty(requested))),
        F.lit("Global"),
    )


def is_global_search(country: Column) -> Column:
    return F.lower(strip(text_or_empty(country))).isin(list(rules.GLOBAL_REGION_WORDS))
