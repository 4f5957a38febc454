from __future__ import annotations

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from leadlode.functions import urls
from leadlode.operators import candidates as CA

X = F.col("x")


def test_clean_domain(evaluate):
    cases = {
        "https://www.Shop.Example.com:8080/a?b#c": "shop.example.com",
        "http://a.b/c d": "a.b",
        "www.plain.org/path": "plain.org",
        "plain.org:99/x": "plain.org",
        "http:nothing": "",
        "": "",
        None: "",
        "https://user:pw@host.com/": "user",
        "www.www.twice.com": "www.twice.com",
    }
    assert evaluate(urls.clean_domain(X), list(cases)) == list(cases.values())


@pytest.mark.parametrize("excluded", ["made-in-china.com"])
def test_suffix_rule(spark, evaluate, excluded):
    domains = ["made-in-china.com", "cn.made-in-china.com", "notmade-in-china.com", "com"]
    assert evaluate(urls.under_any(X, [excluded]), domains) == [True, True, False, False]
    d = spark.createDataFrame([(x,) for x in domains], "domain string")
    rules = spark.createDataFrame([(excluded,)], "domain string")
    assert {r.domain for r in CA.domains_under(d, rules).collect()} == set(domains[:2])


def test_blocked_starter_domains(evaluate):
    from leadlode.rules import STARTER_EXCLUDED_DOMAINS

    blocked = [
        "made-in-china.com", "cn.made-in-china.com", "alibaba.com", "supplier.alibaba.com",
        "globalsources.com", "tradeindia.com", "thomasnet.com", "ec21.com", "indiamart.com",
    ]
    assert all(evaluate(urls.under_any(X, STARTER_EXCLUDED_DOMAINS), blocked))


def test_plausible_domain(evaluate):
    good = ["acme.com", "acme.co.uk", "shop.acme.international", "acme.museum", "x1.io"]
    bad = [
        "", "acme", "10.0.0.1", "acme.com:80", "acme.com/x", "a.io", "acme.123", "me.wordpress.com",
        "wordpress.com", "acme.c", "acme.verylongtld", None,
    ]
    assert evaluate(urls.is_plausible_domain(X), good) == [True] * len(good)
    assert evaluate(urls.is_plausible_domain(X), bad) == [False] * len(bad)


def test_homepage_like(evaluate):
    cases = {
        "https://a.com": True, "https://a.com/": True, "https://a.com/about-us/": True,
        "https://a.com/x/y": True, "https://a.com/x/y/z": False, "https://a.com/blog/x": False,
        "https://a.com/x?y=/a/b/c": True, "": False,
    }
    assert evaluate(urls.is_homepage_like(X), list(cases)) == list(cases.values())


def test_government_and_fragments(evaluate):
    assert evaluate(urls.is_government(X), ["x.gov", "my.milk.com", "a.com"]) == [True, True, False]
    assert evaluate(urls.is_government(X, strict=True), ["x.gov", "my.milk.com", "a.gov.uk"]) == [True, False, True]
    assert evaluate(urls.has_skip_fragment(X), ["https://a.com/BLOG/x", "https://a.com/?q=1", "https://a.com/"]) == [
        True, True, False,
    ]


def test_absolutise_agrees_with_the_standard_library(evaluate):
    bases = ["https://a.com/x/y.html?q=1#f", "http://b.org", "https://c.de/k/"]
    hrefs = [
        "/p", "p", "../p", "./p", "p/../q", "../../../p", "//cdn.net/x", "https://o.com/y", "?z=1",
        "/a/./b/../c", "p/", "..", ".", "/a/..", "q?x=../y", "mailto:a@b.c", "#top", "",
    ]
    pairs = [(h, b) for b in bases for h in hrefs]
    got = evaluate(urls.absolutise(F.col("h"), F.col("b")), pairs, "h string, b string")
    for (h, b), g in zip(pairs, got):
        want = urljoin(b, h)
        if "#" in h or h == "":
            continue  # fragments are dropped by the callers
        assert g == want, (h, b)


def test_page_name(evaluate):
    cases = {
        "https://a.com/": "Homepage", "https://a.com/Contact-us": "Contact Page", "/about/": "About Page",
        "https://a.com/our-team": "Team Page", "https://a.com/x/": "/x", "x": "/x", None: "Homepage",
    }
    assert evaluate(urls.page_name(X), list(cases)) == list(cases.values())


def test_website_guess(evaluate):
    got = evaluate(
        urls.website_or_guess(F.col("w"), F.col("n")),
        [("a.com", "A"), ("", "Big Foods & Co"), (None, None), ("http://a.com", "")],
        "w string, n string",
    )
    assert [(r.url, r.is_guessed) for r in got] == [
        ("https://a.com", False), ("https://www.bigfoodsco.com", True), (None, False), ("http://a.com", False),
    ]
    assert evaluate(urls.with_scheme(X), [" a.com ", "http://b.c"]) == ["https://a.com", "http://b.c"]
