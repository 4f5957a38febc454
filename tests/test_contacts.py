from __future__ import annotations

import time

import random
import re

from pyspark.sql import functions as F

from leadlode import rules
from leadlode.functions import common
from leadlode.functions import contacts as C
from leadlode.functions import text as TX
from leadlode.operators import contacts as CO
from leadlode.operators import evidence as EV
from leadlode.operators import links as LI

X = F.col("x")

PAGE = """<html><head><title>Acme</title><script>var a='no@script.io'</script></head><body>
<nav><a href="/contact">Contact</a><a href="/shop">Shop</a></nav>
<p>Call +49 30 1234 5678 or write Sales@Acme.org, sales@acme.org.</p>
<a href='mailto:jobs@acme.org?subject=x'>mail</a>
<span data-cfemail="422b2c242d02232f256c2d3025">x</span> info [at] acme [dot] org
<a href="https://www.linkedin.com/in/jane-doe">J</a> <a href="https://linkedin.com/company/acme">A</a>
<a href="https://other.net/contact">off</a> <a href="/logo.png">img</a> <a href="team/../people">p</a>
<footer><a href="/imprint">Imprint</a></footer></body></html>"""


def test_valid_email_table(evaluate):
    bad = [
        "swiper@7.0.5-bundle.min", "vendor@1.2.3-chunk.min.js", "image@2x.png", "style@theme.min.css",
        "font@fontawesome.woff2", "jquery@3.6.0.min", "bootstrap@4.5.0.bundle", "node_modules@npm.cdn",
        "info@reactive.com", "a@1shop.com", "no-at.com", "a@b.c", None,
    ]
    good = [
        "contact@foodmachinery.com", "sales@chinapack.cn", "info@biofoodtech.de", "support@agrifood.co.uk",
        "export@foodprocessing.com",
    ]
    assert evaluate(C.is_valid_email(X), bad) == [False] * len(bad)
    assert evaluate(C.is_valid_email(X), good) == [True] * len(good)
    assert evaluate(C.is_valid_email(X, blocked_words=()), ["info@reactive.com"]) == [True]


def test_find_emails_equals_the_plain_pattern(evaluate):
    rng = random.Random(7)
    alphabet = "aaabbbcc..@@1 -é"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["x@y.co1z@w.com", "a@b.cc@d.ee", "é.a@b.cc", "@a@b.com"]
    want = [re.findall(rules.EMAIL_PATTERN, t) for t in texts]
    assert sum(map(len, want)) > 20
    assert evaluate(C.find_emails(X), texts) == want


def test_phones(evaluate):
    def brute(text):
        out = []
        for p in re.findall(rules.PHONE_PATTERN, text):
            p = p.strip()
            if len(p) >= 9 and not any(w in p for w in rules.PLACEHOLDER_DIGITS) and p not in out:
                out.append(p)
        return out

    rng = random.Random(3)
    texts = ["".join(rng.choice("0123456789+-. ()x") for _ in range(40)) for _ in range(200)]
    texts.append("call +49 30 9876 5555 or +49 30 9876 5555, not 123456789")
    assert evaluate(C.find_phones(X), texts) == [brute(t) for t in texts]


def test_decoded_and_hidden_addresses(evaluate):
    assert evaluate(C.protected_emails(X), [PAGE]) == [["info@amg.org"]]
    assert evaluate(C.mailto_targets(X), [PAGE]) == [["jobs@acme.org"]]
    assert evaluate(C.deobfuscated_emails(X), [PAGE, "a (at) b (DOT) com; c at d dot net"]) == [
        ["info@acme.org"], ["a@b.com", "c@d.net"],
    ]


def test_profiles(evaluate):
    got = evaluate(C.find_profiles(X), [PAGE, "https://linkedin.com/in/a_b https://linkedin.com/in/a_b", ""])
    assert got[0].company.endswith("/company/acme") and got[0].best == got[0].company
    assert got[1].people == ["https://linkedin.com/in/a_b"] and got[1].best == got[1].people[0]
    assert got[2].best is None


def test_distinct_by_and_last_value(evaluate):
    items = F.split(X, ",")
    assert evaluate(common.distinct_by(items, F.lower), ["b,A,a,B,c,a", "x", ""]) == [["b", "A", "c"], ["x"], [""]]
    assert evaluate(common.last_value_distinct_by(items, F.lower), ["b,A,a,B,c,a"]) == [["B", "a", "c"]]


def test_masking(evaluate):
    assert evaluate(C.mask_email(X), ["sales@acme.org"]) == ["s***@acme.org"]
    assert evaluate(C.mask_phone(X), ["+49 30 123"]) == ["+** ** *23"]


def test_source_context(evaluate):
    text = "a" * 80 + "\nX@y.de " + "b" * 80
    got = evaluate(TX.source_context(X, F.lit("x@Y.de")), [text, "none"])
    at = text.lower().find("x@y.de")
    assert got == [text[at - 50 : at + 56].replace("\n", " ").strip()[:100], "Extracted from page content"]


def test_bundle_of_a_site(spark):
    pages = spark.createDataFrame(
        [
            (1, "https://acme.org/", PAGE),
            (2, "https://www.acme.org/contact", "<p>SALES@acme.org, +49 30 1234 5678</p>"),
            (3, "https://quiet.net/", "<p>Our office</p>"),
            (4, "https://mute.net/", "<p>x</p>"),
        ],
        "page_id bigint, url string, html string",
    )
    rows = {r.site: r for r in CO.contact_bundle(pages).collect()}
    a = rows["acme.org"]
    assert (a.n_pages, a.n_emails, a.n_phones, a.n_profiles) == (2, 5, 1, 2)
    assert a.primary_email == "Sales@Acme.org" and a.source_label == "Homepage" and a.found
    assert rows["quiet.net"].source_label == "Contact page available — visit directly"
    assert rows["mute.net"].source_label == "No direct contact info found"
    assert rows["mute.net"].contact_url == "https://mute.net/contact-us" and not rows["mute.net"].found

    values = CO.contact_values(CO.mine_pages(pages))
    sources = [r for r in CO.email_sources(values).orderBy("page_id", "pos").collect() if r.email.lower() == "sales@acme.org"]
    assert [r.page for r in sources] == ["Homepage", "Contact Page"] and len({r.email for r in sources}) == 1


def test_an_address_keeps_all_its_pages_each_once(spark):
    page = "<p>mail a@acme.org</p>"
    rows = [(k, f"https://acme.org/p{k // 2}", page) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = CO.email_sources(CO.contact_values(CO.mine_pages(pages))).collect()
    assert len(got) == 30 and {r.page_id for r in got} == set(range(0, 60, 2))


def test_heading_above(evaluate):
    page = (
        "a@b.cc <h1 class='x'>Sales <b>team</b></h1><p>x A@b.cc<h2> <i></i></h2>c@d.ee<header>h@d.ee</header>"
        "<h3>Press</h3><a href='mailto:press@d.ee'>c@d.ee</a><h4>x</h4>z@d.ee"
    )
    text = "a@b.cc\n# Intro\n## Sales\nx a@b.cc\n### SOURCE_URL: u\nb@c.dd\n# After"
    got = evaluate(C.headed_emails(X), [page, text, "x@y.zz", ""])
    first, seen = {}, [[(r["email"].lower(), r["heading"]) for r in rows] for rows in got]
    for email, heading in seen[0]:
        first.setdefault(email, heading)
    assert first == {"a@b.cc": "Sales team", "c@d.ee": "Sales team", "h@d.ee": "Sales team", "press@d.ee": "Press", "z@d.ee": "Press"}
    assert dict(seen[1]) == {"a@b.cc": "Sales", "b@c.dd": "Sales"} and seen[2:] == [[], []]


def test_sighted_emails(evaluate):
    text = "q" * 70 + "\nX@y.de, " + "b" * 20 + " myx@y.de and x@y.de" + "c" * 3 + "\n" + "d" * 90
    got = [(r["email"], r["context"]) for r in evaluate(C.sighted_emails(X), [text])[0]]
    assert [e for e, _ in got] == ["X@y.de", "myx@y.de", "x@y.deccc"]
    for email, context in got:
        at = text.index(" " + email) + 1 if email != "X@y.de" else text.index(email)
        assert context == text[max(0, at - 50) : at + len(email) + 50].replace("\n", " ").strip()[:100]


def test_page_mining_is_linear(spark):
    """Four times the addresses of one page cost about four times as much, not sixteen times."""

    def seconds(n):
        body = "".join(f"<h2>Desk {k}</h2><p>{'word ' * 10} desk{k}@acme.org</p>" for k in range(n))
        pages = spark.createDataFrame([(1, "https://acme.org/", body)], "page_id bigint, url string, html string")
        start = time.perf_counter()
        rows = CO.email_sources(CO.contact_values(CO.mine_pages(pages), headings=True)).collect()
        assert len(rows) == n and all(r.label == "Desk " + r.email[4:-9] for r in rows)
        return time.perf_counter() - start

    seconds(50)
    few, many = (min(seconds(n) for _ in range(2)) for n in (1000, 4000))
    assert many < 7 * few + 1


def test_external_fill(spark):
    b = spark.createDataFrame([("a", None, "No", 0, False), ("b", "x@b", "Homepage", 1, True)], "site string, primary_email string, source_label string, n_emails bigint, found boolean")
    e = spark.createDataFrame([("a", "out@a"), ("a", "zz@a"), ("a", ""), ("b", "out@b")], "site string, email string")
    got = {r.site: (r.primary_email, r.source_label, r.n_emails, r.found) for r in CO.fill_from_external(b, e).collect()}
    assert got == {"a": ("out@a", "External contact data", 1, True), "b": ("x@b", "Homepage", 1, True)}


def test_contact_links(spark):
    pages = spark.createDataFrame([(1, "https://acme.org/x/", PAGE)], "page_id bigint, url string, html string")
    got = [(r.url, r.score) for r in LI.rank_contact_links(pages).orderBy("rnk").collect()]
    assert got == [
        ("https://acme.org/imprint", 8), ("https://acme.org/contact", 8), ("https://acme.org/shop", 5),
        ("https://acme.org/x/people", 3),
    ]
    off = [r.url for r in LI.rank_contact_links(pages, same_site_only=False).collect()]
    assert "https://other.net/contact" in off and not any("linkedin" in u for u in off)


def test_subpages(spark):
    html = (
        '<a href="/about">About</a><a href="/x">Our <b>Products</b></a><a href="/team/bio">about him</a>'
        '<a href="https://sub.acme.org/services?x=1#y">S</a><a href="https://else.net/about">no</a><a href="/">about</a>'
    )
    pages = spark.createDataFrame([(1, "https://www.acme.org/", html)], "page_id bigint, url string, html string")
    got = [r.url for r in LI.discover_subpages(pages, k=None).orderBy("rnk").collect()]
    assert got == ["https://www.acme.org/about", "https://www.acme.org/x", "https://sub.acme.org/services"]


def test_candidate_pages(evaluate):
    got = evaluate(
        LI.candidate_pages(X, F.array(F.lit("https://a.com/contact"), F.lit("https://a.com/z"), F.lit("https://a.com/y"), F.lit("https://a.com/w"))),
        ["https://a.com/"],
    )[0]
    assert len(got) == 14 and got[0] == "https://a.com/" and got[12:] == ["https://a.com/z", "https://a.com/y"]


def test_html_text_forms(evaluate):
    html = "<p>A &amp; B</p><!-- hidden --><script>x</script><style>y</style> <b>C</b>\n\n<i>D</i>"
    assert evaluate(TX.html_text_decoded(X), [html, "<p>a</p> b", None]) == ["A & B C D", "a b", None]
    assert "A &amp; B" in evaluate(TX.html_text(X), [html])[0]
    assert evaluate(TX.html_text(X, 3), ["<p>abcdef</p>"]) == ["abc"]


def test_summary_and_words(evaluate):
    got = evaluate(TX.page_summary(X, F.lit("Acme")), ["# Hi [link](http://x) `a`", "w " * 150, " "])
    assert got[0] == "Hi link a" and got[1].endswith("...") and len(got[1]) == 203 and got[2].startswith("Acme is a")
    assert evaluate(TX.word_count(X), [" a  b\nc ", "", None]) == [3, 0, 0]


def test_external_pick(spark):
    c = spark.createDataFrame(
        [("a", 0, "x", 80, None), ("a", 1, "y", 75, "CEO"), ("a", 2, "z", 85, ""), ("b", 0, "q", None, None)],
        "domain string, pos int, value string, confidence int, position string",
    )
    assert {r.domain: r.value for r in CO.pick_external_contact(c).collect()} == {"a": "y", "b": "q"}


def test_evidence_follows_links_of_the_home_page(spark):
    about = "<p>" + "about us " * 30 + "</p>"
    home = "<p>home</p><a href='/about/'>x</a><a href='http://www.acme.org/services?q=1'>y</a><a href='/contact'>z</a>"
    homes = spark.createDataFrame(
        [("acme.org", "https://acme.org/", home), ("lone.org", "https://lone.org/", "<a href='/company'>c</a>"), ("null.org", "https://null.org/", None)],
        "site string, url string, html string",
    )
    pages = spark.createDataFrame(
        [(9, "https://www.acme.org/about", "<p>newer</p>"), (3, "http://acme.org/about/#top", about), (4, "https://acme.org/contact", about),
         (5, "https://acme.org/services", "<p>short</p>"), (6, "https://other.org/company", about)],
        "page_id bigint, url string, html string",
    )
    got = {r.site: r for r in EV.gather_evidence(homes, pages, max_subpages=3).collect()}
    text = ("about us " * 30).strip()
    assert got["acme.org"].source_label == "homepage + /about + /contact"
    assert got["acme.org"].evidence == f"home x y z\n\n--- SUBPAGE EVIDENCE (/about) ---\n{text}\n\n--- SUBPAGE EVIDENCE (/contact) ---\n{text}"
    assert (got["lone.org"].source_label, got["null.org"].evidence) == ("homepage only", "")


def test_a_page_that_many_sites_link_to_is_sent_to_several_tasks(spark):
    rows = [(f"s{k}", k % 3 + 1, "https://hub.org/about", "hub.org/about") for k in range(200)] + [("t", 1, "https://t.org/about", "t.org/about")]
    links = spark.createDataFrame(rows, "site string, rnk int, target string, key string")
    pages = spark.createDataFrame([(1, "https://hub.org/about", "<p>hub</p>"), (2, "https://t.org/about/", "<p>t</p>")], "page_id bigint, url string, html string")
    got = EV.linked_pages(links, pages, hub_links=50).collect()
    assert sorted((r.site, r.rnk, r.text) for r in got) == sorted((s, n, "t" if s == "t" else "hub") for s, n, _, _ in rows)
