from __future__ import annotations

import random

from pyspark.sql import functions as F

from leadlode.functions import text as TX
from leadlode import rules
from leadlode.operators import candidates as CA
from leadlode.operators import results_page as RP
from leadlode.operators import ordered
from leadlode.operators.ordered import running_sums

HIT = "query string, page int, pos int, url string, title string, content string"


def hits(spark, *rows):
    return spark.createDataFrame([("q", p, i, u, t, "") for p, i, u, t in rows], HIT)


def test_first_failing_rule_names_the_reason(spark):
    h = hits(
        spark,
        (1, 0, "https://acme.com/", "Acme"),
        (1, 1, "https://cn.alibaba.com/", "x"),
        (1, 2, "https://x.gov/", "x"),
        (1, 3, "https://acme.com/blog/a", "x"),
        (1, 4, "https://best.io/", "Top Fintech Companies 2026"),
        (1, 5, "https://me.wordpress.com/", "x"),
        (1, 6, "https://bb.com/a/b/c", "x"),
        (1, 7, "nothing", "x"),
        (1, 8, "https://a.io/", None),
        (1, 9, "", "x"),
    )
    got = [r.reject_reason for r in CA.filter_candidates(h).orderBy("pos").collect()]
    assert got == [
        None, "excluded_domain", "government", "url_pattern", "listicle_title", "implausible_domain",
        "not_homepage", "implausible_domain", "implausible_domain", "no_domain",
    ]


def test_title_patterns(evaluate):
    x = F.col("x")
    bad = [
        "Top Seattle, WA Fintech Companies 2026", "best b2b SOFTWARE", " List of firms", "12 largest banks",
        "Companies in Berlin", "A ranking", "top-rated gyms", "market size", "What is CRM", "CAGR", "the top 5",
    ]
    good = ["Acme GmbH", "Stop companies", "Topical creams", "Our company", "Rankings-free zone"[:0] or "Home"]
    assert evaluate(TX.matches(x, rules.LISTICLE_PATTERNS), bad) == [True] * len(bad)
    assert evaluate(TX.matches(x, rules.LISTICLE_PATTERNS), good) == [False] * len(good)


def test_dedupe_and_overflow_against_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(p, i, f"https://d{rng.randint(0, 25)}.com/", "t") for p in range(6) for i in range(12)]
    rows += [(p, 100 + i, "https://hot.com/", "t") for p in range(6) for i in range(30)]
    seen, want = set(), []
    for p in range(6):
        page = []
        for _, i, u, _ in sorted(r for r in rows if r[0] == p):
            if u not in seen:
                seen.add(u)
                page.append((p, i, u))
        want += page[:3]  # what overflows stays seen
    got = CA.dedupe_candidates(CA.filter_candidates(hits(spark, *rows)), ["query"], per_page=3)
    assert sorted((r.page, r.pos, r.url) for r in got.collect()) == sorted(want)


def test_funnel_adds_up(spark):
    h = hits(spark, (1, 0, "https://a1.com/", ""), (1, 1, "https://a1.com/", ""), (1, 2, "https://x.gov/", ""), (2, 0, "https://a1.com/", ""))
    got = {r.reject_reason: r.n for r in CA.candidate_funnel(CA.filter_candidates(h)).collect()}
    assert got == {"kept": 1, "repeat": 2, "government": 1}


def test_mocked_search_stops_at_the_target(spark):
    h = hits(spark, (1, 0, "https://one.com/", "One"), (1, 1, "https://two.com/", "Two"), (2, 0, "https://three.com/", "Three"))
    kept = CA.dedupe_candidates(CA.filter_candidates(h), ["query"])
    assert [r.domain for r in CA.take_target(kept, n=2).orderBy("rnk").collect()] == ["one.com", "two.com"]


def test_sources_and_totals(spark):
    a = spark.createDataFrame([("q", 1, "u1", "t", "c")], "query string, page int, url string, title string, content string")
    b = spark.createDataFrame([("q", 1, "u2", "t", "c"), ("q", 2, "u3", None, None)], "query string, page int, url string, title string, description string")
    both = CA.union_hits(CA.normalize_hits(a, "meta", 1), CA.normalize_hits(b, "api", 2, content="description"))
    got = {(r.page, r.url, r.title) for r in CA.first_nonempty_source(both).collect()}
    assert got == {(1, "u1", "t"), (2, "u3", "")}

    c = spark.createDataFrame([("q", 1, True), ("q", 1, False), ("q", 3, True), ("r", 1, False)], "query string, page int, accepted boolean")
    rows = {(r["query"], r.page): (r.processed_total, r.qualified_total) for r in CA.running_totals(c).collect()}
    assert rows == {("q", 1): (2, 1), ("q", 3): (3, 2), ("r", 1): (1, 0)}


def test_running_sums_over_several_chunks(spark):
    rows = [("hot", i, i % 7) for i in range(0, 900, 3)] + [("b", 5, 1), ("b", 70, 2), (None, 4, 1), (None, 400, 5)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    total, want = {}, set()
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + v
        want.add((k, o, total[k]))
    got = {(r.k, r.o, r.t) for r in running_sums(df, ["k"], "o", {"v": "t"}, rows=50).collect()}
    assert got == want


def test_ranges_are_balanced_for_sparse_time_ids(spark):
    """One key with half of the rows, ids in nanoseconds and in bursts: no key has much more than ``rows`` in a range."""
    at = lambda i: 1_700_000_000_000_000_000 + (i // 100) * 86_400_000_000_000 + (i % 100) * 4096
    rows = [("hot" if i % 2 else f"k{i % 10}", at(i), 1) for i in range(4000)] + [("hot", None, 1)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    cuts = ordered.range_cuts(df, "o", 200)
    assert 15 <= len(cuts) <= 20
    sizes = df.groupBy(ordered.range_number("o", cuts, "bigint").alias("at")).count().collect()
    assert len(sizes) > 15 and max(r["count"] for r in sizes) <= 400
    want = [sum(c <= v for c in cuts) for v in (at(0), at(1999), at(3999))]
    got = spark.createDataFrame([(at(0),), (at(1999),), (at(3999),)], "o bigint").select(ordered.range_number("o", cuts, "bigint")).collect()
    assert [r[0] for r in got] == want
    numbered = ordered.numbered_rows(df, ["k"], "o", rows=200).where("k = 'hot'").orderBy(F.asc_nulls_first("o")).collect()
    assert [r["nth"] for r in numbered] == list(range(1, 2002))
    picked = df.where("k = 'hot'").orderBy(F.desc("o")).limit(3).union(df.where("k = 'k4'").limit(1))
    some = ordered.numbers_of(df.where("o is not null"), picked, ["k"], "o").collect()
    assert sorted((r["k"], r["nth"]) for r in some) == [("hot", 1998), ("hot", 1999), ("hot", 2000), ("k4", 1)]


def test_seen_domains_stay_out(spark):
    h = CA.with_domain(hits(spark, (1, 0, "https://a1.com/", ""), (1, 1, "https://b1.com/", "")))
    seen = spark.createDataFrame([("a1.com",)], "domain string")
    assert [r.domain for r in CA.exclude_seen(h, seen).collect()] == ["b1.com"]


SERP = """
<a rel="x" class="result__a" href="//r.test/l/?uddg=https%3A%2F%2Facme.com%2Fa%2Bb&amp;rut=1"><b>Acme</b> Ltd</a>
<a class="result__snippet" href="#">Makes <b>things</b></a>
<a class="result__a" href="//plain.org/x"> </a><a class="result__snippet" href="#"> </a>
<a class="result__a" href="/local">L</a>
<a class="other" href="https://no.com/">no</a>"""


def test_results_page(spark):
    p = spark.createDataFrame([(1, SERP), (2, '<x href="?uddg=https%3A%2F%2Fbare.com%2F" >'), (3, None)], "page_id int, html string")
    got = RP.parse_result_pages(p, link_class="result__a", snippet_class="result__snippet").orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.url, r.title, r.content) for r in got] == [
        (1, 0, "https://acme.com/a+b", "Acme Ltd", "Makes things"),
        (1, 1, "https://plain.org/x", "Plain", RP.DEFAULT_SNIPPET),
        (2, 0, "https://bare.com/", "Bare", RP.DEFAULT_SNIPPET),
    ]


def test_phrases(spark, evaluate):
    raw = "Here are queries:\n- university official website\n2. college  site\n* short\n\n• third one here\nfourth one here\nTitle:"
    assert evaluate(RP.clean_phrases(F.col("x")), [raw, None]) == [
        ["university official website", "college  site", "third one here"], [],
    ]
    r = spark.createDataFrame([(" Foods ", "Lyon"), ("Foods", ""), (" Foods ", "Lyon")], "industry string, location string")
    got = {x.phrase for x in RP.build_phrases(r).collect()}
    assert "Foods official website in Lyon" in got and "Foods homepage" in got and len(got) == 6
    assert evaluate(RP.location_text(F.col("a"), F.col("b")), [("Lyon", "France"), ("", "France"), ("", None)], "a string, b string") == [
        "Lyon, France", "France", "",
    ]


def test_a_run_is_deduplicated_by_itself(spark):
    df = hits(spark, *[(1, i, f"https://d{i}.com/", "t") for i in range(15)])
    three = df.withColumn("query", F.explode(F.array(*[F.lit(q) for q in "abc"])))
    cleaned = CA.filter_candidates(three)
    assert CA.dedupe_candidates(cleaned, ["query"]).count() == 45
    assert CA.dedupe_candidates(cleaned, ["query"], per_page=4).count() == 12


def test_rows_without_a_page_are_counted(spark):
    c = spark.createDataFrame([("q", None, True), ("q", 1, False), ("q", 1, True), (None, None, True)], "query string, page int, accepted boolean")
    got = {(r["query"], r.page): (r.processed_total, r.qualified_total) for r in CA.running_totals(c).collect()}
    assert got == {("q", None): (1, 1), ("q", 1): (3, 2), (None, None): (1, 1)}
