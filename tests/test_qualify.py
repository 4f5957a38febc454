from __future__ import annotations

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leadlode.functions import names
from leadlode.operators import evidence as EV
from leadlode.operators import metrics as ME
from leadlode.operators import qualify as QU
from leadlode.operators import relevance as RE

X = F.col("x")


def verdict(**over):
    base = {
        "is_junk": False, "industry_match": True, "lead_type": "NEEDS_SERVICE", "confidence": 85, "reason": "ok",
        "official_company_name": "", "detected_country": "Germany",
    }
    return json.dumps({**base, **over})


CASES = [
    ("a.com", "PharmaWorks", "Maker of generic tablets", "", verdict(), "NEEDS_SERVICE"),
    ("b.com", "MediDist", "Distributor with its own fleet of vans. We run our own fleet.", "", verdict(), "HAS_SIMILAR_SERVICE"),
    ("c.com", "Top 10 Pharma Companies", "The list", "", verdict(), "JUNK"),
    ("d.com", "TradeHub", "A B2B marketplace to find suppliers", "", verdict(), "JUNK"),
    ("e.com", "SalesBoost", "Cloud CRM platform for teams", "", verdict(), "INDUSTRY_MISMATCH"),
    ("f.com", "NoAnswer", "Plain", "", None, "NEEDS_SERVICE"),
    ("g.com", "Broken", "Plain", "", "{oops", "UNKNOWN"),
    ("h.com", "Fenced", "Plain", "", "```json\n" + verdict(lead_type="has_similar_service") + "\n```", "HAS_SIMILAR_SERVICE"),
    ("i.com", "Unsure", "Plain", "", verdict(confidence=49), "INDUSTRY_MISMATCH"),
    ("j.com", "Odd type", "Plain", "", verdict(lead_type="maybe"), "NEEDS_SERVICE"),
    ("k.com", "No flag", "Plain", "", '{"industry_match": true}', "UNKNOWN"),
    ("l.com", "Junk by answer", "Plain", "", verdict(is_junk=True, confidence=0), "JUNK"),
    ("m.com", "Text confidence", "Plain", "", verdict(confidence="85"), "NEEDS_SERVICE"),
    ("n.com", "Reason says so", "Plain", "runs a town", verdict(reason="Fleet. They have our fleet"), "HAS_SIMILAR_SERVICE"),
    ("o.com", "Split phrase", "Plain", "x " * 60 + "we use own", verdict(reason="fleet of trucks"), "HAS_SIMILAR_SERVICE"),
    ("p.com", "Cut word", "y" * 60 + " down fleet " + "z" * 54, "", verdict(), "NEEDS_SERVICE"),
    ("q.com", "Late junk", "ok", "word " * 400 + " browse 1,000+ suppliers", verdict(), "JUNK"),
]


def evaluated(spark, industry="Pharma"):
    c = spark.createDataFrame([(d, n, s, t) for d, n, s, t, _, _ in CASES], "domain string, name string, snippet string, scraped string")
    v = spark.createDataFrame([(d, j) for d, _, _, _, j, _ in CASES], "domain string, raw_json string")
    return QU.apply_verdicts(c, v, industry)


def test_outcomes(spark):
    got = {r.domain: r.outcome for r in evaluated(spark).collect()}
    assert got == {c[0]: c[5] for c in CASES}
    # The word test on the target matches inside words, so "Hospitality" counts as software.
    assert {r.domain: r.outcome for r in evaluated(spark, "Hospitality").collect()}["e.com"] == "NEEDS_SERVICE"


def test_gate_and_cards(spark):
    rows = QU.accepted(evaluated(spark).withColumns({"title": F.col("name"), "url": F.lit("u")}))
    assert sorted(r.domain for r in rows.collect()) == ["a.com", "b.com", "f.com", "h.com", "j.com", "m.com", "n.com", "o.com", "p.com"]
    cards = {r.domain: r for r in QU.company_cards(rows, "Pharma", country="France").collect()}
    assert cards["a.com"].country == "Germany" and cards["f.com"].country == "Global"
    assert cards["f.com"].snippet == "Verified operating business in Pharma (f.com)"
    assert cards["b.com"].leadType == "has_similar_service"
    gated = rows.sparkSession.createDataFrame(
        [(None, 70, "x"), (50, 90, "x"), (None, None, None), (80, 1, "Pending Review")],
        "matchConfidence int, trustScore int, trustStatus string",
    )
    assert gated.where(QU.passes_reader_gate(60)).count() == 2
    assert gated.where(QU.reviewed_and_scored()).count() == 2


def test_unlisted_marketplace_is_junk_by_content(evaluate):
    texts = [
        "Welcome. Verified suppliers worldwide, post an RFQ today", "Browse 1,200+ manufacturers here",
        "corporate information for pharmaceutical firms", "We make steel pipes",
    ]
    got = evaluate(QU.junk_match(X), texts)
    assert got[0] == "Verified suppliers" and got[1] == "Browse 1,200+ manufacturers" and got[2] and got[3] is None


def test_card_snippet(evaluate):
    got = evaluate(
        QU.card_snippet(F.col("s"), F.col("r"), F.lit("Acme"), F.lit("Foods")),
        [("Jane is Vice  President of sales at Acme since 2010", "Makes jam"), ("short", ""), ("x" * 300, "r"), ("Chief Executive Officer", None)],
        "s string, r string",
    )
    assert got == [
        "Makes jam", "Acme is a verified operating company in Foods.", "x" * 280,
        "Acme is an established operating business in the Foods sector.",
    ]


def test_names(evaluate):
    bad = ["", "x", "a" * 56, "United States", "Acme (2026)", "Best logistics", "A sentence.", "a b c d e f g h", None]
    assert evaluate(names.is_invalid_name(X), bad) == [True] * len(bad)
    assert evaluate(names.is_invalid_name(X), ["Acme", "3M", "Big Foods Ltd"]) == [False] * 3
    assert evaluate(names.name_from_domain(X), ["big-foods.com", "abc123def.io", "3m.com", "a_b.org"]) == [
        s.title() for s in ("big foods", "abc123def", "3m", "a b")
    ]
    assert evaluate(names.name_from_domain(X, {"acme": "ACME Inc"}), ["www.acme.com"]) == ["ACME Inc"]
    cases = [
        ("Home | Big Foods - Jams", "bigfoods.com"), ("Jams and more | Fine Jars", "xyz.com"), ("Home", "big-foods.com"),
        (None, "x-y.com"), ("Order fulfillment | best", "ab.com"), ("•••", "ab.com"),
    ]
    assert evaluate(names.name_from_title(F.col("t"), F.col("d")), cases, "t string, d string") == [
        "Big Foods", "Jams and more", "Big Foods", "X Y", "Ab", "Ab",
    ]
    assert evaluate(
        names.resolve_name(F.col("v"), F.col("t"), F.col("d")),
        [("Acme AG", "t", "d.com"), ("Best of all", "Nice Jam", "d.com"), ("", "", "d-e.com")],
        "v string, t string, d string",
    ) == ["Acme AG", "Nice Jam", "D E"]
    assert evaluate(names.resolve_country(F.col("a"), F.col("b")), [("Peru", "x"), ("unknown", "Chile"), ("", " "), ("X", None)], "a string, b string") == [
        "Peru", "Chile", "Global", "Global",
    ]
    assert evaluate(names.is_global_search(X), [None, " Any ", "France"]) == [True, True, False]


def test_relevance_against_two_document_tf_idf(spark):
    profile, stop = "AI robotics vision and robotics solutions", ["and", "the"]
    docs = ["Robotics and vision for the farm farm", "", "  ", "and the", "nothing shared here", "AI ai AI", "über Vision", "x"]

    def brute(text):
        if not text.strip():
            return 0.5

        def tf(t):
            return Counter(w for w in re.findall(r"\w\w+", t.lower()) if w not in stop)

        a, b = tf(profile), tf(text)
        if not b:
            return 0.0
        idf = {w: math.log(3 / (1 + (w in a) + (w in b))) + 1 for w in {*a, *b}}

        def norm(c):
            return math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))

        return sum(a[w] * idf[w] * b[w] * idf[w] for w in a) / (norm(a) * norm(b))

    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    got = {r.doc_id: r.score for r in RE.relevance_score(d, profile, stop, digits=None).collect()}
    for i, t in enumerate(docs):
        assert abs(got[i] - brute(t)) < 1e-12, t
    empty = {r.doc_id: r.score for r in RE.relevance_score(d, "and", stop).collect()}
    assert empty[3] == 0.5 and empty[0] == 0.0
    assert "the" in RE.spark_stop_words(spark)


def test_evidence(spark):
    rows = [("a", "https://a.com/", 0, "home " * 5), ("a", "https://a.com/x", 1, "y" * 150), ("a", "https://a.com/z", 2, "tiny"), ("b", "https://b.com", 5, "solo")]
    rows += [("hot", f"https://h.com/{i}", i, "t" * 200) for i in range(500)]
    p = spark.createDataFrame(rows, "site string, url string, rank int, html string")
    got = {r.site: r for r in EV.assemble_evidence(p).collect()}
    assert got["a"].source_label == "homepage + /x" and "--- SUBPAGE EVIDENCE (/x) ---\nyyy" in got["a"].evidence
    assert got["b"].source_label == "homepage only" and got["b"].evidence == "solo"
    assert got["hot"].source_label == "homepage + /1 + /2"
    cut = {r.site: r for r in EV.assemble_evidence(p, home_chars=4, sub_chars=10).collect()}
    assert cut["a"].evidence.startswith("home\n\n") and cut["a"].evidence.endswith("\n" + "y" * 10)


def test_evidence_choice_and_two_pages(spark, evaluate):
    got = evaluate(
        EV.choose_evidence(F.col("a"), F.col("b"), F.col("c")),
        [("x" * 201, "", ""), ("x" * 200, "y" * 31, "l"), (None, "y", "l"), ("x" * 300, "", "home + /a")],
        "a string, b string, c string",
    )
    assert [g.source for g in got] == ["scraped website content", "search snippet only", "none", "home + /a"]
    h = spark.createDataFrame([("a", "H"), ("b", "H")], "site string, text string")
    t = spark.createDataFrame([("a", "T")], "site string, text string")
    assert {r.site: r.text for r in EV.home_and_about(h, t).collect()} == {"a": "H\n\nT", "b": "H"}


def test_metrics(spark):
    truth = [(i, i < 120) for i in range(250)]
    pred = [(i, (i < 113) or (120 <= i < 128)) for i in range(250)]
    m = ME.classification_metrics(
        spark.createDataFrame(pred, "id int, predicted boolean"), spark.createDataFrame(truth, "id int, actual boolean"), "id"
    ).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (113, 8, 7, 122)
    assert [round(100 * v, 1) for v in (m.accuracy, m.precision, m.recall, m.specificity, m.f1)] == [94.0, 93.4, 94.2, 93.8, 93.8]
    nothing = ME.classification_metrics(
        spark.createDataFrame([], "id int, predicted boolean"), spark.createDataFrame([], "id int, actual boolean"), "id"
    ).first()
    assert nothing.tp == 0 and nothing.precision is None


def test_batch_hook(spark):
    def shout(batches):
        for b in batches:
            yield b.assign(x=b.x.str.upper())

    df = spark.createDataFrame([("a",)], "x string")
    assert QU.apply_batch_fn(df, shout, "x string").first().x == "A"


def test_cards_have_the_contacts_of_their_evidence(spark):
    text = "Call +49 30 1234 5678 or mail Sales@acme.org, sales@ACME.org, x@acme.org; https://www.linkedin.com/company/acme"
    rows = [("a", "https://acme.org/contact", "Acme", "", text), ("b", "https://b.org/", "B", "write b@b-mail.org", None), ("c", "https://c.org/", "C", None, " ")]
    c = spark.createDataFrame(rows, "domain string, url string, title string, snippet string, evidence string").selectExpr(
        "*", "'' AS official_company_name", "'x' AS detected_country", "'because' AS reason", "80 AS confidence",
        "'NEEDS_SERVICE' AS lead_type", "'verdict' AS verdict_source",
    )
    got = {r.domain: r for r in QU.company_cards(c, "Pharma", evidence="evidence").collect()}
    a = got["a"]
    assert (a.email, a.phone, a.emails, a.phones) == ("Sales@acme.org", "+49 30 1234 5678", ["Sales@acme.org", "x@acme.org"], ["+49 30 1234 5678"])
    assert "linkedin.com/company/acme" in a.linkedin and a.contactSource.page == "Contact Page" and a.contactSource.context.startswith("Call")
    assert got["b"].email == "b@b-mail.org" and got["b"].contactSource.page == "Homepage"
    assert (got["c"].email, got["c"].phones, got["c"].contactSource) == (None, [], None)
    assert "email" not in QU.company_cards(c, "Pharma").columns


@pytest.mark.parametrize("least", [0.05, 0.3, 0.6, 0.95])
def test_many_profiles_equal_one_by_one(spark, least):
    rnd = random.Random(int(least * 100))
    vocabulary = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    texts = [(k, " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(1, 30)))) for k in range(60)]
    texts += [(60, None), (61, ""), (62, " the ! "), (None, "w1 w2"), (63, "other words only"), (64, texts[0][1])]
    wanted = [(k, " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(1, 12)))) for k in range(12)]
    wanted += [(12, texts[0][1]), (13, None), (14, "the"), (None, "w1")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = RE.profile_matches(docs, spark.createDataFrame(wanted, "profile_id long, profile string"), least, ("the",), digits=None)
    found = {(r["profile_id"], r["doc_id"]): r["score"] for r in got.collect()}
    assert got.columns == ["profile_id", "doc_id", "score"]

    def counts(text):
        return Counter(t for t in re.findall(r"\w{2,}", (text or "").lower()) if t != "the")

    want = {}
    for p, profile in wanted[:-1]:
        for d, text in texts:
            a, b = counts(profile), counts(text)
            if d is None or not a or not b:
                continue
            one, two = ({t: n * (1 if t in other else RE.LONE_WEIGHT) for t, n in of.items()} for of, other in ((a, b), (b, a)))
            norms = [sum(x * x for x in v.values()) ** 0.5 for v in (one, two)]
            want[p, d] = sum(n * b[t] for t, n in a.items()) / (norms[0] * norms[1])
    assert found.keys() == {k for k, v in want.items() if v >= least - 1e-12}
    assert all(abs(found[k] - want[k]) < 1e-9 for k in found)


def test_many_profiles_index_only_rare_tokens(spark):
    """A token of every text is left out of the index as long as the rest of the profile suffices."""
    tokens = spark.createDataFrame([(1, 4, t, 1) for t in ("all", "some", "few", "one")], "_p long, mass long, token string, m long")
    seen = spark.createDataFrame([("all", 1000), ("some", 100), ("few", 10), ("one", 1)], "token string, df long")
    index = {r["token"]: r for r in RE.profile_index(tokens, seen, 0.5).collect()}
    assert 0.25 < RE.needed_share(0.5) < 0.5 and set(index) == {"one", "few", "some"} and index["one"]["reach"] == 1


def test_many_profiles_do_not_read_a_text_again_for_each_pair(spark, monkeypatch):
    """Texts meet the profiles once, in the task that holds their tokens, with those tokens only that a profile has."""
    plans, tokens, plain = [], [], RE.write_shared

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        if {"all_doc", "token"} <= set(df.columns):
            tokens.append({r["token"] for r in df.collect()})
        return plain(df)

    monkeypatch.setattr(RE, "write_shared", spy)
    docs = spark.createDataFrame([(k, f"some words of text {k} and ww{k}") for k in range(20)], "doc_id long, text string")
    profiles = spark.createDataFrame([(1, "some words"), (2, "text words")], "profile_id long, profile string")
    assert RE.profile_matches(docs, profiles, 0.1).count() == 40
    assert "counts" not in plans[-1] and plans[-1].count("Exchange hashpartitioning(") == plans[-1].count("Exchange hashpartitioning(_d") == 1
    assert tokens == [{"some", "words", "text"}]


def test_many_profiles_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "some words")], "profile_id long, profile string")
    assert RE.profile_matches(none, one).count() == 0
    with pytest.raises(ValueError):
        RE.profile_matches(none, one, 0)
