from __future__ import annotations

from pyspark.sql import functions as F

from leadlode import rules
from leadlode.operators import clients as CL
from leadlode.operators import outreach as OU

X = F.col("x")


def test_drafts(spark):
    d = spark.createDataFrame([(1, "Subject: One\nHi  you\nSUBJECT: Two: b\nBye\n"), (2, "no head"), (3, None)], "id int, text string")
    got = {r.id: (r.subject, r.body, r.n_words) for r in OU.parse_drafts(d, default_subject="Dflt").collect()}
    assert got == {1: ("Two: b", "Hi  you\nBye", 3), 2: ("Dflt", "no head", 2), 3: ("Dflt", "", 0)}


def test_replies(evaluate):
    d = {k: F.lit("D-" + k) for k in OU.REPLY_FIELDS}
    got = evaluate(OU.parse_reply(X, d), ['{"subject": "S", "objection_type": ""}', "plain words", '{"body": "B"}'])
    assert (got[0].subject, got[0].objection_type, got[0].body) == ("S", "D-objection_type", '{"subject": "S", "objection_type": ""}')
    assert (got[1].body, got[1].subject) == ("plain words", "D-subject")
    assert got[2].body == "B" and got[2].strategy_hint == "D-strategy_hint"


def test_suggestions(evaluate):
    got = evaluate(
        OU.parse_suggestions(X),
        [
            '```json\n[{"industry": " A ", "reason": "r"}, {"industry": "", "reason": "x"}, {"reason": "y"}]\n```',
            '{"note": "n", "list": [{"industry": "B"}]}',
            'oops [{"industry": "C", "reason": "r1"}, {"industry" : "D", "reason":"r2"}',
            '{"a": 1}', "nothing",
        ],
    )
    assert [[(i.industry, i.reason) for i in g] for g in got] == [[("A", "r")], [("B", "")], [("C", "r1"), ("D", "r2")], [], []]


def test_tags(evaluate):
    many = '{"suggested_industries": [" a ", "", "b", "c", "d", "e", "f", "g"]}'
    got = evaluate(OU.industry_tags(X), [many, "```json\n" + many + "\n```", "{}", "bad", '{"suggested_industries": []}'])
    assert got[0] == got[1] == list("abcdef") and got[2] == got[3] == got[4] == list(rules.DEFAULT_INDUSTRY_TAGS)


def test_profile_and_services(evaluate):
    s = "a string, b string, c string, d string"
    got = evaluate(OU.profile_text(*[F.col(c) for c in "abcd"]), [("S", "D", "T", "I"), ("", "D", None, "")], s)
    assert got[0].startswith("CORE BUSINESS: S\nIDEAL CUSTOMER PROFILE: T") and "solutions in I." in got[0]
    assert got[1] == "CORE BUSINESS: D\nIDEAL CUSTOMER PROFILE: B2B Clients\nVALUE PROPOSITION: High quality solutions in B2B."
    assert evaluate(OU.effective_services(*[F.col(c) for c in "abc"]), [("", None, "x", ""), ("", "", "", "")], s) == ["x", rules.DEFAULT_SERVICES]


def test_recipient_and_suggestion(evaluate):
    s = "a string, b string, c string"
    got = evaluate(OU.recipient(*[F.col(c) for c in "abc"]), [("p", "q", "r"), (None, "q", "r"), ("", "", "https://www.x.de/y"), (None, None, None)], s)
    assert [(g.email, g.is_guessed) for g in got] == [("p", False), ("q", False), ("contact@x.de", True), ("contact@company.com", True)]
    got = evaluate(OU.outreach_suggestion(*[F.col(c) for c in "abc"]), [("e", "l", "u"), ("", "l", "u"), (None, None, "u")], s)
    assert got[0].startswith("Primary email (e)") and "InMail" in got[1] and got[2] == "Contact via website form at u."


def test_merge(spark):
    c = spark.createDataFrame([(1, "Acme", "Foods", None, None, "acme.de", "Won"), (2, "Zed", None, "r", "z@z", None, "New")], "id int, name string, industry string, relevance_reason string, email string, website string, status string")
    got = {r.client_id: r for r in OU.mail_merge(c, "Us", "robots", F.col("status") == "New").collect()}
    assert got[1].subject == "robots for Acme" and "Acme's operations in Foods" in got[1].body and got[1].recipient == "contact@acme.de" and got[1].is_guessed
    assert got[2].subject == "Following up: robots for Zed" and "Us's robots" in got[2].body and not got[2].is_guessed


def test_bands(evaluate):
    scores = [100, 85, 84, 70, 65, 50, 49, 0]
    got = evaluate(CL.band_of(F.col("x")), scores, "x int")
    assert got == ["High Intent", "High Intent", "Good Fit", "Good Fit", "Moderate", "Moderate", "Low Intent", "Low Intent"]
    assert evaluate(CL.band_of(F.col("x"), rules.CLIENT_BANDS, "red"), [80, 79, 40, 39], "x int") == ["primary", "tertiary", "orange", "red"]
