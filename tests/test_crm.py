from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from leadlode.operators import clients as CL
from leadlode.operators import crm
from leadlode.operators import leads as LE
from leadlode.operators.components import connected_components

NOW = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


def test_labels_stay_right_when_one_client_owns_most_rows(spark):
    rng = random.Random(1)
    ids = rng.sample(range(100000), 3000)
    rows = [(i, 7 if rng.random() < 0.6 else rng.randint(0, 50), 1, rng.choice(["outreach", "followup", "negotiation", "x"])) for i in ids]
    df = spark.createDataFrame(rows, "id bigint, client_id bigint, company_id int, email_type string")
    word = {"outreach": "Cold Outreach", "followup": "Follow-up", "negotiation": "Negotiation Reply", "x": "Email"}
    seen, want = defaultdict(int), {}
    for i, c, k, t in sorted(rows):
        seen[c, k, t] += 1
        want[i] = f"{word[t]} {seen[c, k, t]}"
    for chunk in (100, 1 << 20):
        got = {r.id: r.label for r in crm.label_emails(df, rows=chunk).collect()}
        assert got == want


def test_log_is_continued(spark):
    s = "id bigint, client_id bigint, company_id int, email_type string"
    old = spark.createDataFrame([(1, 1, 1, "outreach"), (2, 1, 1, "outreach"), (3, 2, 1, "x")], s)
    new = spark.createDataFrame([(4, 1, 1, "outreach"), (5, 2, 1, "outreach"), (6, 2, 1, "x")], s)
    got = {r.id: (r.label, r.status) for r in crm.append_history(old, new, NOW).collect()}
    assert got == {4: ("Cold Outreach 3", "Draft"), 5: ("Cold Outreach 1", "Draft"), 6: ("Email 2", "Draft")}


CLIENT = "id bigint, company_id int, name string, website string, status string, trust_score int, email string, phones string, created_at timestamp_ntz"
NEW = "seq bigint, company_id int, name string, website string, status string, trust_score int, email string, phones string"


def test_save_then_overlay(spark):
    old = spark.createDataFrame([(5, 1, "Acme", "https://acme.com", "Pending", 10, None, None, None), (6, 2, "Acme", None, "Won", 1, None, None, None)], CLIENT)
    new = spark.createDataFrame(
        [
            (1, 1, "ACME", None, "Qualified", None, "a@acme.com", "1, 2"),
            (2, 1, "Acme Foods", "HTTPS://ACME.COM", None, 80, None, None),
            (3, 1, "Fresh", "https://f.com", None, None, None, None),
            (4, 1, "Fresher", "https://F.com", None, None, "f@f.com", None),
            (5, 2, "Fresh", "", None, None, None, None),
        ],
        NEW,
    )
    got = {r.id: r for r in crm.upsert_clients(old, new, NOW).collect()}
    assert set(got) == {5, 6, 9, 11}
    assert (got[5].name, got[5].website, got[5].status, got[5].trust_score, got[5].email) == (
        "Acme Foods", "HTTPS://ACME.COM", "Qualified", 80, "a@acme.com",
    )
    assert (got[6].name, got[6].status) == ("Acme", "Won")
    assert (got[9].name, got[9].email, got[9].status, got[9].trust_score) == ("Fresher", "f@f.com", "Pending", 0)
    assert got[11].company_id == 2 and got[9].created_at is not None


def test_linked_saves_against_union_find(spark):
    rng = random.Random(4)
    n = 300
    rows = [
        (i + 1, 1, f"n{rng.randint(0, 120)}", "hot" if rng.random() < 0.3 else (f"w{rng.randint(0, 150)}" if rng.random() < 0.7 else None),
         rng.choice([None, "Won", "Cold"]), rng.choice([None, i]), None, None)
        for i in range(n)
    ]
    old_rows = [(i, 1, f"n{i * 7}", f"w{i * 5}", "Pending", 0, None, None, None) for i in range(1, 15)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    incoming = {("n", r[2]) for r in rows} | {("w", r[3]) for r in rows if r[3]}
    for r in rows:
        find(("n", r[2]))
        if r[3]:
            parent[find(("w", r[3]))] = find(("n", r[2]))
    for o in old_rows:
        keys = [k for k in (("n", o[2]), ("w", o[3])) if k in incoming]
        for a, b in zip(keys, keys[1:]):
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for r in rows:
        groups[find(("n", r[2]))].append(r)
    want = {o[0]: (o[2], o[3], o[4], o[5]) for o in old_rows}
    for root, members in groups.items():
        hit = [o[0] for o in old_rows if any(k in incoming and find(k) == root for k in (("n", o[2]), ("w", o[3])))]
        target = min(hit) if hit else 14 + min(m[0] for m in members)
        base = list(want.get(target, (None, None, "Pending", 0)))
        for m in members:
            for j, v in enumerate((m[2], m[3], m[4], m[5])):
                base[j] = v if v is not None else base[j]
        want[target] = tuple(base)
    got = crm.upsert_clients(spark.createDataFrame(old_rows, CLIENT), spark.createDataFrame(rows, NEW), NOW).collect()
    assert {r.id: (r.name, r.website, r.status, r.trust_score) for r in got} == want


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [("hub", f"s{i:04d}") for i in range(500)]
    e = spark.createDataFrame(chain + star, "src string, dst string")
    labels = {r.node: r.label for r in connected_components(e).collect()}
    assert len(labels) == 61 + 501
    assert {labels[n] for n in labels if n.startswith("c")} == {"c000"}
    assert {labels[n] for n in labels if not n.startswith("c")} == {"hub"}


def test_update_is_scoped_to_the_company(spark):
    c = spark.createDataFrame([(1, 1, "A", None, "Pending", 1, None, None, None), (2, 1, "B", None, "Won", 2, None, None, None)], CLIENT)
    ch = spark.createDataFrame([(1, 1, "Won", None), (2, 9, "Cold", 5)], "id bigint, company_id int, status string, trust_score int")
    got = {r.id: (r.status, r.trust_score) for r in crm.update_clients(c, ch).collect()}
    assert got == {1: ("Won", 1), 2: ("Won", 2)}
    sent = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "id bigint, company_id int")
    assert {r.id: r.status for r in crm.mark_contacted(c, sent).collect()} == {1: "Contacted", 2: "Won"}


def test_stages(evaluate):
    got = evaluate(
        crm.stage_of(F.col("x")),
        [None, "", "Qualified", "email sent", "PROPOSAL SENT", "Won", "closed", "Cold"],
    )
    assert got == ["New Leads", "New Leads", "New Leads", "Contacted", "In Negotiation", "Closed Won", "Closed Won", None]


def test_lead_upsert_against_a_sequential_table(spark):
    rng = random.Random(9)
    old = [(f"i{k}", "old", f"m{k}", True, False, False, False, 77, 1) for k in range(8)]
    new = [(f"i{rng.randint(0, 20)}", f"c{s}", f"m{rng.randint(0, 20)}", 1, s) for s in range(1, 200)]
    table = [dict(id=o[0], name=o[1], mail=o[2], score=77) for o in old]
    for i, name, mail, _, _ in new:
        table = [r for r in table if r["id"] != i and r["mail"] != mail]
        table.append(dict(id=i, name=name, mail=mail, score=20))
    o = spark.createDataFrame(old, "id string, company_name string, contact_email string, opened boolean, clicked boolean, replied boolean, bounced boolean, probability_score int, company_id int")
    n = spark.createDataFrame(new, "id string, company_name string, contact_email string, company_id int, seq bigint")
    got = LE.upsert_leads(o, n).collect()
    assert sorted((r.id, r.company_name, r.contact_email, r.probability_score) for r in got) == sorted(
        (r["id"], r["name"], r["mail"], r["score"]) for r in table
    )


def test_client_views(spark):
    c = spark.createDataFrame(
        [(1, 1, "Acme", 90, "Won", "Foods", "Peru", None, None, 'say "hi"', "2024"), (2, 1, "Zed", None, "Cold", None, "Chile", "z@z.com", "1", None, None), (3, 2, "Acre", 60, "Won", "Fast food", None, "", "", "", "x")],
        "id int, company_id int, name string, trust_score int, status string, industry string, country string, email string, phone string, relevance_reason string, created_at string",
    ).withColumn("website", F.lit("w"))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(CL.search_clients(c, q="AC")) == [1, 3] and ids(CL.search_clients(c, q="chile")) == [2]
    assert ids(CL.search_clients(c, industry="food", status="Won", min_score=70)) == [1]
    assert ids(CL.search_clients(c)) == [1, 2, 3]
    assert [r.id for r in CL.scan(c, order="id", company_id=1, status=None).collect()] == [2, 1]
    keys = spark.createDataFrame([(1, 2), (3, 2)], "id int, company_id int")
    assert ids(CL.client_by_id(c, keys)) == [3] and ids(CL.client_by_id(c, keys, allow_cross_tenant=True)) == [1, 3]
    e = CL.export_projection(c).orderBy("Client Name").collect()
    assert e[0]["Email"] == "N/A" and e[0]["Relevance Reason"] == 'say "hi"' and e[2]["Trust Score (%)"] == "" and e[1]["Phone"] == "N/A"
    assert {r.band: r.n for r in CL.band_scores(c).collect()} == {"High Intent": 1, "Low Intent": 1, "Moderate": 1}


def test_overlays(spark):
    cards = spark.createDataFrame([("a.com", "old@a.com", "1", None), ("b.com", "b@b.com", None, "li")], "domain string, email string, phone string, linkedin string")
    fresh = spark.createDataFrame(
        [("a.com", "new@a.com", ["9", "8"], "", "https://a.com/c", "", "ctx")],
        "domain string, primary_email string, phones array<string>, linkedin_company string, contact_page_url string, source_label string, source_context string",
    )
    got = {r.domain: r for r in CL.overlay_enrichment(cards, fresh).collect()}
    assert (got["a.com"].email, got["a.com"].phone, got["a.com"].linkedin, got["a.com"].enriched) == ("new@a.com", "9", None, True)
    assert got["a.com"].contactSource.label == "Contact Page" and got["b.com"].contactSource is None and not got["b.com"].enriched


def test_several_changes_of_one_client_are_one_row(spark):
    clients = spark.createDataFrame([(1, 9, "A", "Pending"), (2, 9, "B", "Pending")], "id long, company_id long, name string, status string")
    changes = spark.createDataFrame(
        [(1, 9, "A1", None, 1), (1, 9, None, "Won", 2), (1, 9, "A2", None, 3), (3, 9, "C", None, 4)],
        "id long, company_id long, name string, status string, seq long",
    )
    got = crm.update_clients(clients, changes, fields=["name", "status"]).collect()
    assert sorted((r.id, r.name, r.status) for r in got) == [(1, "A2", "Won"), (2, "B", "Pending")]
