from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leadlode.operators import dashboard as DA

AS_OF = "2026-02-01 12:00:00"
NOW = datetime(2026, 2, 1, 12)
CLIENT = "id bigint, company_id int, name string, trust_score int, status string, created_at string"
LOG = "id bigint, client_id bigint, company_id int, email_type string, label string, created_at string"


def test_log_time(evaluate):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    got = evaluate(
        DA.log_time(F.col("x"), as_of),
        ["2026-01-02T03:04:05.123456", "2026-01-02T03:04:05Z", "2026-01-02T03:04:05+05:00", "2026-01-02 03:04:05.99", "2026-01-02", "junk", "Tomorrow", "", None],
    )
    t = datetime(2026, 1, 2, 3, 4, 5)
    assert got == [t.replace(microsecond=123456), t, t, t, NOW, NOW, NOW, None, None]


def test_week_bounds_are_inclusive_below(spark):
    ages = [timedelta(0), timedelta(days=-3), timedelta(days=7), timedelta(days=7, seconds=1), timedelta(days=14), timedelta(days=21), timedelta(days=28), timedelta(days=28, seconds=1)]
    log = spark.createDataFrame([(i, 1, 1, "x", "l", (NOW - a).isoformat()) for i, a in enumerate(ages)] + [(99, 1, 1, "x", "l", "")], LOG)
    c = spark.createDataFrame(
        [(1, 1, "a", 1, "Contacted", NOW.isoformat()), (2, 1, "b", 1, "Won", (NOW - timedelta(days=20)).isoformat()), (3, 2, "c", 1, "Pending", NOW.isoformat())],
        CLIENT,
    )
    got = {(r.company_id, r.week): (r.emails, r.calls, r.meetings) for r in DA.weekly_chart(c, log, AS_OF).collect()}
    assert got == {
        (1, 1): (1, 0, 0), (1, 2): (1, 0, 1), (1, 3): (2, 0, 0), (1, 4): (3, 1, 0),
        (2, 1): (0, 0, 0), (2, 2): (0, 0, 0), (2, 3): (0, 0, 0), (2, 4): (0, 0, 0),
    }


def test_kpis(spark):
    c = spark.createDataFrame(
        [(1, 1, "a", 90, "Pending", None), (2, 1, "b", 45, "Won", None), (3, 1, "c", None, "Cold", None), (4, 3, "d", 0, None, None)], CLIENT
    )
    log = spark.createDataFrame([(1, 1, 1, "x", "l", None), (2, 1, 1, "x", "l", None), (3, 9, 2, "x", "l", None)], LOG)
    got = {r.company_id: tuple(r)[1:] for r in DA.dashboard_kpis(c, log).collect()}
    assert got == {1: (3, 2, 2, 67.5, 2), 2: (0, 1, 1, 0.0, 1), 3: (1, 0, 0, 0.0, 0)}


def test_feed(spark):
    c = spark.createDataFrame([(i, 1, f"n{i}", i, "Won", f"2026-01-0{i}T00:00:00") for i in range(1, 8)] + [(50, 2, "late", 1, "Cold", None)], CLIENT)
    log = spark.createDataFrame(
        [(i, i, 1, t, f"L{i}", f"2026-01-0{i}T00:00:00") for i, t in enumerate(["outreach", "followup", "negotiation", "x", "outreach", "followup"], 1)]
        + [(9, 77, 1, "outreach", "L9", "2026-01-09T00:00:00")],
        LOG,
    )
    rows = DA.activity_feed(c, log, AS_OF).orderBy("company_id", "rnk").collect()
    one = [(r.title, r.subtitle) for r in rows if r.company_id == 1]
    assert one == [
        ("L9 Generated", "Cold Outreach for Prospect"), ("Prospect Saved: n7", "Fit Score: 7% · Status: Won"),
        ("L6 Generated", "Follow-up for n6"), ("Prospect Saved: n6", "Fit Score: 6% · Status: Won"),
        ("L5 Generated", "Cold Outreach for n5"), ("Prospect Saved: n5", "Fit Score: 5% · Status: Won"),
    ]
    assert [r.ts for r in rows if r.company_id == 2] == [AS_OF]
