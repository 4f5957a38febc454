from __future__ import annotations

import itertools
import json
import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadlode.operators import leads as LE
from leadlode.plans import scores as plans
from leadlode.streaming import scores as SS

T0 = datetime(2026, 1, 1)
EVENT = "lead bigint, ts timestamp_ntz, event_id bigint, type string"
LEAD = "lead bigint, probability_score int, opened boolean, clicked boolean, bounced boolean"
KINDS = ("email.opened", "email.clicked", "email.bounced", "email.delivered")


def fold(start, kinds):
    score, opened, clicked, bounced, steps = start, False, False, False, []
    for k in kinds:
        if k == "email.opened":
            score, opened = score + 20, True
        elif k == "email.clicked":
            score, clicked = score + 25, True
        elif k == "email.bounced":
            score, bounced = 0, True
        score = max(0, min(100, score))
        steps.append(score)
    return score, opened, clicked, bounced, steps


@pytest.fixture(scope="module")
def sequences():
    """Every sequence of one to five events, one lead each."""
    return [s for n in range(1, 6) for s in itertools.product(KINDS, repeat=n)]


def test_every_short_sequence(spark, sequences):
    rng = random.Random(2)
    rows = []
    for lead, s in enumerate(sequences):
        t = T0
        for i, k in enumerate(s):
            t += timedelta(minutes=rng.choice([0, 5, 50, 300]))
            rows.append((lead, t, lead * 10 + i, k))
    rng.shuffle(rows)
    e = spark.createDataFrame(rows, EVENT)
    leads = spark.createDataFrame([(i, 20 + i % 50, False, False, False) for i in range(len(sequences))], LEAD)
    got = {r.lead: r for r in LE.score_leads(e, leads).collect()}
    history = {}
    for r in LE.score_history(e, leads).collect():
        history.setdefault(r.lead, []).append((r.event_id, r.score))
    for lead, s in enumerate(sequences):
        score, o, c, b, steps = fold(20 + lead % 50, s)
        assert (got[lead].score, got[lead].opened, got[lead].clicked, got[lead].bounced) == (score, o, c, b), s
        assert [x for _, x in sorted(history[lead])] == steps, s


def test_a_lead_with_most_events_is_spread_by_time(spark):
    rng = random.Random(8)
    kinds = [rng.choices(KINDS, (3, 3, 1, 3))[0] for _ in range(3000)]
    rows = [(1, T0 + timedelta(minutes=i), i, k) for i, k in enumerate(kinds)] + [(2, T0, 9000, "email.opened")]
    e = spark.createDataFrame(rows, EVENT)
    leads = spark.createDataFrame([(1, 20, False, False, False), (2, 20, True, False, True)], LEAD)
    got = {r.lead: r for r in LE.score_leads(e, leads).collect()}
    assert got[1].score == fold(20, kinds)[0] and got[1].n_events == 3000
    assert got[2].score == 40 and got[2].bounced  # flags stay set
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny data is merged again
    try:
        parts = LE.in_chunks(e).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in parts) < 0.6 * len(rows)


def test_webhook_messages(spark):
    good = json.dumps({"type": "email.opened", "data": {"to": ["a@b.c", "x@y.z"], "extra": 1}})
    raw = spark.createDataFrame(
        [(1, good), (2, "{broken"), (3, '{"type": "t", "data": {"to": []}}'), (4, '{"type": "t"}'), (5, None)],
        "event_id int, payload string",
    )
    got = {r.event_id: (r.status, r.recipient, r.type) for r in LE.parse_webhooks(raw).collect()}
    assert got == {
        1: ("ok", "a@b.c", "email.opened"), 2: ("bad_json", None, None), 3: ("skipped", None, "t"),
        4: ("skipped", None, "t"), 5: ("bad_json", None, None),
    }


def test_unknown_recipients(spark):
    e = spark.createDataFrame([(1, T0, 1, "x"), (5, T0, 2, "x"), (5, T0, 3, "x")], EVENT)
    leads = spark.createDataFrame([(1, 20, False, False, False)], LEAD)
    assert [(r.lead, r.n_events) for r in LE.unknown_recipients(e, leads).collect()] == [(5, 2)]


def test_stream_equals_batch_over_several_micro_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randint(1, 12), T0 + timedelta(minutes=7 * i), i, rng.choice(KINDS)) for i in range(400)]
    source = tmp_path / "in"
    for part in range(4):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], EVENT).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(source))
    root = str(tmp_path / "out")
    SS.start_scores(stream, root).awaitTermination()
    leads = spark.createDataFrame([(i, 20, False, False, False) for i in range(1, 13)], LEAD)
    summaries = SS.read_summaries(spark, root)
    assert summaries.select("batch").distinct().count() == 4
    want = {r.lead: (r.score, r.opened, r.clicked, r.bounced, r.n_events) for r in LE.score_leads(spark.createDataFrame(rows, EVENT), leads).collect()}

    def scores(s):
        return {r.lead: (r.score, r.opened, r.clicked, r.bounced, r.n_events) for r in SS.current_scores(s, leads).collect()}

    assert scores(summaries) == want
    assert scores(SS.compact(summaries)) == want

    # More events later go on from where the stream stopped.
    more = [(1, T0 + timedelta(days=9), 1000, "email.bounced"), (1, T0 + timedelta(days=9), 1001, "email.opened")]
    spark.createDataFrame(more, EVENT).coalesce(1).write.mode("append").parquet(str(source))
    SS.start_scores(spark.readStream.schema(EVENT).parquet(str(source)), root).awaitTermination()
    assert scores(SS.read_summaries(spark, root))[1][0] == 20


def test_rejected_messages_are_set_aside(spark, tmp_path):
    rows = [(1, T0, 1, "email.opened", "ok"), (None, T0, 2, None, "bad_json"), (None, T0, 3, "t", "skipped")]
    schema = EVENT + ", status string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    SS.start_scores(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "rejected")).count() == 2
    assert SS.read_summaries(spark, str(tmp_path / "out")).count() == 1


def test_no_summaries_yet(spark, tmp_path):
    leads = spark.createDataFrame([(1, 20, True, False, False)], "lead long, probability_score int, opened boolean, clicked boolean, bounced boolean")
    assert SS.current_scores(SS.read_summaries(spark, str(tmp_path)), leads).count() == 0


def test_flags_set_earlier_stay(spark):
    leads = spark.createDataFrame([(1, 20, True, False, True)], "lead long, probability_score int, opened boolean, clicked boolean, bounced boolean")
    one = spark.createDataFrame([(1, False, 20, False, True, 1, 0)], SS.SUMMARY + ", batch int")
    row = SS.current_scores(one, leads).first()
    assert (row.opened, row.clicked, row.bounced) == (True, True, True)


@pytest.mark.parametrize("folders", [False, True])
def test_streams_read_tables_that_are_folders(spark, tmp_path, folders):
    pages = [(k, f"https://www.d{k % 7}.de/" + ("blog/x" if k % 5 == 0 else ""), f"<title>t{k}</title>") for k in range(40)]
    events = [(k, T0 + timedelta(hours=k), k % 3, ("view", "click")[k % 2], 1.0) for k in range(30)]
    tables = {
        "pages": spark.createDataFrame(pages, "page_id long, url string, html string"),
        "events": spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double"),
        "other": spark.range(9),
    }
    for name, rows in tables.items():
        if folders:
            rows.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
        else:
            rows.coalesce(1).write.parquet(str(tmp_path / "written" / name))
            shutil.copy(next((tmp_path / "written" / name).glob("part-*.parquet")), tmp_path / f"{name}.parquet")
    got = {r.page: (r.processed, r.qualified) for r in plans.stream_page_counters(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in got.items()} == dict.fromkeys(range(10), 4) and sum(v[1] for v in got.values()) > 0
    assert 0 < plans.stream_candidates(spark, str(tmp_path)).count() <= 7
    read = plans._stream(spark, str(tmp_path), "events")
    read.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "k")).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_counters_of_a_stream_without_batches(spark, tmp_path):
    got = SS.read_batches(spark, str(tmp_path / "none"), "page bigint, processed bigint")
    assert got.columns == ["page", "processed", "batch"] and got.count() == 0
