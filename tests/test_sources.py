from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from leadlode.operators import clients as CL
from leadlode.operators import leads as LE
from leadlode.sources import readers, writers
from leadlode.streaming import candidates as SC


def test_country_file(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps([{"country": "Peru", "code": "PE", "cities": ["Lima", "Cusco"]}, {"country": "Nauru", "code": "NR", "cities": []}], indent=1))
    c = readers.read_countries(spark, str(f))
    assert {(r.country, r.city) for r in readers.country_city_rows(c).collect()} == {("Peru", "Lima"), ("Peru", "Cusco"), ("Nauru", None)}
    wanted = spark.createDataFrame([("PERU",), ("peru",)], "country string")
    assert sorted(r.city for r in CL.country_cities(c, wanted).collect()) == ["Cusco", "Lima"]


def test_progress_file(spark, tmp_path):
    f = tmp_path / "p.json"
    f.write_text(json.dumps({"processed_domains": ["a.com", "b.com", "a.com"], "query_progress": {"x_y": 3}}, indent=1))
    seen, pages = readers.read_progress(spark, str(f))
    assert sorted(r.domain for r in seen.collect()) == ["a.com", "b.com"]
    assert [(r["query"], r.page) for r in pages.collect()] == [("x_y", 3)]


def test_events_round_trip_in_order_and_skip_bad_lines(spark, tmp_path):
    rows = [("complete", None, None, None, 2), ("company", 1, 1, "b.com", None), ("progress", 1, None, None, None), ("company", 2, 0, "c.com", None), ("start", None, None, None, None), ("company", 1, 0, "a.com", None), ("progress", 2, None, None, None)]
    e = spark.createDataFrame(rows, "type string, page int, pos int, domain string, totalQualified int")
    out = str(tmp_path / "e")
    writers.write_events(e, out)
    got = [json.loads(r.value) for r in writers.event_lines(e).collect()]
    assert [(g["type"], g.get("domain")) for g in got] == [
        ("start", None), ("company", "a.com"), ("company", "b.com"), ("progress", None), ("company", "c.com"), ("progress", None), ("complete", None),
    ]
    (tmp_path / "e" / "extra.txt").write_text('not json\n{"no": "type"}\n{"type": "company", "domain": "z.com", "leadType": "NEEDS_SERVICE", "trustScore": 70}\n\n')
    back = readers.read_events(spark, out)
    assert sorted(r.domain for r in back.where("type = 'company'").collect()) == ["a.com", "b.com", "c.com", "z.com"]
    kept = SC.company_events(back, min_trust=60).collect()
    assert [(r.domain, r.leadType) for r in kept] == [("z.com", "needs_service")]

    stream = SC.company_events(readers.stream_events(spark, out), min_trust=60).select("domain")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "s")).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.domain for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["z.com"]


def test_events_of_a_run(spark):
    cards = spark.createDataFrame([(1, 0, "a.com", "A"), (2, 3, "b.com", "B")], "page int, pos int, domain string, name string")
    totals = spark.createDataFrame([(1, 1, 5), (2, 2, 9)], "page int, qualified_total bigint, processed_total bigint")
    lines = [json.loads(r.value) for r in writers.event_lines(writers.discovery_events(cards, totals, "jam", 10, "Us")).collect()]
    assert [x["type"] for x in lines] == ["start", "company", "progress", "company", "progress", "complete"]
    assert lines[2] == {"type": "progress", "page": 1, "qualified": 1, "target": 10, "processed": 5}
    assert lines[0] == {"type": "start", "query": "jam", "target": 10} and lines[5]["totalQualified"] == 2
    assert lines[5]["summary"] == "Discovery finished. Found 2 qualified prospects for Us."


def test_csv_bytes(spark, tmp_path):
    c = spark.createDataFrame([('A "x", y', "w", None, "P", 5, "Won", None, "1", "r", "t")], "name string, website string, industry string, country string, trust_score int, status string, email string, phone string, relevance_reason string, created_at string")
    writers.write_csv(c.coalesce(1), str(tmp_path / "o"))
    data = next((tmp_path / "o").glob("part-*.csv")).read_bytes().decode()
    assert data == (
        "﻿Client Name,Website,Industry,Country,Trust Score (%),Status,Email,Phone,Relevance Reason,Created At\n"
        '"A ""x"", y","w","","P","5","Won","N/A","1","r","t"\n'
    )


def test_card_export_has_thirteen_columns(spark):
    cards = spark.createDataFrame([("A", "w", "d", "i", "c", 70, "Verified", None, None, None, (None, "Contact Page", None, "ctx"), "s")], "name string, website string, domain string, industry string, country string, trustScore int, trustStatus string, email string, phone string, linkedin string, contactSource struct<url: string, page: string, label: string, context: string>, snippet string")
    r = CL.export_projection(cards, CL.CARD_EXPORT).first()
    assert len(r) == 13 and r["Contact Source Page"] == "Contact Page" and r["Source Context"] == "ctx" and r["Email"] == "N/A"


def test_contacts_append_and_versions(spark, tmp_path):
    found = spark.createDataFrame([("A", [("e@a.com",)]), ("B", None)], "company_name string, all_contacts array<struct<email: string>>")
    rows = writers.contact_rows(found, F.lit("2026-01-01").cast("timestamp"))
    writers.append(rows, str(tmp_path / "t"))
    writers.append(rows, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 4 and {r.all_contacts_json for r in back.collect()} == {'[{"email":"e@a.com"}]', "[]"}
    merged = readers.merge_versions(back.select("company_name"), back)
    assert merged.where("all_contacts_json is null").count() == 4
    path = writers.write_version(back, str(tmp_path / "v"), 3)
    assert spark.read.parquet(path).count() == 4


def test_new_leads(spark):
    cards = spark.createDataFrame([("A", "a.com", "snip", "why"), ("", "b.com", "", "")], "name string, domain string, snippet string, matchReason string")
    got = {r.contact_email: r for r in LE.leads_from_companies(cards).collect()}
    assert got["contact@a.com"].subject == "Outreach opportunity for A" and got["contact@a.com"].is_guessed
    assert got["contact@b.com"].company_name == "Unknown Company" and got["contact@b.com"].suggested_action == "AI Qualified Prospect"


def test_stream_candidates_keep_each_domain_once(spark, tmp_path):
    hot = [(i, f"https://hot.com/p{i}", "t") for i in range(300)]
    rest = [(1000 + i, f"https://d{i % 20}.com/", "t") for i in range(60)] + [(5000, "https://x.gov/", "t"), (5001, "https://best.com/", "Top 10 companies")]
    schema = "page int, url string, title string"
    for part in (hot, rest, hot[:50]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (
        SC.first_domains(SC.clean_stream(stream)).writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = [r.domain for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted({"hot.com", *(f"d{i}.com" for i in range(20))})


def test_stream_candidates_with_a_watermark(spark, tmp_path):
    schema = "ts timestamp, url string, domain string"
    for day in (1, 2):
        rows = [(datetime(2024, 1, day), f"https://d{i}.com/{k}", f"d{i}.com") for i in range(5) for k in range(8)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (
        SC.first_domains(stream, ts="ts", keep="10 days").writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert sorted(r.domain for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"d{i}.com" for i in range(5)]


def test_stream_counters(spark, tmp_path):
    spark.createDataFrame([(1, None), (1, "x"), (2, None)], "page int, reject_reason string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("page int, reject_reason string").parquet(str(tmp_path / "in"))
    seen = []
    q = SC.page_counters(stream).writeStream.outputMode("update").foreachBatch(lambda d, i: seen.extend(d.collect())).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.page, r.processed, r.qualified) for r in seen} == {(1, 2, 1), (2, 1, 1)}
