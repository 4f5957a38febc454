from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadlode.operators import crm
from leadlode.sources.versions import VersionConflict, VersionedTable

ROW = "id bigint, name string"
NOW = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


def rows_of(df):
    return {(r.id, r.name) for r in df.collect()}


@pytest.fixture
def stored(spark, tmp_path):
    rows = spark.range(5000).select("id", F.concat(F.lit("n"), "id").alias("name"))
    return VersionedTable.create(rows, str(tmp_path / "t"), "id", buckets=64)


def test_ten_rows_rewrite_at_most_ten_buckets(spark, stored):
    new = spark.createDataFrame([(i * 37, f"new{i}") for i in range(8)] + [(9001, "a"), (9002, "b")], ROW)
    assert stored.upsert(new) == 2
    assert 1 <= stored.rewritten(2) <= 10 and stored.rewritten(1) == 64
    want = {(i, f"n{i}") for i in range(5000) if i % 37 or i // 37 >= 8} | rows_of(new)
    assert rows_of(stored.read()) == want


def test_old_versions_stay(spark, stored):
    stored.upsert(spark.createDataFrame([(1, "x")], ROW))
    stored.upsert(spark.createDataFrame([(1, "y"), (None, "no id")], ROW))
    stored.upsert(spark.createDataFrame([(None, "none")], ROW))
    assert stored.versions() == [1, 2, 3, 4]
    assert [stored.read(v).where("id = 1").first().name for v in (1, 2, 3)] == ["n1", "x", "y"]
    assert [r.name for r in stored.read().where("id is null").collect()] == ["none"]


def test_a_replayed_batch_changes_nothing(spark, stored):
    one = spark.createDataFrame([(1, "x")], ROW)
    assert stored.upsert(one, batch=0) == 2 and stored.upsert(one, batch=0) == 2 and stored.upsert(one, batch=1) == 3


def test_a_taken_number_is_a_conflict(spark, stored):
    one, other = spark.createDataFrame([(1, "x")], ROW), VersionedTable(spark, stored.root)

    def fold(old, new):
        other.upsert(spark.createDataFrame([(2, "z")], ROW))  # someone else is faster
        return old.where("id <> 1").unionByName(new)

    with pytest.raises(VersionConflict):
        stored.merge(one, fold)
    assert stored.versions() == [1, 2] and stored.read().where("id = 1").first().name == "n1"
    assert stored.upsert(one) == 3 and stored.read().where("id <= 2").count() == 3


def test_empty_tables_and_saves(spark, tmp_path):
    made = VersionedTable.create(spark.createDataFrame([], ROW), str(tmp_path / "e"), "id")
    assert made.read().count() == 0 and made.upsert(made.read()) == 2
    made.upsert(spark.createDataFrame([(1, "a")], ROW))
    assert rows_of(made.read()) == {(1, "a")} and made.rewritten(3) == 1


def test_a_bucket_may_become_empty(spark, stored):
    stored.merge(spark.createDataFrame([(5, "x")], ROW), lambda old, new: old.where("false"))
    assert stored.read().count() < 5000 and len(stored.manifest()["folders"]) == 63


def test_saved_clients_equal_the_rewritten_table(spark, tmp_path):
    client = "id bigint, company_id int, name string, website string, status string, trust_score int, created_at timestamp_ntz"
    old = spark.createDataFrame([(i, i % 3, f"Acme {i}", f"https://a{i}.com", "Pending", i, None) for i in range(300)], client)
    new = spark.createDataFrame(
        [(1, 0, "ACME 3", None, "Won", None), (2, 1, "Other", "https://A4.com", None, 70), (3, 2, "Fresh", "https://f.com", None, 5), (4, 0, "Acme 4", None, "Won", 1)],
        "seq bigint, company_id int, name string, website string, status string, trust_score int",
    )
    stored = VersionedTable.create(old, str(tmp_path / "c"), "id", buckets=32)
    version = crm.save_clients(stored, new, NOW)
    assert stored.rewritten(version) <= 4
    assert sorted(map(tuple, stored.read().collect())) == sorted(map(tuple, crm.upsert_clients(old, new, NOW).collect()))
