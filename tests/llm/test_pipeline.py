"""The pipeline's stages, and the registered queries against their SQL."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_oracle  # noqa: E402
import corpus_pipeline  # noqa: E402
from leadlode.llm import plans  # noqa: E402
from tests.llm.helpers import no_docs, odd_docs  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def stages(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.shared_table(stage(spark, out[-1], FOLDER)))
    return out


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
def test_each_stage_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    start, identified, lines, single, mixed, packed = stages(spark, docs)
    assert all(x.columns == docs.columns for x in (identified, lines, single, mixed))
    assert identified.count() >= 0.99 * docs.count() and lines.count() == identified.count()
    assert 0.8 * lines.count() < single.count() < lines.count()
    ids = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert max(ids.values()) <= 3 and set(ids) <= {r["doc_id"] for r in single.select("doc_id").collect()}
    pieces = Counter(r["doc_id"] for r in packed.where("piece = 0").select("doc_id").collect())
    assert pieces == ids
    again = corpus_pipeline.run(spark, FOLDER)
    assert again.count() == packed.count()


def test_odd_rows_pass_every_stage(spark):
    _, identified, lines, single, mixed, packed = stages(spark, odd_docs(spark))
    assert {r["doc_id"] for r in single.collect()} <= {None, 4, 6, 7, 8, 10, 11, 5}
    assert packed.count() > 0 and mixed.columns == identified.columns
    assert stages(spark, no_docs(spark))[-1].count() == 0


def test_queries_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in plans.all_queries()}
    assert set(plans.all_queries()) | {"pipeline"} <= set(entry.queries())
    assert [n for n in corpus_pipeline.STAGES if not callable(n[1])] == []


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(plans.all_sql()))
def test_query_equals_sql(spark, name):
    status, _, _, note = check_oracle.compare(spark, check_oracle.connect(FOLDER), name, FOLDER)
    assert status == "OK", note
