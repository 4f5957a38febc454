"""Every registered query against its SQL, and what its plan must not hold."""

from __future__ import annotations

import contextlib
import io
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check_oracle  # noqa: E402
import __spark_entry__ as entry  # noqa: E402
from leadlode import plans  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.all_queries()))
def test_query_equals_sql(spark, con, name):
    status, _, _, note = check_oracle.compare(spark, con, name, FOLDER)
    assert status in ("OK", "ROWS"), note


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


STREAMED = {"stream_scores", "stream_candidates", "stream_page_counters"}


@pytest.mark.parametrize("name", sorted(set(plans.all_queries()) - STREAMED - {"upsert_clients"}))
def test_plan_has_no_cross_or_nested_loop_join(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "BatchEvalPython" not in plan
    assert "SinglePartition" not in plan or name in SMALL_RESULT, plan


# One-row reports: only partial counts reach the single task.
SMALL_RESULT = {"junk_metrics", "relevance_vs_label", "extraction_yield"}


@pytest.mark.parametrize(
    "name", ["candidate_first_per_domain", "top_leads", "activity_feed", "evidence", "upsert_leads"]
)
def test_ranks_are_limited_before_the_shuffle(spark, name):
    assert "row_number(), " in plan_of(entry.queries()[name](spark, FOLDER)) and "Partial" in plan_of(
        entry.queries()[name](spark, FOLDER)
    )


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(plans.all_queries()) <= set(entry.queries())
    assert set(plans.all_queries()) == set(plans.all_sql())
