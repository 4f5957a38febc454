from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from leadlode.session import build_session  # noqa: E402

# Made here, since the test modules build column expressions when imported.
SESSION = build_session(
    "tests",
    "local[4]",
    spark__sql__shuffle__partitions="4",
    spark__ui__enabled="false",
    spark__ui__showConsoleProgress="false",
    spark__driver__memory="4g",
    spark__checkpoint__dir=tempfile.mkdtemp(prefix="leadlode-test-"),
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a column expression for each of some inputs."""

    def run(expression, values, schema="x string"):
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i int, " + schema)
        return [r[0] for r in df.orderBy("i").select(expression.alias("out")).collect()]

    return run
