"""op6: SimHash groups of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlode.llm.common import documents
from leadlode.llm.simhash import groups


def op6_simhash(spark, folder):
    found = groups(documents(spark, folder))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
SQL = {}
