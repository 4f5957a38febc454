"""op1: the language of every document, learned from two thirds of the labelled ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlode.llm import langid
from leadlode.llm.common import documents


def op1_language(spark, folder):
    docs = documents(spark, folder)
    model = langid.train(docs.where(~langid.held_out()))
    return docs.select("doc_id", langid.held_out().alias("held_out"), langid.language(model, F.col("text")).alias("found")).select(
        "doc_id", "held_out", "found.*"
    )


QUERIES = {"op1_language": op1_language}
SQL = {}
