"""op10: all documents without the 20-word windows that start earlier elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlode.llm.common import documents
from leadlode.llm.substring import remove_repeats


def op10_substring(spark, folder):
    done = remove_repeats(documents(spark, folder))
    return done.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op10_substring": op10_substring}
SQL = {}
