"""op4: all documents scored against a model of the good, clean ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlode.llm import lm_scoring
from leadlode.llm.common import documents


def op4_lm_score(spark, folder):
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0))
    return lm_scoring.score_pairs(docs, good, lm_scoring.train(docs, good)).select("row.*", "n_tokens", "target_loss", "background_loss", "score")


QUERIES = {"op4_lm_score": op4_lm_score}
SQL = {}
