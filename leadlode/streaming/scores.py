"""Lead scores over an event stream.

Each micro-batch is reduced to one summary row per lead with the same balanced
batch job as the table form, and the summaries are appended under the batch
number.  The score of a lead is the fold of its few summaries.  A batch that is
replayed after a failure overwrites its own folder, so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlode.operators import leads as L
from leadlode.session import shared_files

SUMMARY = "lead bigint, bounced boolean, gain bigint, opened boolean, clicked boolean, n_events bigint"


def _split(events: DataFrame, root: str, batch: int) -> DataFrame:
    """Set unusable messages aside and return the rest."""
    if "status" not in events.columns:
        return events
    (
        events.where(F.col("status") != "ok")
        .write.mode("overwrite").parquet(f"{root}/rejected/batch={batch}")
    )
    return events.where(F.col("status") == "ok")


def start_scores(
    events: DataFrame, root: str, lead: str = "lead", unit: str = "hour", **trigger
):
    """Start the query that appends score summaries under ``root``.

    ``events`` is a stream with ``lead, ts, event_id, type``.
    """

    def step(batch_df: DataFrame, batch: int) -> None:
        batch_df.persist()  # it is written twice: what is set aside, and the summary
        try:
            good = _split(batch_df, root, batch)
            summary = L.combine_summaries(L.chunk_summaries(good, lead, unit=unit), lead)
            summary.write.mode("overwrite").parquet(f"{root}/summaries/batch={batch}")
        finally:
            batch_df.unpersist()

    return (
        events.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the batches of a stream have written so far, ``batch`` numbered; no rows if none has yet."""
    schema += ", batch int"
    files, where = shared_files(spark, path)
    if not files.exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def read_summaries(spark: SparkSession, root: str) -> DataFrame:
    """All summaries so far; none if no batch has been written yet."""
    return read_batches(spark, f"{root}/summaries", SUMMARY)


def current_scores(summaries: DataFrame, leads: DataFrame, lead: str = "lead") -> DataFrame:
    """Score and flags per lead from the summaries so far; flags that a lead already has stay set."""
    folded = L.combine_summaries(summaries, lead, order="batch")
    flags = ("opened", "clicked", "bounced")
    old = leads.select(
        lead, F.col("probability_score").alias("start"), *[F.col(c).alias(f"was_{c}") for c in flags if c in leads.columns]
    )
    return folded.join(old, lead).select(
        lead,
        L.final_score(F.col("start"), F.col("bounced"), F.col("gain")).alias("score"),
        *[(F.col(c) | F.coalesce(F.col(f"was_{c}"), F.lit(False))).alias(c) if c in leads.columns else F.col(c) for c in flags],
        "n_events",
    )


def compact(summaries: DataFrame, lead: str = "lead") -> DataFrame:
    """Many batches' summaries as one, numbered after the last of them."""
    last = summaries.agg(F.max("batch")).scalar()
    return L.combine_summaries(summaries, lead, order="batch").withColumn("batch", last)
