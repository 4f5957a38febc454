"""Candidate cleaning, counters and the event reader over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlode.operators import candidates as CA
from leadlode.operators.qualify import passes_reader_gate


def clean_stream(hits: DataFrame, **rule_options) -> DataFrame:
    """Hits of a stream that pass every rule, with their domain.  Keeps no state."""
    return CA.passed(CA.filter_candidates(hits, **rule_options)).drop("reject_reason")


def first_domains(hits: DataFrame, salts: int = 32, ts: str | None = None, keep: str = "30 days") -> DataFrame:
    """Each domain once, for good, or with a time column once in ``keep``.

    Two steps keep a hot domain from flooding one state partition: repeats are
    dropped per (domain, salt) first, and at most ``salts`` rows of a domain reach
    the second step.  The salt follows the URL, so replays land alike.  With ``ts``
    a watermark drops the state of domains not met for ``keep``.
    """
    salt = F.pmod(F.xxhash64("url"), F.lit(salts)).alias("salt")
    if ts is None:
        rows = hits.select("domain", salt)
        return rows.dropDuplicates(["domain", "salt"]).select("domain").dropDuplicates(["domain"])
    rows = hits.withWatermark(ts, keep).select("domain", salt, ts)
    once = rows.dropDuplicatesWithinWatermark(["domain", "salt"]).select("domain", ts)
    return once.dropDuplicatesWithinWatermark(["domain"])


def page_counters(hits: DataFrame) -> DataFrame:
    """Processed and passed hits per page (update mode)."""
    return hits.groupBy("page").agg(
        F.count("*").alias("processed"), F.count_if(F.col("reject_reason").isNull()).alias("qualified")
    )


def company_events(events: DataFrame, min_trust: float = 0.0) -> DataFrame:
    """What the reader of an event stream keeps: gated company rows."""
    return (
        events.where(F.col("type") == "company")
        .withColumn("leadType", F.lower("leadType"))
        .where(passes_reader_gate(min_trust))
    )
