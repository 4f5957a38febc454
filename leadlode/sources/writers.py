"""Sinks: NDJSON events, CSV exports, appended contacts, table versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlode.operators.clients import CLIENT_EXPORT, export_projection

EVENT_ORDER = ("start", "company", "progress", "complete")


def discovery_events(cards: DataFrame, totals: DataFrame, query: str, target: int, company: str) -> DataFrame:
    """Events of one run: a start, its company cards, progress per page, and a close.

    ``cards`` are the accepted companies (``page, pos`` and card columns);
    ``totals`` has ``page, qualified_total, processed_total`` of every page.
    """
    spark = cards.sparkSession
    edge = spark.range(1)
    found = cards.agg(F.count("*")).scalar()
    start = edge.select(
        F.lit("start").alias("type"), F.lit(query).alias("query"), F.lit(target).alias("target")
    )
    progress = totals.select(
        F.lit("progress").alias("type"),
        "page",
        F.col("qualified_total").alias("qualified"),
        F.lit(target).alias("target"),
        F.col("processed_total").alias("processed"),
    )
    complete = edge.select(
        F.lit("complete").alias("type"),
        found.alias("totalQualified"),
        F.concat(
            F.lit("Discovery finished. Found "), found.cast("string"),
            F.lit(f" qualified prospects for {company}."),
        ).alias("summary"),
    )
    companies = cards.withColumn("type", F.lit("company"))
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), (start, companies, progress, complete)
    )


def event_lines(events: DataFrame, order=("page", "pos")) -> DataFrame:
    """Events as JSON lines: start, then per page companies and progress, then complete."""
    rank = F.array_position(F.array(*[F.lit(t) for t in EVENT_ORDER]), F.col("type"))
    edge = F.when(rank == 1, 0).when(rank == 4, 2).otherwise(1)
    by = [c for c in order if c in events.columns]
    fields = [F.col(c) for c in events.columns if c not in ("pos",)]
    return events.orderBy(
        edge, *[F.col(c).asc_nulls_last() for c in by[:1]], rank, *[F.col(c) for c in by[1:]]
    ).select(F.to_json(F.struct(*fields)).alias("value"))


def write_events(events: DataFrame, path: str) -> None:
    event_lines(events).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, layout=CLIENT_EXPORT, bom: bool = True) -> None:
    """Every value quoted, quotes doubled, a plain header line, UTF-8 with BOM."""
    out = export_projection(df, layout)
    if bom and out.columns:
        out = out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0])
    quoted = F.concat_ws(
        ",",
        *[
            F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"'))
            for c in out.columns
        ],
    )
    # The header is a bare line, so rows are quoted here and written unquoted.
    # Header names hold no comma, so the joined names are one column name.
    (
        out.select(quoted.alias(",".join(out.columns)))
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", "")
        .option("sep", "\x01")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def contact_rows(found: DataFrame, as_of: Column) -> DataFrame:
    """Enriched contacts ready to append: the bundle as JSON text, and a time."""
    bundle = F.coalesce(F.to_json("all_contacts"), F.lit("[]"))
    return found.withColumn("all_contacts_json", bundle).drop("all_contacts").withColumn("enriched_at", as_of)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a rewritten table as a new version folder and return its path."""
    path = f"{root}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path
