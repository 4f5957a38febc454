"""Accuracy reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classification_metrics(predicted: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Confusion counts and the usual ratios of ``predicted`` against ``actual``."""
    p, a = F.col("predicted"), F.col("actual")
    counts = (
        predicted.select(key, "predicted")
        .join(truth.select(key, "actual"), key)
        .agg(
            F.count_if(p & a).alias("tp"),
            F.count_if(p & ~a).alias("fp"),
            F.count_if(~p & a).alias("fn"),
            F.count_if(~p & ~a).alias("tn"),
        )
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn",
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def extraction_yield(bundles: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per field: sites, sites with a value, valid values, yield and precision.

    ``fields`` maps a name to its (found, valid) conditions.  One pass over the
    table; the field rows are made from the single row of counts.
    """
    counts = bundles.agg(
        F.count("*").alias("n"),
        *[F.count_if(found).alias(f"{name}_found") for name, (found, _) in fields.items()],
        *[F.count_if(found & valid).alias(f"{name}_valid") for name, (found, valid) in fields.items()],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.col("n").alias("n"),
                F.col(f"{name}_found").alias("found"),
                F.col(f"{name}_valid").alias("valid"),
            )
            for name in fields
        ]
    )
    return counts.select(F.inline(rows)).select(
        "field", "n", "found", "valid",
        F.try_divide(F.col("found"), F.col("n")).alias("rate"),
        F.try_divide(F.col("valid"), F.col("found")).alias("precision"),
    )


def score_agreement(scores: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Pearson correlation and mean absolute error of ``score`` against ``rating``."""
    return (
        scores.select(key, "score")
        .join(truth.select(key, "rating"), key)
        .agg(
            F.count("*").alias("n"),
            F.corr("score", "rating").alias("r"),
            F.avg(F.abs(F.col("score") - F.col("rating"))).alias("mae"),
        )
    )
