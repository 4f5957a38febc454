"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every source has a weight.  Shares of the whole size are dealt by weight; a source that
would be repeated more than ``max_epochs`` times is clamped there and what it cannot take is
dealt to the others by weight, until no source is above its clamp.  The level at which that
settles is found in one pass over the sources, ordered by clamp over weight.

A source taken 2.4 times gives two whole copies of every document and one more copy of
documents that hold 0.4 of its words.  Those are chosen by a seeded hash: documents of more
than a hundredth of their source (fewer than a hundred to a source) are rounded one after
another from the largest down, each against the error so far, and of the others those below
a cut in hash order are taken, so that the source ends near its target.  The cut is found in
the sums of 1024 hash ranges and then inside one range; no source is ever sorted whole.

Defined results: null and blank texts have size 0 and take 0 words; a null source is a source
of its own, last in order; equal rows (same id, same text) are taken or left together; an empty
table gives an empty mix.  Whatever other columns the table has stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlode.llm.common import shared_table, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-7"
#: A document of more than 1 / LARGE of its source is rounded by itself.
LARGE = 100
#: Keys have 60 bits; the upper ten name the range.
RANGE_BITS = 50


def _key(seed: str) -> Column:
    told = F.concat(
        F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))
    )
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source)."""
    everything = Window.partitionBy()
    named = sizes.withColumn(
        "_w",
        F.element_at(
            F.array(*[F.lit(w) for w in weights]),
            (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1,
        ).cast("long"),
    ).withColumn("_cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        named.withColumn("_rank", F.row_number().over(by_ratio))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_ws", F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_all", F.sum("_w").over(everything))
        .withColumn("_level", (F.col("_total") - F.col("_caps")) / (F.col("_all") - F.col("_ws")))
        .withColumn("_open", F.col("_cap") > F.col("_level") * F.col("_w"))
        .withColumn("_first", F.min(F.when(F.col("_open"), F.struct("_rank", "_level"))).over(everything))
    )
    open_ = F.col("_first").isNotNull() & (F.col("_rank") >= F.col("_first._rank"))
    target = F.when(open_, F.col("_first._level") * F.col("_w")).otherwise(F.col("_cap").cast("double"))
    return levels.select("source", "source_size", target.alias("target"))


def _units(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(seed).alias("key"))


def _rules(units: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """One row per source: target, whole copies, and which keys get one copy more."""
    per = source_targets(units.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    some = F.col("source_size") > 0
    per = shared_table(
        per.withColumn("whole", F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("share", F.when(some, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0)))
    )
    known = per.withColumnRenamed("source", "_source")
    sized = units.join(known, units["source"].eqNullSafe(known["_source"])).drop("_source")
    is_large = F.col("size") * LARGE > F.col("source_size")

    # Large documents, from the largest down: take one where that leaves the smaller error.
    large = (
        sized.where(is_large)
        .groupBy("source", "share", "key")
        .agg(F.sum("size").alias("size"))
        .groupBy("source", "share")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), "key"))).alias("docs"))
    )
    zero = F.struct(F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("seen"), F.array().cast("array<long>").alias("keys"))

    def step(share):
        def one(acc, d):
            size = -d["s"]
            take = (F.lit(2.0) * (acc["taken"] - share * acc["seen"]) + size * (F.lit(1.0) - F.lit(2.0) * share)) < 0
            return F.struct(
                (acc["taken"] + F.when(take, size).otherwise(F.lit(0).cast("long"))).alias("taken"),
                (acc["seen"] + size).alias("seen"),
                F.when(take, F.concat(acc["keys"], F.array(d["key"]))).otherwise(acc["keys"]).alias("keys"),
            )

        return one

    folded = large.withColumn("f", F.aggregate("docs", zero, step(F.col("share")))).select(
        F.col("source").alias("_source"), F.col("f.taken").alias("large_taken"), F.col("f.keys").alias("large_keys")
    )
    per = shared_table(
        per.join(folded, per["source"].eqNullSafe(folded["_source"]), "left")
        .drop("_source")
        .withColumn("want", F.col("rest") - F.coalesce("large_taken", F.lit(0)))
        .withColumn("large_keys", F.coalesce("large_keys", F.array().cast("array<long>")))
    )

    # The others: the hash range in which the sum reaches what is wanted, then the key inside it.
    ranges = (
        sized.where(~is_large)
        .groupBy("source", F.shiftright("key", RANGE_BITS).alias("range"))
        .agg(F.sum("size").alias("size"))
    )
    in_order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    wanted = per.select(F.col("source").alias("_source"), "want")
    found = (
        ranges.withColumn("below", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
        .join(wanted, F.col("source").eqNullSafe(F.col("_source")))
        .where((F.col("below") < F.col("want")) & (F.col("below") + F.col("size") >= F.col("want")))
        .select("_source", "range", "below", "want")
    )
    found = shared_table(found)
    inside = (
        sized.where(~is_large)
        .join(
            found,
            F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("key", RANGE_BITS) == F.col("range")),
        )
        .groupBy("_source", "range", "below", "want", "key")
        .agg(F.sum("size").alias("size"))
    )
    in_range = Window.partitionBy("_source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("below") + F.coalesce(F.sum("size").over(in_range), F.lit(0)) + F.col("size") / F.lit(2.0)
    cuts = (
        inside.withColumn("upto", upto)
        .groupBy("_source")
        .agg(
            F.coalesce(
                F.max(F.when(F.col("upto") <= F.col("want"), F.col("key"))),
                F.first(F.shiftleft("range", RANGE_BITS) - 1),
            ).alias("cut")
        )
    )
    none_or_all = F.when(F.col("want") <= 0, F.lit(-1)).otherwise(F.lit(1 << 60)).cast("long")
    return shared_table(
        per.join(cuts, per["source"].eqNullSafe(cuts["_source"]), "left")
        .select("source", "source_size", "target", "whole", "large_keys", F.coalesce("cut", none_or_all).alias("cut"))
    )


def _dealt(rows: DataFrame, rules: DataFrame, size: Column, key: Column) -> DataFrame:
    named = rules.select(F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in rules.columns if c != "source"])
    large = size * LARGE > F.col("_source_size")
    more = F.when(large, F.array_contains("_large_keys", key)).otherwise(key <= F.col("_cut"))
    return rows.join(named, rows["source"].eqNullSafe(named["_source"])).withColumn("_copies", F.col("_whole") + more.cast("long"))


def mix_sizes(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every document.

    Runs jobs when called: sizes and the table of sources are written to the shared folder.
    """
    units = shared_table(_units(docs, seed))
    dealt = _dealt(units, _rules(units, weights, max_epochs), F.col("size"), F.col("key"))
    return dealt.select(
        "doc_id",
        "source",
        "size",
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents themselves, each repeated as often as the mix takes it, columns unchanged."""
    rules = _rules(shared_table(_units(docs, seed)), weights, max_epochs)
    ready = docs.select(
        F.struct("*").alias("row"), "source", word_count(F.col("text")).alias("size"), _key(seed).alias("key")
    )
    dealt = _dealt(ready, rules, F.col("size"), F.col("key")).where(F.col("_copies") > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return dealt.select("row", copies.alias("copy")).select("row.*")
