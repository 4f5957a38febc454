"""Running values per key that stay balanced when one key owns a third of the rows.

A plain running window sends a whole key to one task.  Here the rows are cut into ranges of the order column that
hold about the same number of rows, however its values lie: the cuts are quantiles of the data.  A key's rows are
ordered inside a range only, and the small table of totals per key and range carries the state from range to range.

Key and chunk travel as structs, which compare equal on NULL members too, so rows with a NULL key are numbered
like any others, and rows with a NULL order come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY, CHUNK = "_key", "_chunk"

#: Rows of a range, about, and the most ranges a table is cut into.
RANGE_ROWS = 1 << 20
MOST_RANGES = 1 << 12
#: Rows the cuts are taken from, about.  They only balance the work; no result depends on them.
SAMPLE_ROWS = 1 << 20


def range_cuts(df: DataFrame, order: str, rows: int = RANGE_ROWS) -> list:
    """Cuts of a number, date or time column between ranges of about ``rows`` rows.  Runs jobs at once.

    The driver sees the cuts, fewer than ``MOST_RANGES``; a table of up to ``rows`` rows has none.
    """
    total = df.select(order).count()
    parts = min(MOST_RANGES, -(-total // rows))
    if parts < 2:
        return []
    some = df.select(order) if total <= SAMPLE_ROWS else df.select(order).sample(SAMPLE_ROWS / total, seed=1)
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    found = some.agg(F.percentile_approx(order, shares, F.lit(20 * parts)).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def range_number(order: str, cuts: list, kind: str) -> Column:
    """How many of the sorted cuts are not above a value, by binary search; 0 for NULL."""
    if not cuts:
        return F.lit(0)
    literal = F.array(*[F.lit(c).cast(kind) for c in cuts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(literal, at + step - 1) <= F.col(order), at + step).otherwise(at),
    )


def running_sums(
    df: DataFrame, keys, order: str, sums: dict[str, str], rows: int = RANGE_ROWS
) -> DataFrame:
    """Running totals per key in the order of a column that is unique in its key.

    ``sums`` maps a column to the name of its running total.  ``df`` is read several times, for the cuts at once.
    """
    kind = df.schema[order].dataType.simpleString()
    at = range_number(order, range_cuts(df, order, rows), kind)
    df = df.withColumns({KEY: F.struct(*keys), CHUNK: F.struct(at.alias("at"))})
    whole = df.groupBy(KEY, CHUNK).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(
        KEY, CHUNK, *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums]
    )
    so_far = (
        Window.partitionBy(KEY, CHUNK)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # The hash on the chunk is asked for: rows already hashed on a key alone would
    # satisfy the window and keep a hot key in one task.  The join reuses it.
    return (
        df.repartition(KEY, CHUNK)
        .withColumns({into: F.sum(c).over(so_far) for c, into in sums.items()})
        .join(offsets, [KEY, CHUNK])
        .withColumns({into: F.col(into) + F.col(f"_{c}") for c, into in sums.items()})
        .drop(KEY, CHUNK, *[f"_{c}" for c in sums])
    )


def numbered_rows(df: DataFrame, keys, id_col: str, into: str = "nth", rows: int = RANGE_ROWS) -> DataFrame:
    """``row_number`` per key in id order, without gathering a key in one task."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sums(ones, keys, id_col, {"_one": into}, rows).drop("_one")


def numbers_of(df: DataFrame, picked: DataFrame, keys, id_col: str, into: str = "nth") -> DataFrame:
    """The picked rows of a table with their ``row_number`` per key in id order (no id is NULL).

    Rows are counted, not ordered: only keys that were picked are looked at, and each task sends one count per
    picked row.
    """
    at = picked.select(F.struct(*keys).alias(KEY), F.col(id_col).alias("_at"))
    rows = df.select(F.struct(*keys).alias(KEY), F.col(id_col).alias("_id"))
    counts = rows.join(at, KEY).where(F.col("_id") <= F.col("_at")).groupBy(KEY, "_at").agg(F.count("*").alias(into))
    return (
        picked.withColumns({KEY: F.struct(*keys), "_at": F.col(id_col)}).join(counts, [KEY, "_at"], "left").drop(KEY, "_at")
    )
