"""What the training-data operators share: words, shared tables, bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlode.session import write_shared

#: The white space that separates words: space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

#: Bytes of one Arrow batch: whole texts travel to Python.
BATCH_BYTES = 4 << 20


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null and for blank texts."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, BLANK_RUN))).cast("long")


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch of texts can hold in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{folder}/documents.parquet")


def shared_table(df: DataFrame) -> DataFrame:
    """Write a frame to the cluster's shared folder and read it back."""
    return write_shared(df)[0]


#: Slots of a bitmap that stands for a set of 64-bit hashes: 16 MB of bits whatever the set's
#: size, so that it may be broadcast.  A full bitmap lets more rows pass and changes no result.
BITMAP_SLOTS = 1 << 27
BITMAP_BLOCK = 1 << 15


def bitmap_blocks(hashes: DataFrame, column: str, slots: int = BITMAP_SLOTS) -> DataFrame:
    """``block, bits``: the set bits of a hash column, 32768 slots to a block."""
    slot = F.pmod(F.col(column), F.lit(slots))
    return (
        hashes.select(F.floor(slot / BITMAP_BLOCK).alias("block"), (slot % BITMAP_BLOCK).alias("place"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("place").alias("bits"))
    )


def bitmap_split(rows: DataFrame, key: str, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be in a table of keys, and rows whose key is not.

    The bitmap is at most 16 MB, so it is broadcast; what is not in the table need not be shuffled to find out.
    """
    slot = F.pmod(F.col(key), F.lit(BITMAP_SLOTS))
    blocks = F.broadcast(bitmap_blocks(keys, column).select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))
    place = (slot % BITMAP_BLOCK).cast("int")
    byte = F.conv(F.hex(F.substr("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = rows.join(blocks, F.floor(slot / BITMAP_BLOCK) == F.col("_block"), "left")
    power = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), place % 8 + 1)
    hit = F.coalesce(byte.bitwiseAND(power) > 0, F.lit(False))
    columns = [rows[c] for c in rows.columns]
    return told.where(hit).select(*columns), told.where(~hit).select(*columns)
