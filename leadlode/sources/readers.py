"""Table, JSON and message readers with declared schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlode import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table of long texts, as it lies.

    Work on texts is spread by the splits of the scan (``spark.sql.files.maxPartitionBytes``),
    never by a shuffle of the texts; ``key`` names the column that tells its rows apart.
    """
    return table(spark, folder, name)


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """Country file (one JSON array) as ``country, code, cities``."""
    return spark.read.schema(schemas.COUNTRIES).option("multiLine", True).json(path)


def country_city_rows(countries: DataFrame) -> DataFrame:
    return countries.select("country", "code", F.explode_outer("cities").alias("city"))


def read_progress(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Progress file as (seen domains, last page per query)."""
    progress = spark.read.schema(schemas.PROGRESS).option("multiLine", True).json(path)
    seen = progress.select(F.explode("processed_domains").alias("domain")).distinct()
    pages = progress.select(F.explode("query_progress").alias("query", "page"))
    return seen, pages


def parse_events(line: Column) -> Column:
    """One NDJSON line as an event struct, NULL when it is no valid event."""
    parsed = F.from_json(
        line, schemas.DISCOVERY_EVENT + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}
    )
    return F.when(parsed["_bad"].isNull() & parsed["type"].isNotNull(), parsed.dropFields("_bad"))


def event_rows(lines: DataFrame) -> DataFrame:
    """Valid events of a text table or stream; broken lines are skipped."""
    return (
        lines.select(parse_events(F.trim("value")).alias("e"))
        .where(F.col("e").isNotNull())
        .select("e.*")
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return event_rows(spark.read.text(path))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return event_rows(spark.readStream.text(path))


def merge_versions(*versions: DataFrame) -> DataFrame:
    """Union of table versions whose columns were only ever added."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), versions)
