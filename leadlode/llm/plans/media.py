"""op5: all documents stored as lossless WebP and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlode.llm.common import documents
from leadlode.llm.media import examine, store


def op5_webp(spark, folder):
    stored = documents(spark, folder).select("doc_id", store(F.col("text").cast("string")).alias("stored"))
    read = stored.select("doc_id", "stored.n_bytes", "stored.media", examine(F.col("stored.media")).alias("found"))
    return read.select(
        "doc_id",
        "n_bytes",
        "found.payload_bytes",
        "found.payload_sha256",
        "found.tail_crc32",
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "found.feature",
    )


QUERIES = {"op5_webp": op5_webp}
SQL = {}
