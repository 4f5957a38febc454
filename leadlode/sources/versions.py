"""Tables that are saved by rewriting only the buckets a save meets; every earlier version can be read.

A table is cut into buckets by a hash of its key column.  A save writes the buckets that its rows fall
into as new folders under ``root/data`` and then one small manifest that names the folder of each bucket.
The manifest appears by one rename that fails if another save took the number before, so readers see
whole versions only; of two writers, one gets ``VersionConflict`` and can save again.  What a lost
writer leaves is named by no manifest.

The driver holds the manifest: one name per bucket, whatever the rows.  A bucket is read and written by
as many tasks as its size asks for (``rebalance``); choose the number of buckets when the table is made.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlode.session import shared_files

BUCKETS = 256
BUCKET = "_bucket"


class VersionConflict(RuntimeError):
    """Another save made this version first."""


class VersionedTable:
    """A bucketed table under ``root``; ``create`` makes it, the methods read and save it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, root: str, key: str, buckets: int = BUCKETS, batch: int = -1) -> VersionedTable:
        """Version 1 from a frame that has each key once (null keys have a bucket as well)."""
        made = cls(rows.sparkSession, root)
        written = made._write(rows, key, buckets)
        made._commit(1, {"key": key, "buckets": buckets, "schema": rows.schema.json(), "batch": batch, "folders": written})
        return made

    def versions(self) -> list[int]:
        files, where = shared_files(self.spark, f"{self.root}/manifest")
        if not files.exists(where):
            return []
        names = [f.getPath().getName() for f in files.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        version = version or max(self.versions())
        line = self.spark.read.text(f"{self.root}/manifest/{version:010d}.json").first()[0]
        return json.loads(line) | {"version": version}

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest if none is named."""
        found = self.manifest(version)
        return self._rows(found, found["folders"])

    def bucket_of(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")

    def merge(self, changes: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> int:
        """Replace the buckets that ``changes`` meet by ``fold(their rows, changes)``; the new version.

        ``changes`` has the key column and is read three times, so write it first if it is dear.  ``fold`` must
        return the table's columns and keep rows in their buckets.  With a ``batch`` number a replay of a batch that
        was committed changes nothing.
        """
        found = self.manifest()
        if batch is not None and batch <= found["batch"]:
            return found["version"]
        key, buckets = found["key"], found["buckets"]
        met = [str(r[0]) for r in changes.select(self.bucket_of(F.col(key), buckets)).distinct().collect()]
        old = self._rows(found, {b: f for b, f in found["folders"].items() if b in met})
        columns = [f["name"] for f in json.loads(found["schema"])["fields"]]
        written = self._write(fold(old, changes).select(*columns), key, buckets)
        folders = {b: f for b, f in found["folders"].items() if b not in met} | written
        self._commit(found["version"] + 1, found | {"folders": folders, "batch": found["batch"] if batch is None else batch})
        return found["version"] + 1

    def upsert(self, rows: DataFrame, batch: int | None = None) -> int:
        """Rows replace those of their key or are added; ``rows`` has each key once and all columns."""
        key = self.manifest()["key"]

        def fold(old: DataFrame, new: DataFrame) -> DataFrame:
            kept = old.alias("o").join(new.select(F.col(key).alias("_k")), F.col(f"o.{key}").eqNullSafe(F.col("_k")), "left_anti")
            return kept.unionByName(new.select(*old.columns))

        return self.merge(rows, fold, batch)

    def rewritten(self, version: int) -> int:
        """How many buckets a version has in other folders than the one before."""
        now, before = self.manifest(version)["folders"], self.manifest(version - 1)["folders"] if version > 1 else {}
        return sum(now.get(b) != before.get(b) for b in {*now, *before})

    def _rows(self, found: dict, folders: dict) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(found["schema"]))
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/data/{folder}/{BUCKET}={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.schema(schema).parquet(*paths)

    def _write(self, rows: DataFrame, key: str, buckets: int) -> dict:
        folder = uuid.uuid4().hex
        path = f"{self.root}/data/{folder}"
        placed = rows.withColumn(BUCKET, self.bucket_of(F.col(key), buckets))
        placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)
        files, where = shared_files(self.spark, path)
        names = [f.getPath().getName() for f in files.listStatus(where)]
        return {n.split("=", 1)[1]: folder for n in names if n.startswith(f"{BUCKET}=")}

    def _commit(self, version: int, content: dict) -> None:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files, draft = shared_files(self.spark, f"{self.root}/manifest/_{uuid.uuid4().hex}")
        line = json.dumps({k: v for k, v in content.items() if k != "version"})
        out = files.create(draft, False)
        out.write(bytearray(line.encode()))
        out.close()
        target = files.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/{version:010d}.json"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(draft), target, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:  # only a taken number is a conflict
            files.delete(draft, False)
            if "FileAlreadyExistsException" in str(error):
                raise VersionConflict(f"version {version} of {self.root} is taken") from error
            raise
