"""Session settings the jobs are tuned for, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# A join whose hot key must be split keeps its split even where that costs one more
# shuffle for the aggregation behind it.
SKEW_SETTINGS = {"spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
# Streaming state that outgrows the heap is kept on disk.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}

_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app: str = "leadlode", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and skew-join splitting on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **SKEW_SETTINGS,
        **STATE_SETTINGS,
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Turn the skew and state settings on in a given session, unless it sets them itself."""
    given = spark.sparkContext.getConf()
    for key, value in (SKEW_SETTINGS | STATE_SETTINGS).items():
        if not given.contains(key):
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="leadlode-ckpt-")
    return _LOCAL_FOLDERS[app]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(os.path.join(checkpoint_dir(df.sparkSession), "rdd"))
    return df.checkpoint()


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within this, the shuffle files of a query go when it ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_shared(df: DataFrame, **options) -> tuple[DataFrame, str]:
    """Write a frame as a table of the shared folder; the frame that reads it, and its folder.

    A lost executor costs no more than the tasks it ran, and the reader knows the size on
    disk, by which Spark picks its joins.  The folder goes when the application ends, or
    earlier by ``drop_shared``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/leadlode-tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    files, where = shared_files(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def drop_shared(spark: SparkSession, path: str) -> None:
    files, where = shared_files(spark, path)
    files.delete(where, True)


def shared_files(spark: SparkSession, path: str):
    """The file system that holds a path, and the path as it takes it."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where
