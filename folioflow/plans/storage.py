"""Stored intermediate results.

Iterative operators and shared inputs are cut off from their lineage by writing them as tables into
the shared folder named by ``spark.checkpoint.dir``, so that a lost executor costs a re-read and not
a recomputation. Only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_written: ContextVar[list | None] = ContextVar("written", default=None)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-folioflow-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark)}/folioflow/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a DataFrame once and read it back: columnar, prunable, without lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _lean(spark):
        df.write.parquet(path, compression="zstd")
    return _noted(spark.read.schema(df.schema).parquet(path), path)


@contextmanager
def _lean(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when a table is written, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _noted(df: DataFrame, path: str, name: str | None = None) -> DataFrame:
    df.stored_path = path
    if _written.get() is not None:
        _written.get().append((path, name, df))
    return df


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list]:
    """Tables stored inside are deleted at the end, but for those whose DataFrames were put into the list."""
    kept: list[DataFrame] = []
    outer, token = _written.get(), _written.set([])
    try:
        yield kept
    finally:
        here = _written.get()
        _written.reset(token)
        stay = {df.stored_path for df in kept}
        for path, name, df in here:
            if path in stay:
                if outer is not None:
                    outer.append((path, name, df))
                continue
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored_whole(spark: SparkSession, path: str) -> bool:
    """Whether a table at ``path`` was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def materialise_by(df: DataFrame, key: str, label: str = "table") -> DataFrame:
    """As ``materialise``, in buckets of a key: later joins on it read the table in place and move only their other side."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = f"folioflow_{path.rsplit('-', 1)[1]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _lean(spark):
        df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return _noted(spark.read.table(name), path, name)
