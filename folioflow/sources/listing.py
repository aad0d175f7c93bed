"""Listing folders and reading whole files in tasks, so that the driver never holds a file list.

Folders are listed level by level, the folders of a level spread over the tasks. Names that Spark's readers take for hidden
(beginning with a dot or an underscore) are left out of workspaces. Paths may be of any file system pyarrow reads.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.plans.storage import materialise

ENTRY = "inside string, is_folder boolean, size long, modified long"
FOLDERS_IN_A_TASK = 500
FILES_IN_A_TASK, BYTES_IN_A_TASK = 10_000, 128_000_000
BATCH_FILES, BATCH_BYTES = 1000, 8_000_000


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    local = urlparse(path).scheme in ("", "file")
    files, root = (fs.LocalFileSystem(), os.path.abspath(urlparse(path).path)) if local else fs.FileSystem.from_uri(path)
    return files, root.rstrip("/")


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def listed_below(spark: SparkSession, root: str, inside: list[str], names: list[str] | None = None, hidden: bool = False) -> DataFrame:
    """The files below the folders ``inside`` of a root: ``inside`` (path from the root on), ``size``, ``modified`` (in ms)."""
    root = root if urlparse(root).scheme not in ("", "file") else open_path(root)[1]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_path(root)
        for batch in batches:
            for folder in batch.column("inside").to_pylist():
                found = files.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
                rows = [(posixpath.join(folder, f.base_name), f.type == fs.FileType.Directory, f.size, f.mtime_ns // 1_000_000)
                        for f in found if (hidden or not _hidden(f.base_name)) and (
                            f.type == fs.FileType.Directory or names is None or any(fnmatchcase(f.base_name, n) for n in names))]
                for at in range(0, len(rows), 10_000):
                    columns = zip(*rows[at : at + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()))],
                        names=["inside", "is_folder", "size", "modified"])

    level, tasks, found = spark.createDataFrame([(i,) for i in inside], "inside string"), len(inside), []
    while tasks:
        spread = min(tasks, max(spark.sparkContext.defaultParallelism, -(-tasks // FOLDERS_IN_A_TASK)))
        here = materialise(level.repartition(spread).mapInArrow(entries, ENTRY), "listing")
        found.append(here.filter("NOT is_folder").select("inside", "size", "modified"))
        level = here.filter("is_folder").select("inside")
        tasks = level.count()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "inside string, size long, modified long")


def listed(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """The files below a root whose name fits one of the patterns: ``path`` (without its scheme), ``size``, ``mtime``."""
    base = os.path.abspath(urlparse(root).path)
    return listed_below(spark, root, [""], list(names)).select(
        F.concat(F.lit(base.rstrip("/") + "/"), "inside").alias("path"), "size", F.timestamp_millis("modified").alias("mtime"), "inside")


def read_whole(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """As ``listed``, with each file's ``value``; the files are spread evenly over the tasks, and joins shuffle them."""
    found = listed(spark, root, *names)
    held = found.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-held["files"] // FILES_IN_A_TASK), -(-held["bytes"] // BYTES_IN_A_TASK))
    where = root if urlparse(root).scheme not in ("", "file") else open_path(root)[1]
    kinds = {"path": pa.string(), "value": pa.binary(), "size": pa.int64(), "mtime": pa.timestamp("us", "UTC")}

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_path(where)
        rows, size = [], 0
        for batch in batches:
            for path, length, mtime, inside in zip(*[batch.column(c).to_pylist() for c in ("path", "size", "mtime", "inside")]):
                with files.open_input_stream(f"{base}/{inside}", compression=None) as given:
                    rows.append((path, given.read(), length, mtime))
                size += len(rows[-1][1])
                if len(rows) >= BATCH_FILES or size >= BATCH_BYTES:
                    yield packed(rows)
                    rows, size = [], 0
        if rows:
            yield packed(rows)

    read = found.repartition(tasks, "path").mapInArrow(contents, "path string, value binary, size long, mtime timestamp")
    # Spark takes the texts to be as small as their listing and would broadcast them to a join.
    return read.withColumn("value", F.col("value").cast("string")).hint("merge")
