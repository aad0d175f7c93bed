"""A data source that writes one file per row: ``file`` (relative path) and ``text``, below one root.

Tasks write into folders of their own below a staging folder; the commit lists the folders of the tasks that count, an abort
removes the staging folder, and a task that fails removes its own. A second job then moves the files to their names. So readers
see the files of a finished write only, an attempt that is repeated leaves nothing behind, and the driver handles one name per
task, not one per file. A file of the same name is replaced. Paths may be of any file system pyarrow reads.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from folioflow.plans.storage import materialise
from folioflow.sources.listing import listed_below, open_path

STAGING, COMMITTED = "_staging-", "_committed"
MOVERS = 16
MOVES_IN_A_TASK = 20_000


@dataclass
class Staged(WriterCommitMessage):
    folder: str


def _inside(name: str | None) -> str:
    clean = posixpath.normpath(name or "")
    if not name or clean in (".", "..") or clean.startswith(("/", "../")):
        raise ValueError(f"no file name below the root: {name!r}")
    return clean


class DocumentWriter(DataSourceWriter):
    def __init__(self, staging: str):
        self.staging = staging
        files, root = open_path(staging)
        files.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, root = open_path(self.staging)
        name, made = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}", set()
        folder = f"{root}/{name}"

        def make(place: str) -> None:
            """Level by level, never the staging folder: a task that outlives an abort fails and restores nothing."""
            if place not in made:
                if place != folder:
                    make(posixpath.dirname(place))
                files.create_dir(place, recursive=False)
                made.add(place)

        try:
            make(folder)
            for row in iterator:
                place = f"{folder}/{_inside(row['file'])}"
                make(posixpath.dirname(place))
                with files.open_output_stream(place) as out:
                    out.write((row["text"] or "").encode())
        except BaseException:
            if files.get_file_info(folder).type == fs.FileType.Directory:
                files.delete_dir(folder)
            raise
        return Staged(name)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = open_path(self.staging)
        with files.open_output_stream(f"{root}/{COMMITTED}") as out:
            out.write("\n".join(m.folder for m in messages if m).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        clean(self.staging)


def clean(staging: str) -> None:
    files, root = open_path(staging)
    if files.get_file_info(root).type == fs.FileType.Directory:
        files.delete_dir(root)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folioflow_documents"

    def schema(self) -> str:
        return "file string, text string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def write_documents(df: DataFrame, root: str, file: Column, text: Column) -> None:
    """Write one file per row below ``root``."""
    spark = df.sparkSession
    spark.dataSource.register(DocumentFiles)
    staging = f"{root.rstrip('/')}/{STAGING}{uuid.uuid4().hex}"
    df.select(file.cast("string").alias("file"), text.cast("string").alias("text")).write.format(DocumentFiles.name()).mode("append").save(staging)
    try:
        _publish(spark, root, staging)
    finally:
        clean(staging)


def _publish(spark: SparkSession, root: str, staging: str) -> None:
    """Move the staged files to their names. Of several files of one name the last task's stays, so a repeated move changes nothing."""
    files, place = open_path(staging)
    with files.open_input_stream(f"{place}/{COMMITTED}") as given:
        folders = given.read().decode().split()
    staged = materialise(listed_below(spark, staging, folders, hidden=True).select("inside", F.split("inside", "/", 2)[1].alias("file")), "staged")
    tasks = max(spark.sparkContext.defaultParallelism, -(-staged.count() // MOVES_IN_A_TASK))
    moves = staged.repartition(tasks, "file").groupBy("file").agg(F.max("inside").alias("inside"))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = open_path(root)
        source = open_path(staging)[1]
        local, made = isinstance(target, fs.LocalFileSystem), set()

        def one(pair: tuple[str, str]) -> None:
            at, to = f"{source}/{pair[1]}", f"{base}/{pair[0]}"
            try:
                if not local and target.get_file_info(to).type != fs.FileType.NotFound and target.get_file_info(at).type == fs.FileType.File:
                    target.delete_file(to)
                target.move(at, to)  # on a local file system it replaces
            except OSError:  # another attempt of this task was first
                if target.get_file_info(at).type == fs.FileType.File or target.get_file_info(to).type != fs.FileType.File:
                    raise

        with ThreadPoolExecutor(1 if local else MOVERS) as pool:
            for batch in batches:
                pairs = list(zip(batch.column("file").to_pylist(), batch.column("inside").to_pylist()))
                for folder in {posixpath.dirname(f"{base}/{file}") for file, _ in pairs} - made:
                    target.create_dir(folder, recursive=True)
                    made.add(folder)
                for _ in pool.map(one, pairs):
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([len(pairs)], pa.int64())], names=["moved"])

    moves.mapInArrow(move, "moved long").agg(F.sum("moved")).collect()
