"""Tables that a stream keeps up to date: the newest row of every key, in at most two generations.

A batch is merged into the small recent generation, which is written anew. Once that holds more than a share of the rows of
the base, both are merged into a new base, so a row is rewritten a bounded number of times while the table doubles. A manifest
per batch names the generations; readers follow the newest one and never list or read the history. Every folder carries the
number of its batch: running a batch again rebuilds the same generations from the manifest before it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StreamTable:
    """The newest row per ``keys``, newest by ``order``; equal rows are one, ties go by the other columns."""

    def __init__(self, path: str, keys: list[str], order: list[str], share: float = 0.25):
        self.path, self.keys, self.order, self.share = path.rstrip("/"), keys, order, share

    def newest(self, rows: DataFrame) -> DataFrame:
        rest = [*self.order, *[c for c in rows.columns if c not in self.keys and c not in self.order]]
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("v"))
        return best.select(*self.keys, *[F.col("v")[c].alias(c) for c in rest]).select(*rows.columns)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        numbers = [n for n in self._manifests(spark) if n < batch_id]
        before = self._manifest(spark, numbers[-1]) if numbers else {"base": None, "recent": None}
        recent = self._write(self._load(spark, before["recent"], batch), f"recent-{batch_id:012d}")
        base, folded = before["base"], None
        if base is None or recent["rows"] > self.share * base["rows"]:
            both = self._load(spark, recent, None)
            base = self._write(self._load(spark, base, both), f"base-{batch_id:012d}")
            recent, folded = None, recent["folder"]
        kept = {"base": base, "recent": recent, "schema": batch.schema.jsonValue()}
        self._put(spark, f"{self.path}/manifests/{batch_id:012d}.json", json.dumps(kept))
        if folded:
            self._delete(spark, f"{self.path}/{folded}")
        # the manifest before this one may still be read; what only older ones name goes
        named = {g["folder"] for m in (before, kept) for g in (m["base"], m["recent"]) if g}
        for old in numbers[:-1]:
            manifest = self._manifest(spark, old)
            for g in (manifest["base"], manifest["recent"]):
                if g and g["folder"] not in named:
                    self._delete(spark, f"{self.path}/{g['folder']}")
            self._delete(spark, f"{self.path}/manifests/{old:012d}.json")

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest row of every key."""
        numbers = self._manifests(spark)
        if not numbers:
            raise FileNotFoundError(f"{self.path} holds no batch")
        newest = self._manifest(spark, numbers[-1])
        base = self._load(spark, newest["base"], None)
        return base if newest["recent"] is None else self.newest(base.unionByName(self._load(spark, newest["recent"], None)))

    def generations(self, spark: SparkSession) -> list[str]:
        newest = self._manifest(spark, self._manifests(spark)[-1])
        return [g["folder"] for g in (newest["base"], newest["recent"]) if g]

    def _load(self, spark: SparkSession, generation: dict | None, more: DataFrame | None) -> DataFrame:
        if generation is None:
            return self.newest(more)
        stored = spark.read.parquet(f"{self.path}/{generation['folder']}")
        return stored if more is None else self.newest(stored.unionByName(more))

    def _write(self, rows: DataFrame, folder: str) -> dict:
        rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        return {"folder": folder, "rows": rows.sparkSession.read.parquet(f"{self.path}/{folder}").count()}

    # --- small files, through the cluster's file system ---
    def _place(self, spark: SparkSession, path: str):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self, spark: SparkSession) -> list[int]:
        place, files = self._place(spark, f"{self.path}/manifests")
        names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, spark: SparkSession, number: int) -> dict:
        place, files = self._place(spark, f"{self.path}/manifests/{number:012d}.json")
        stream = files.open(place)
        try:
            return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, spark: SparkSession, path: str, text: str) -> None:
        """Written aside and renamed, so that readers see a manifest whole or not at all."""
        aside, files = self._place(spark, path + ".part")
        stream = files.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        place, _ = self._place(spark, path)
        files.delete(place, False)
        files.rename(aside, place)

    def _delete(self, spark: SparkSession, path: str) -> None:
        place, files = self._place(spark, path)
        files.delete(place, True)
