"""Streams: transcript ingest, job status, result collection."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from folioflow import constants as K
from folioflow.operators.ledger import blocked_pages, collect_results
from folioflow.streaming.tables import StreamTable

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAGE = ["model", "doc", "page_num"]


JOB = "ended_ts timestamp, ended_seq bigint, ended_status string, latest_ts timestamp, latest_seq bigint, latest_status string"
STATUS = "job_id string, status string, is_completed boolean, completed_at timestamp"


class JobStatus(StatefulProcessor):
    """Status of one job: its first terminal event, else its latest other event.

    Both are a minimum and a maximum, so repeated events and any order within the watermark's delay give the same result.
    A job that has ended is forgotten ``keep`` after its last event; events later than the watermark do not reach it.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)

    def handleInputRows(self, key, rows, timerValues):
        stamps = [(ts.to_pydatetime(), int(seq), status) for found in rows for ts, seq, status in zip(found["ts"], found["seq"], found["status"])]
        held = self.job.get() or (None,) * 6
        ended, latest = (tuple(held[i : i + 3]) if held[i] is not None else None for i in (0, 3))
        first = min([s for s in [*stamps, ended] if s and s[2] in K.JOB_STATES_TERMINAL], default=None)
        last = max([s for s in [*stamps, latest] if s and s[2] not in K.JOB_STATES_TERMINAL], default=None)
        self.job.update((*(first or (None,) * 3), *(last or (None,) * 3)))
        if first and not ended:
            self.handle.registerTimer(max(self._end(first, last), timerValues.getCurrentWatermarkInMs() + 1))
        status = first or last
        done = first[0] if first and first[2] == K.JOB_STATES_TERMINAL[0] else None
        yield pd.DataFrame({"job_id": [key[0]], "status": [status[2]], "is_completed": [first is not None],
                            "completed_at": pd.Series([done], dtype="datetime64[us]")})

    def _end(self, first: tuple, last: tuple | None) -> int:
        return int(max(s[0] for s in (first, last) if s).timestamp() * 1000) + self.keep_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.job.get()
        end = self._end(tuple(held[:3]), tuple(held[3:]) if held[3] is not None else None) if held else 0
        if end > timerValues.getCurrentWatermarkInMs():  # events came after the one that set the timer
            self.handle.registerTimer(end)
        else:
            self.job.clear()
        yield from ()

    def close(self) -> None:
        pass


def job_status_stream(events: DataFrame, delay: str = "1 day", keep: timedelta = timedelta(days=1)) -> DataFrame:
    """Running status of each job from a stream of ``job_id, status, ts, seq``.

    Events up to ``delay`` behind the newest count, older ones are late. State holds the open jobs and those that ended
    within ``delay`` and ``keep``, however many jobs there have been. Needs the RocksDB state store.
    """
    # job ids travel as text, whatever their type
    rows = events.select(F.col("job_id").cast("string").alias("job_id"), "status", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("bigint").alias("seq"))
    rows = rows.filter(F.col("job_id").isNotNull() & F.col("status").isNotNull() & F.col("ts").isNotNull())
    out = rows.withWatermark("ts", delay).groupBy("job_id").transformWithStateInPandas(
        JobStatus(int(keep.total_seconds() * 1000)), STATUS, "Update", "EventTime")
    return out.withColumn("job_id", F.col("job_id").cast(events.schema["job_id"].dataType))


def write_job_status(events: DataFrame, table_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Keep the latest status of each job as a streamed table."""

    def store(batch: DataFrame, batch_id: int) -> None:
        StreamTable(table_path, ["job_id"], ["batch_id"]).merge(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")), batch_id)

    # a query keeps the settings it started with; timers act with the next events, not in a batch of their own
    spark, settings = events.sparkSession, {STATE_STORE: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        return job_status_stream(events, **options).writeStream.outputMode("update").foreachBatch(store).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def latest_job_status(spark: SparkSession, table_path: str) -> DataFrame:
    """The stored row of each job."""
    return StreamTable(table_path, ["job_id"], ["batch_id"]).read(spark).drop("batch_id")


def collect_stream(
    responses: DataFrame, mapping: DataFrame, model: str, cache_path: str, refused_path: str, checkpoint: str
) -> StreamingQuery:
    """File response lines as they arrive: pages with text to the cache, empty ones to a side table.

    A batch is read once. It is merged into both tables by its number, so running it again changes nothing.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            pages = collect_results(batch, mapping).select("doc", "page_num", "text")
            collected = pages.select(F.lit(model).alias("model"), "doc", "page_num", "text", F.lit(batch_id).cast("bigint").alias("batch_id"))
            StreamTable(cache_path, PAGE, ["batch_id"]).merge(collected, batch_id)
            refused = blocked_pages(batch, mapping).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            StreamTable(refused_path, ["doc", "page_num"], ["batch_id"]).merge(refused, batch_id)
        finally:
            batch.unpersist()

    return responses.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def collected_pages(spark: SparkSession, cache_path: str) -> DataFrame:
    """One row per page of the streamed cache: the newest delivery."""
    return StreamTable(cache_path, PAGE, ["batch_id"]).read(spark).select(*PAGE, "text")


def ingest_stream(files: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest version of every transcript; ``ingested`` reads them."""

    def store(batch: DataFrame, batch_id: int) -> None:
        StreamTable(table_path, ["path"], ["mtime", "size"]).merge(batch, batch_id)

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest version of each path."""
    return StreamTable(table_path, ["path"], ["mtime", "size"]).read(spark)


def heartbeat_counts(events: DataFrame, window: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """Heartbeats per file and window; windows close once the watermark has passed them."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "file").agg(F.count(F.lit(1)).alias("beats"))
