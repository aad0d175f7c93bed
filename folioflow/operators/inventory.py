"""What a workspace holds: documents, folders, candidates for deflation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions import text as T


def in_batch() -> Column:
    return F.coalesce(F.col("batch_status").isin(K.JOB_STATES_ACTIVE), F.lit(False))


def is_ready() -> Column:
    return ~F.col("is_converted") & ~in_batch()


def with_batch_status(inventory: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add the active job of each document: ``batch_status, batch_job_id``.

    ``jobs`` is ``job_id, status, is_completed, pdf_paths, pos``; of several active jobs listing a
    document the last listed one counts.
    """
    active = jobs.filter(F.col("status").isin(K.JOB_STATES_ACTIVE) & ~F.coalesce("is_completed", F.lit(False)))
    by_path = active.select(F.explode("pdf_paths").alias("path"), "status", "job_id", "pos").groupBy("path").agg(
        F.max_by(F.struct("status", "job_id"), "pos").alias("j"))
    named = by_path.select("path", F.col("j.status").alias("batch_status"), F.col("j.job_id").alias("batch_job_id"))
    return inventory.join(named, "path", "left")


def filter_inventory(df: DataFrame, status: str = "all", query: str = "") -> DataFrame:
    kinds = {"ready": is_ready(), "converted": F.col("is_converted"), "batch": in_batch()}
    out = df.filter(kinds[status]) if status in kinds else df
    needle = query.lower()
    return out.filter(F.lower("name").contains(needle) | F.lower("folder").contains(needle)) if needle else out


def order_inventory(df: DataFrame, mode: str = "year_desc") -> DataFrame:
    year = F.coalesce(T.year_of("name"), F.lit(0))
    keys = {
        "year_desc": [year.desc(), F.asc("name")], "year_asc": [year.asc(), F.asc("name")], "name_asc": [F.asc("name")],
        "pages_desc": [F.coalesce("total_pages", F.lit(0)).desc()], "size_desc": [F.coalesce("size", F.lit(0)).desc()],
    }.get(mode, [])
    return df.orderBy(*keys, "path")


def order_catalogue(df: DataFrame) -> DataFrame:
    """By folder, originals before consolidations, then by name."""
    return df.orderBy("folder", F.col("is_consolidated").cast("int"), "name", "path")


def workspace_rollup(df: DataFrame) -> DataFrame:
    """Documents, converted, ready, in batch and pages per folder, and a row 'ALL' over everything."""
    tally = lambda cond: F.count(F.when(cond, 1))
    rolled = df.rollup("folder").agg(
        F.grouping("folder").alias("_all"), F.count(F.lit(1)).alias("documents"), tally(F.col("is_converted")).alias("converted"),
        tally(is_ready()).alias("ready"), tally(in_batch()).alias("in_batch"),
        F.coalesce(F.sum("total_pages"), F.lit(0)).cast("bigint").alias("pages"))
    return rolled.withColumn("folder", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("folder"))).drop("_all")


def deflate_candidates(catalogue: DataFrame) -> DataFrame:
    """Transcripts that can be deflated, with the size of their lightweight copy where one exists."""
    light = catalogue.filter(T.is_lightweight("path")).select(
        F.regexp_replace("path", rf"/{K.LIGHTWEIGHT_DIR}/([^/]*)$", f"/{K.MARKDOWN_DIR}/$1").alias("path"),
        F.col("size").alias("deflated_size"), F.col("path").alias("deflated_path"))
    originals = catalogue.filter(
        ~T.is_lightweight("path") & ~T.is_consolidated("path") & T.has_component("path", K.MARKDOWN_DIR)
        & ~F.col("name").endswith(K.INDEX_SUFFIX))
    entity = T.entity_of("path")
    return originals.join(light, "path", "left").select(
        "path", "name", T.file_stem("path").alias("stem"), entity.alias("entity"), T.peer_group(entity).alias("peer_group"),
        "size", "deflated_size", "deflated_path")


def order_candidates(df: DataFrame) -> DataFrame:
    return df.orderBy(F.lower("entity"), F.lower("name"), "path")


def within_written(occurrences: DataFrame, written: DataFrame) -> DataFrame:
    """Occurrences in documents of the written set."""
    return occurrences.join(written.select("doc").distinct(), "doc", "left_semi")


def ingest_changed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files whose size or modification time differs from what was read before."""
    return current.join(previous.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def newest_versions(history: DataFrame) -> DataFrame:
    """The newest version of each path."""
    rest = [c for c in history.columns if c != "path"]
    best = history.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("mtime", "size")).alias("v"))
    return best.select("path", *[F.col("v")[c].alias(c) for c in rest]).select(*history.columns)
