"""Figures about a deflation run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions import text as T
from folioflow.operators.deflate import Scan, is_boilerplate, reduction_pct


def scan_summary(corpus: DataFrame, scanned: Scan, threshold: int) -> DataFrame:
    """One row: files, companies and families read, sections seen, passages that count as boilerplate."""
    by_entity = corpus.groupBy("entity", "grp").agg(F.count(F.lit(1)).alias("files"))
    read = by_entity.agg(
        F.sum("files").alias("files_scanned"), F.count_distinct("entity").alias("entities_scanned"),
        F.count_distinct("grp").alias("groups_scanned"))
    sections = scanned.sections.agg(F.count(F.lit(1)).alias("n"))
    candidates = scanned.library.filter(is_boilerplate(threshold, scanned.options.peer_threshold)).agg(
        F.count(F.lit(1)).alias("n"))
    return read.select("*", sections.scalar().alias("total_sections"), candidates.scalar().alias("candidate_sections"))


def deflate_summary(results: DataFrame) -> DataFrame:
    totals = results.agg(
        F.count(F.lit(1)).alias("files_deflated"), F.sum("original_size").alias("total_original_bytes"),
        F.sum("lightweight_size").alias("total_lightweight_bytes"))
    saved = F.col("total_original_bytes") - F.col("total_lightweight_bytes")
    return totals.select(
        "*", reduction_pct(F.col("total_lightweight_bytes"), F.col("total_original_bytes")).alias("total_reduction_pct"),
        T.estimated_tokens(saved).alias("est_tokens_saved"))


def boilerplate_patterns(
    scanned: Scan, threshold: int, verdicts: DataFrame | None = None, top: int = K.PATTERN_LIMIT
) -> DataFrame:
    """The most widely shared passages, each row also carrying how many there are in total."""
    rule = is_boilerplate(threshold, scanned.options.peer_threshold)
    found = scanned.library.filter(rule)
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = found.orderBy(F.desc("entities"), F.desc("files"), "fp").limit(top)
    if verdicts is None:
        ranked = ranked.withColumn("verdict", F.lit(None).cast("string"))
    else:
        ranked = ranked.join(verdicts.select("fp", "verdict"), "fp", "left")
    return ranked.select(
        "fp", F.coalesce(F.nullif("heading", F.lit("")), F.lit("(untitled)")).alias("heading"),
        F.col("entities").alias("companies"), F.col("files").alias("filings"), F.col("word_count").alias("words"),
        "verdict", F.substring("example", 1, K.PATTERN_EXAMPLE_CHARS).alias("example"), total.alias("pattern_count"))


def restated_passages(removals: DataFrame) -> DataFrame:
    return removals.filter(F.col("reason") == "restatement").groupBy("heading").agg(
        F.count(F.lit(1)).alias("copies")).orderBy(F.desc("copies"), "heading")


def protected_sections(library: DataFrame) -> DataFrame:
    guarded = library.filter(F.col("is_protected") | F.col("is_financial"))
    reason = F.concat_ws(
        ", ", F.when(F.col("is_financial"), F.lit("Financial statement")),
        F.when(F.col("is_protected"), F.lit("Protected keyword")))
    return guarded.select(
        "fp", F.coalesce(F.nullif("heading", F.lit("")), F.lit("(untitled)")).alias("heading"),
        reason.alias("reason"), "files")


def file_report(results: DataFrame) -> DataFrame:
    kilobytes = lambda c: F.format_string("%.1f KB", F.col(c) / 1024)
    return results.select(
        "doc", "name", "entity", "original_size", "lightweight_size", "reduction_pct", "sections_removed",
        kilobytes("original_size").alias("original"), kilobytes("lightweight_size").alias("lightweight")).orderBy(
            F.desc("reduction_pct"), "doc")


def verification_summary(candidates: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """Candidates put to the classifier and what it said. ``verdicts`` is ``fp, verdict``, with a
    NULL verdict where the classifier failed."""
    if verdicts is None:
        joined = candidates.select("fp", F.lit(None).cast("string").alias("verdict"), F.lit(False).alias("asked"))
    else:
        joined = candidates.select("fp").join(
            verdicts.select("fp", "verdict", F.lit(True).alias("asked")), "fp", "left")
    asked = F.coalesce("asked", F.lit(False))
    tally = lambda cond: F.count(F.when(cond, 1))
    counts = joined.agg(
        F.count(F.lit(1)).alias("candidates"), tally(F.col("verdict").isNotNull()).alias("verified"),
        tally(F.col("verdict") == "strip").alias("strip"),
        tally(F.col("verdict").isNotNull() & (F.col("verdict") != "strip")).alias("keep"),
        tally(asked & F.col("verdict").isNull()).alias("failed"))
    return counts.withColumn("available", F.lit(verdicts is not None) | (F.col("candidates") == 0))
