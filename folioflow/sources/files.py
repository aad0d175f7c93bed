"""Readers and writers for workspaces, page caches, batch lines, rate cards and plans."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions import text as T
from folioflow.operators.combine import PART_ORDER
from folioflow.operators.cost import RATE_FIELDS
from folioflow.operators.ledger import RESPONSE_SCHEMA
from folioflow.sources.document_sink import write_documents
from folioflow.sources.listing import listed, read_whole

TRANSCRIPT_SCHEMA = "path string, name string, text string, size bigint, mtime timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    if urlparse(path).scheme in ("", "file"):
        return os.path.exists(urlparse(path).path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


# --- transcripts -----------------------------------------------------------------------------------------
def read_transcripts(spark: SparkSession, root: str, include_consolidated: bool = False) -> DataFrame:
    """Every Markdown file below a root as one row; lightweight copies are left out, a missing root is empty."""
    if not _exists(spark, root):
        return spark.createDataFrame([], TRANSCRIPT_SCHEMA)
    df = read_whole(spark, root, "*.md").select("path", T.file_name("path").alias("name"), F.col("value").alias("text"), "size", "mtime")
    df = df.filter(~T.is_lightweight("path"))
    return df if include_consolidated else df.filter(~T.is_consolidated("path"))


def corpus_transcripts(df: DataFrame) -> DataFrame:
    """The transcripts a deflation reads: proper documents inside a Markdown folder."""
    return df.filter(
        T.has_component("path", K.MARKDOWN_DIR) & ~T.is_consolidated("path") & ~T.is_lightweight("path")
        & ~F.col("name").endswith(K.INDEX_SUFFIX) & ~F.col("name").startswith("."))


def as_corpus(df: DataFrame) -> DataFrame:
    """Transcripts in the shape deflation takes; files are visited in order of their path components."""
    return df.select(
        F.col("path").alias("doc"), T.path_parts("path").alias("visit"), T.entity_of("path").alias("entity"), "name", "text")


def markdown_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """All Markdown files with flags, size and display folder, without reading any content."""
    base = os.path.abspath(urlparse(root).path)
    df = listed(spark, root, "*.md").select("path", "size", "mtime")
    df = df.withColumn("name", T.file_name("path")).filter(
        ~F.col("name").endswith(K.INDEX_SUFFIX) & ~F.col("name").startswith(".") & (F.col("name") != K.REPORT_NAME))
    inside = F.substring("path", F.lit(len(base) + 2), F.length("path"))
    folder = F.regexp_replace(inside, r"/?[^/]*$", "")
    folder = F.regexp_replace(folder, rf"(^|/)({K.MARKDOWN_DIR}|{K.LIGHTWEIGHT_DIR})$", "")
    return df.select(
        "path", "name", T.file_stem("path").alias("stem"),
        F.when(folder == "", K.ROOT_FOLDER_LABEL).otherwise(folder).alias("folder"), "size", "mtime",
        T.is_consolidated("path").alias("is_consolidated"), T.is_lightweight("path").alias("is_lightweight"))


def pdf_inventory(spark: SparkSession, root: str, page_counts: DataFrame | None = None, nested: bool = False) -> DataFrame:
    """PDF files of the root and its first-level folders, with whether each is converted.

    ``nested`` takes every PDF outside Markdown folders instead, as a conversion run does. Page
    counts are supplied by the caller as ``path, total_pages``.
    """
    base = os.path.abspath(urlparse(root).path)
    found = listed(spark, root, "*.pdf", "*.md").select("path", "size", "mtime")
    df = found.filter(F.col("path").endswith(".pdf")).withColumn("_in", F.split(F.substring("path", F.lit(len(base) + 2), F.length("path")), "/"))
    if nested:
        df = df.filter(~F.array_contains("_in", K.MARKDOWN_DIR))
    else:
        first = F.col("_in")[0]
        hidden = first.startswith(".") | first.isin(K.MARKDOWN_DIR, K.CONSOLIDATED_DIR, K.LIGHTWEIGHT_DIR)
        df = df.filter((F.size("_in") == 1) | ((F.size("_in") == 2) & ~hidden))
    folder = F.when(F.size("_in") == 1, F.lit(K.ROOT_FOLDER_LABEL)).otherwise(F.element_at("_in", -2))
    pdfs = df.select("path", T.file_name("path").alias("name"), folder.alias("folder"), "size", "mtime",
                     T.markdown_path_of("path").alias("output_path"))
    outputs = found.filter(F.col("path").endswith(".md")).select(F.col("path").alias("output_path"), F.col("size").alias("output_size"))
    out = pdfs.join(outputs, "output_path", "left").withColumn("is_converted", F.col("output_size").isNotNull())
    return out if page_counts is None else out.join(page_counts, "path", "left")


# --- page cache ------------------------------------------------------------------------------------------
def read_page_files(spark: SparkSession, cache_root: str, tag: str = K.PROVENANCE_TAG) -> DataFrame:
    """A file cache: ``models/<model>/<folder>/<stem>/page_NNN.md``, or the older layout without a model."""
    parts = T.path_parts("_path")
    model = F.when(F.try_element_at(parts, F.lit(-5)) == "models", F.element_at(parts, -4))
    fields = T.provenance("value", tag)
    df = read_whole(spark, cache_root, "page_*.md").select("value", F.col("path").alias("_path"))
    return df.select(
        model.alias("model"), F.element_at(parts, -3).alias("folder"), F.element_at(parts, -2).alias("stem"),
        F.regexp_extract("_path", r"page_([0-9]+)\.md$", 1).try_cast("bigint").alias("page_num"),
        T.strip_provenance("value", tag).alias("text"),
        F.try_to_timestamp(F.try_element_at(fields, F.lit("converted"))).alias("converted"),
        F.try_element_at(fields, F.lit("prompt")).alias("prompt")).filter(
            F.col("page_num").isNotNull() & ~T.is_blank("text"))


def read_page_cache(spark: SparkSession, path: str) -> DataFrame:
    """The columnar page cache; a filter on ``model`` prunes its partitions."""
    return spark.read.parquet(path)


def write_page_cache(df: DataFrame, path: str, mode: str = "append", tag: str = K.PROVENANCE_TAG) -> None:
    """Store converted pages by model. Blank pages are no conversions and are left out; an older
    stamp is removed, its facts live in columns."""
    kept = df.filter(~F.coalesce(T.is_blank("text"), F.lit(True))).withColumn("text", T.strip_provenance("text", tag))
    kept.write.mode(mode).partitionBy("model").parquet(path)


# --- batch lines -----------------------------------------------------------------------------------------
def write_batch_requests(requests: DataFrame, lines_path: str, mapping_path: str) -> None:
    """One JSON line per page, and the key-to-page mapping beside it."""
    requests.select("line").write.text(lines_path)
    requests.drop("line", *[c for c in ("image",) if c in requests.columns]).write.parquet(mapping_path)


def read_batch_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response lines; a line that is no JSON has a NULL key. ``seq`` grows with the place of a line in
    its file, and with the time of the file."""
    lines = spark.read.schema(RESPONSE_SCHEMA).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(path)
    file = F.col("_metadata")
    return lines.withColumn("seq", F.struct(
        file["file_modification_time"].alias("modified"), file["file_path"].alias("path"), file["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("line")))


# --- results ---------------------------------------------------------------------------------------------
def lightweight_path(doc) -> Column:
    """Sibling ``Lightweight`` folder of the transcript."""
    name = T.file_name(doc)
    folder = F.regexp_replace(F.col(doc), r"/[^/]*$", "")
    return F.concat(F.regexp_replace(folder, rf"/{K.MARKDOWN_DIR}$", ""), F.lit(f"/{K.LIGHTWEIGHT_DIR}/"), name)


def write_lightweight(results: DataFrame, root: str, mode: str = "algorithmic") -> DataFrame:
    """Write each lightweight text (``doc`` a path, ``content``) to its own file in the ``Lightweight`` folder beside the
    transcript, paths being relative to the workspace ``root`` or below it; a dry run stores nothing."""
    base = os.path.abspath(urlparse(root).path) + "/"
    out = results.withColumn("output", lightweight_path("doc"))
    if mode != "dry-run":
        inside = F.when(F.col("output").startswith(base), F.substring("output", F.lit(len(base) + 1), F.length("output"))).otherwise(F.col("output"))
        write_documents(out, root, inside, F.col("content"))
    return out.withColumn("written", F.lit(mode != "dry-run"))


def write_consolidated(parts: DataFrame, path: str) -> None:
    """Write combined parts in order: the files, read in name order, are the combined document.

    Parts are range-sorted, so writing is parallel; the very last part loses its final line break
    because every part is written with one.
    """
    last = parts.agg(F.max(F.struct(*PART_ORDER)).alias("m")).scalar()
    ended = F.when(F.struct(*PART_ORDER) == last, F.regexp_replace("text", r"\s+\z", "")).otherwise(F.col("text"))
    parts.withColumn("text", ended).orderBy(*PART_ORDER).select("text").write.mode("overwrite").text(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Report tables inside the lightweight area, which transcript readers leave out."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{K.LIGHTWEIGHT_DIR}/_report/{name}")


# --- rate cards and plans -----------------------------------------------------------------------------------
def read_rate_card(spark: SparkSession, path: str) -> DataFrame:
    """Saved rates, in the form with a sync time or the older bare map; a missing time is the file's own."""
    raw = spark.read.text(path, wholetext=True)
    rate = "struct<" + ", ".join(f"{f}: double" for f in RATE_FIELDS) + ">"
    parsed = raw.select(
        F.from_json("value", f"struct<synced_at: string, models: map<string, {rate}>>").alias("new"),
        F.from_json("value", "map<string, string>").alias("old"), F.col("_metadata.file_modification_time").alias("mtime"))
    bare = F.map_filter(F.transform_values("old", lambda k, v: F.from_json(v, rate)), lambda k, v: v["input_standard"].isNotNull())
    models = F.coalesce("new.models", bare)
    rows = parsed.select(
        F.explode(models).alias("model_id", "r"), F.coalesce(F.try_to_timestamp("new.synced_at"), "mtime").alias("synced_at"))
    return rows.filter(F.col("r.input_standard").isNotNull()).select("model_id", *[F.col("r")[f].alias(f) for f in RATE_FIELDS], "synced_at")


PLAN_SCHEMA = (
    "id string, created_at double, root string, model string, preset string, skip_cached boolean, "
    "max_enqueued_tokens bigint, groups array<struct<name: string, folder: string, files: array<string>, pages: bigint, "
    "state: string, job_id: string, error: string, retry_pass: int>>, _corrupt_record string")


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """Stored plans, newest first; unreadable files are skipped."""
    raw = read_whole(spark, path, "*").select(F.from_json("value", PLAN_SCHEMA, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("p")).select("p.*")
    return raw.filter(F.col("id").isNotNull()).drop("_corrupt_record").orderBy(F.desc("id"))


def plan_groups(plans: DataFrame) -> DataFrame:
    """One row per group of each plan, in plan order."""
    rows = plans.select(F.col("id").alias("plan_id"), "model", F.posexplode("groups").alias("pos", "g"))
    return rows.select("plan_id", "model", "pos", F.col("g.name").alias("group"), "g.folder", "g.files", "g.pages",
                       "g.state", "g.job_id", "g.error", F.coalesce("g.retry_pass", F.lit(0)).alias("retry_pass"))


def write_plans(plans: DataFrame, path: str) -> None:
    """One JSON file per plan, named by its id."""
    write_documents(plans, path, F.concat("id", F.lit(".json")), F.to_json(F.struct(*plans.columns)))


def latest_plan_id(plans: DataFrame) -> DataFrame:
    return plans.agg(F.max("id").alias("id"))
