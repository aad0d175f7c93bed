"""The driver's tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import constants as K

MODEL = "transcriber"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_zone(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def with_zone(df: DataFrame) -> DataFrame:
    """Timestamps without a zone are read in the session's."""
    bare = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in bare}) if bare else df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a source that has fewer splits than there are cores; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as filings of the company that is their source."""
    d = table(spark, sf_dir, "documents")
    return spread(d.select(
        F.col("doc_id").alias("doc"), F.col("doc_id").alias("visit"), F.col("source").alias("entity"),
        F.concat(F.lit("filing-"), F.col("doc_id").cast("string")).alias("name"), "text"))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format family of each company: its number modulo four."""
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("entity")).distinct()
    number = F.regexp_extract("entity", r"([0-9]+)$", 1).cast("int")
    return sources.select("entity", F.concat(F.lit("F"), (number % 4).cast("string")).alias("grp"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"))


def library_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with titles and folders, for search and consolidation."""
    d = table(spark, sf_dir, "documents")
    year = (F.lit(1990) + F.col("n_chars") % 35).cast("string")
    title = F.concat(F.col("source"), F.lit(" Annual Report "), year, F.lit(" ("), F.col("lang"), F.lit(") No "), F.col("doc_id").cast("string"))
    return spread(d.select(
        F.col("doc_id").alias("doc"), F.col("doc_id").alias("pos"), title.alias("title"), F.col("source").alias("folder"),
        F.concat(title, F.lit(".md")).alias("file_name"), F.concat(title, F.lit(".pdf")).alias("name"), "text"))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose turns are pages."""
    c = table(spark, sf_dir, "conversations")
    return spread(c.select(
        F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page_num"), "role", "text"))


def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    sized = c.groupBy(F.col("conv_id").alias("doc")).agg((F.max("turn") + 1).alias("total_pages"))
    stem = F.concat(F.lit("Conversation "), F.col("doc").cast("string"))
    return sized.select(
        "doc", stem.alias("stem"), F.concat(stem, F.lit(".pdf")).alias("source_name"), F.lit(MODEL).alias("model_name"), "total_pages")


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of orders as pages; a line with status F is held by the model named by its flag."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag")
    return lines.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("bigint").alias("page_num"),
        F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"))


def page_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages held: shipped lines by their model, the others of unknown origin where flagged N."""
    pages = order_pages(spark, sf_dir)
    held = pages.filter((F.col("status") == "F") | (F.col("flag") == "N"))
    return held.select("doc", "page_num", F.when(F.col("status") == "F", F.col("flag")).alias("model"))


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of the folder that is the customer's nation."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    sized = order_pages(spark, sf_dir).groupBy("doc").agg(F.max("page_num").alias("total_pages"))
    placed = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return placed.join(sized, placed.o_orderkey == sized.doc, "left").select(
        F.col("o_orderkey").alias("doc"), F.col("n_name").alias("folder"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.coalesce("total_pages", F.lit(0)).cast("bigint").alias("total_pages"))


JOB_STATUS = {
    "signup": "JOB_STATE_PENDING", "view": "JOB_STATE_RUNNING", "click": "JOB_STATE_RUNNING",
    "purchase": "JOB_STATE_SUCCEEDED", "error": "JOB_STATE_FAILED"}
GROUP_EVENT = {
    "signup": "submit", "click": "refused", "purchase": "collected", "error": "job_failed", "view": "reopen_failed"}


def _renamed(column: str, names: dict[str, str]):
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def job_events(events: DataFrame) -> DataFrame:
    """Events as status reports of the job that is the user."""
    return events.select(
        F.col("user_id").alias("job_id"), _renamed("event_type", JOB_STATUS).alias("status"), "ts", F.col("event_id").alias("seq"))


def group_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("group"), _renamed("event_type", GROUP_EVENT).alias("event"), "ts", "event_id")


STATE_OF_ORDER = {"F": "collected", "O": "submitted", "P": "pending"}


def order_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as groups of the plan that is their priority; every second retry pass is used up."""
    pages = order_pages(spark, sf_dir).groupBy("doc", "page_num").agg(F.max((F.col("status") == "F").cast("int")).alias("held"))
    sums = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.sum("held").alias("converted"))
    o = table(spark, sf_dir, "orders")
    joined = o.join(sums, o.o_orderkey == sums.doc)
    return joined.select(
        F.col("o_orderpriority").alias("plan_id"), F.col("o_orderkey").alias("group_no"),
        F.concat(F.lit("group "), F.col("o_orderkey").cast("string")).alias("group"),
        _renamed("o_orderstatus", STATE_OF_ORDER).alias("state"), "pages", "converted",
        (F.col("pages") - F.col("converted")).alias("missing"), F.pmod("o_custkey", F.lit(6)).cast("int").alias("retry_pass"),
        F.concat(F.lit("job "), F.col("o_custkey").cast("string")).alias("job_id"))


def lightweight_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their size and, where they are labelled, the size of a stripped copy."""
    from folioflow.functions import text as T

    d = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("done")), "doc_id", "left")
    return spread(d).select(
        F.col("doc_id").alias("doc"), T.octets("text").alias("size"),
        F.when(F.col("done"), T.octets(T.strip_scaffolding("text"))).alias("deflated_size"))
