"""The conversion ledger: which pages exist, which model converted them, what is missing.

``plan`` rows are ``doc, total_pages``; ``cache`` rows are ``model, doc, page_num, text[, prompt]``
with ``model`` NULL where nobody knows which model wrote the page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from folioflow import constants as K
from folioflow.functions import text as T
from folioflow.plans.storage import materialise, stored_whole
from folioflow.operators.ordering import number_within, running_max, scan_in_order
from folioflow.operators.pages import assemble

RESPONSE_SCHEMA = (
    "key string, response struct<candidates: array<struct<finishReason: string, "
    "content: struct<parts: array<struct<text: string>>>>>>, _corrupt_record string")


def planned_pages(plan: DataFrame) -> DataFrame:
    """Every page a plan covers: 1..total_pages of each document."""
    numbers = F.sequence(F.lit(1).cast("bigint"), F.col("total_pages").cast("bigint"))
    return plan.filter(F.col("total_pages") > 0).withColumn("page_num", F.explode(numbers))


def cached_pages(cache: DataFrame, model: str | None) -> DataFrame:
    """Pages holding text for a model, or of unknown origin for None; a blank page is a hole."""
    origin = F.col("model").isNull() if model is None else F.col("model") == model
    held = cache.filter(origin)
    if "text" in cache.columns:
        held = held.filter(~T.is_blank("text"))
    return held.select("doc", "page_num").distinct()


def missing_pages(plan: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    return planned_pages(plan).join(cached_pages(cache, model), ["doc", "page_num"], "left_anti")


def legacy_only(plan: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Missing pages of which a copy of unknown origin exists."""
    return missing_pages(plan, cache, model).join(cached_pages(cache, None), ["doc", "page_num"], "left_semi")


def document_coverage(plan: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Per document: pages held for the model and pages held only with unknown origin.

    Both are counted from the cache side, one aggregated pass; pages outside 1..total_pages do not
    count.
    """
    usable = cache if "text" not in cache.columns else cache.filter(~T.is_blank("text"))
    by_page = usable.filter(F.col("model").isNull() | (F.col("model") == model)).groupBy("doc", "page_num").agg(
        F.max(F.when(F.col("model") == model, 1).otherwise(0)).alias("mine"))
    inside = by_page.join(plan.select("doc", "total_pages"), "doc").filter(
        (F.col("page_num") >= 1) & (F.col("page_num") <= F.col("total_pages")))
    counts = inside.groupBy("doc").agg(
        F.sum("mine").alias("cached_pages"), F.sum(1 - F.col("mine")).alias("legacy_pages"))
    return plan.join(counts, "doc", "left").fillna(0, ["cached_pages", "legacy_pages"])


def payload_estimate(plan: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Estimated request size per job (or in all) and whether it may be sent."""
    pages = F.coalesce(F.sum("total_pages"), F.lit(0)).cast("bigint")
    sums = (plan.groupBy(*keys) if keys else plan).agg(pages.alias("pages"))
    size = F.col("pages") * K.BYTES_PER_PAGE
    return sums.select(
        "*", size.alias("estimated_bytes"), (size <= K.MAX_BATCH_BYTES).alias("fits"),
        F.lit(K.MAX_PAGES_PER_JOB).cast("bigint").alias("max_pages_per_job"))


# --- batch requests and responses -----------------------------------------------------------------------
def batch_requests(pages: DataFrame, prompt: str) -> DataFrame:
    """Request lines for pages ``doc, doc_index, page_num[, image]`` with their mapping columns.

    The key is the document's index and the page number, each of at least three digits.
    """
    key = F.format_string("doc%03d_p%03d", F.col("doc_index"), F.col("page_num"))
    image = F.base64("image") if "image" in pages.columns else F.lit("")
    inline = F.struct(F.struct(F.lit("image/png").alias("mime_type"), image.alias("data")).alias("inline_data"),
                      F.lit(None).cast("string").alias("text"))
    text = F.struct(F.lit(None).cast("struct<mime_type:string,data:string>").alias("inline_data"), F.lit(prompt).alias("text"))
    request = F.struct(F.array(F.struct(F.array(inline, text).alias("parts"))).alias("contents"))
    keyed = pages.withColumn("key", key)
    return keyed.withColumn("line", F.to_json(F.struct("key", request.alias("request"))))


def response_pages(responses: DataFrame, mapping: DataFrame) -> DataFrame:
    """Responses matched to their pages: trimmed text of the first candidate and its finish reason.

    Unreadable lines and keys nobody asked for are dropped.
    """
    first = F.get(F.col("response.candidates"), F.lit(0))
    parts = F.coalesce(first["content"]["parts"], F.array())
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    delivery = [F.col("seq")] if "seq" in responses.columns else []
    read = responses.filter(F.col("key").isNotNull()).select(
        "key", T.strip(joined).alias("text"), first["finishReason"].alias("finish_reason"), *delivery)
    return mapping.join(read, "key")


def collect_results(responses: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pages that came back with text, one row each: the last delivery by ``seq``.

    Without that column, or where it ties, the larger text counts, so the answer never depends on the run.
    """
    pages = response_pages(responses, mapping).filter(F.col("text") != "")
    last = F.struct(*([F.col("seq")] if "seq" in pages.columns else []), F.col("text"))
    others = [c for c in pages.columns if c not in ("doc", "page_num", "seq")]
    newest = pages.groupBy("doc", "page_num").agg(F.max_by(F.struct(*others), last).alias("_p"))
    return newest.select("doc", "page_num", *[F.col("_p")[c].alias(c) for c in others])


def newest_pages(cache: DataFrame) -> DataFrame:
    """One row per model and page of a cache that is appended to: the last ``converted``, then the larger text."""
    last = F.struct(*([F.col("converted")] if "converted" in cache.columns else []), F.col("text"))
    return cache.groupBy("model", "doc", "page_num").agg(F.max_by("text", last).alias("text"))


def blocked_pages(responses: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pages that came back empty, with the reason."""
    empty = response_pages(responses, mapping).filter(F.col("text") == "")
    return empty.select("doc", "page_num", F.coalesce("finish_reason", F.lit("EMPTY_RESPONSE")).alias("reason"))


def blocked_reasons(blocked: DataFrame) -> DataFrame:
    return blocked.groupBy("reason").agg(F.count(F.lit(1)).alias("pages"))


def fill_pages(docs: DataFrame, results: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Each page of the selected documents: the fresh result, else the cached text, else a notice."""
    on = ["doc", "page_num"]
    fresh = results.select(*on, F.col("text").alias("_fresh"))
    held = newest_pages(cache.filter(F.col("model") == model)).select(*on, F.col("text").alias("_held"))
    notice = F.concat(F.lit("> **[Page "), F.col("page_num").cast("string"), F.lit(" conversion missing]**"))
    pages = planned_pages(docs.select("doc", "total_pages")).join(fresh, on, "left").join(held, on, "left")
    origin = F.when(F.col("_fresh").isNotNull(), "batch").when(F.col("_held").isNotNull(), "cache").otherwise("missing")
    return pages.select(*on, F.coalesce("_fresh", "_held", notice).alias("text"), origin.alias("origin"))


def assemble_with_fallback(docs: DataFrame, results: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Document parts for every selected document, also those without any request."""
    return assemble(docs, fill_pages(docs, results, cache, model))


# --- jobs ----------------------------------------------------------------------------------------------
def recover_jobs(lost: DataFrame, remote: DataFrame, jobs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Find the remote batch of each lost job, every batch for one job only.

    Jobs of a display name choose in the order of submission (unknown times first, then by id): each takes
    the earliest unclaimed batch of that name created no more than two minutes before it was
    submitted. Batches without a time count as the earliest and fit every job.

    ``lost`` is ``job_id, display_name[, submitted_at]``, ``remote`` is ``name, display_name,
    create_time``, ``jobs`` has the claimed ``remote_name``, ``mappings`` the known ``job_id``.

    The walk has a closed form: if p batches precede job number i in time, job j takes batch number
    j + max(p - i) over the jobs up to it, a running maximum over the ordered timeline.
    """
    submitted = F.col("submitted_at") if "submitted_at" in lost.columns else T.job_submitted_at("job_id")
    wanted = lost.select(F.col("job_id").cast("string").alias("job_id"), "display_name", submitted.alias("submitted_at")).join(
        mappings.select(F.col("job_id").cast("string").alias("job_id")).distinct(), "job_id", "left_semi")
    claimed = jobs.select(F.col("remote_name").alias("name")).filter("name is not null").distinct()
    free = remote.select("name", "display_name", "create_time").join(claimed, "name", "left_anti")
    free = free.withColumn("name", F.col("name").cast("string"))

    start = F.timestamp_seconds(F.lit(0))
    floor = F.coalesce(F.col("submitted_at") - F.make_dt_interval(secs=F.lit(float(K.RECOVERY_SKEW_SECONDS))), start)
    numbered = number_within(wanted.select("job_id", "display_name", floor.alias("at")), "display_name", [F.col("at"), F.col("job_id")])
    undated = number_within(free.filter("create_time is null"), "display_name", [F.col("name")]).drop("create_time")
    first = materialise(numbered.join(undated, ["display_name", "number"], "left"), "undated")

    columns = ["display_name", "at", "is_batch", "id"]
    timeline = first.filter("name is null").select("display_name", "at", F.lit(0).alias("is_batch"), F.col("job_id").alias("id"))
    timeline = timeline.unionByName(free.filter("create_time is not null").select(
        "display_name", F.col("create_time").alias("at"), F.lit(1).alias("is_batch"), F.col("name").alias("id")))
    order = [F.col(c) for c in columns]
    counted = scan_in_order(timeline, order, position=None, sums={"batches": F.col("is_batch"), "waiting": 1 - F.col("is_batch")})
    lead = F.when(F.col("is_batch") == 0, F.col("batches") - F.col("waiting") + 1)
    walked = materialise(running_max(counted, order, {"best": F.struct(F.col("display_name").alias("n"), F.coalesce(lead, F.lit(-(2**62))).alias("v"))}), "walk")
    takes = walked.filter("is_batch = 0").select(
        F.col("id").alias("job_id"), "display_name", (F.col("waiting") - 1 + F.col("best.v")).alias("number"))
    batches = walked.filter("is_batch = 1").select(
        F.col("id").alias("name"), "display_name", F.col("at").alias("create_time"), (F.col("batches") - 1).alias("number"))
    timed = takes.join(batches, ["display_name", "number"]).select("job_id", "display_name", "name", "create_time")
    outright = first.filter("name is not null").select("job_id", "display_name", "name", F.lit(None).cast("timestamp").alias("create_time"))
    return timed.unionByName(outright)


def job_state(events: DataFrame) -> DataFrame:
    """Status of each job from ``job_id, status, ts, seq``: its first terminal status, else the latest.

    Both are plain minimum and maximum aggregates, so any split of the events gives the same answer.
    """
    terminal = F.col("status").isin(K.JOB_STATES_TERMINAL)
    stamp = F.struct("ts", "seq", "status")
    found = events.groupBy("job_id").agg(
        F.min(F.when(terminal, stamp)).alias("ended"), F.max(F.when(~terminal, stamp)).alias("latest"))
    return resolve_job_state(found)


def resolve_job_state(found: DataFrame) -> DataFrame:
    final = F.coalesce("ended", "latest")
    return found.select(
        "job_id", final["status"].alias("status"), F.col("ended").isNotNull().alias("is_completed"),
        F.when(F.col("ended")["status"] == K.JOB_STATES_TERMINAL[0], F.col("ended")["ts"]).alias("completed_at"))


def progress(events: DataFrame, now: Column) -> DataFrame:
    """Latest page and percentage per file, and whether its last heartbeat is recent.

    ``events`` is ``file, ts, seq, current_page, total_pages``.
    """
    last = events.groupBy("file").agg(
        F.max_by(F.struct("current_page", "total_pages", "ts"), F.struct("ts", "seq")).alias("l"))
    percent = F.when(F.col("l.total_pages") > 0, T.rounded(F.col("l.current_page") / F.col("l.total_pages") * 100, 1)).otherwise(0.0)
    alive = F.unix_micros(now) - F.unix_micros("l.ts") < K.HEARTBEAT_SECONDS * 1_000_000
    return last.select(
        "file", F.col("l.current_page").alias("current_page"), F.col("l.total_pages").alias("total_pages"),
        percent.alias("percent"), alive.alias("alive"))


def recent_log(events: DataFrame, lines: int = K.PROGRESS_LOG_LINES) -> DataFrame:
    """The newest log lines."""
    return events.orderBy(F.desc("ts"), F.desc("seq")).limit(lines)


# --- conversion with a caller's transcriber ----------------------------------------------------------------
def convert_missing(
    pages: DataFrame, transcribe: Callable[[pd.DataFrame, str], pd.Series], model: str, retry_pass: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Run a transcriber over missing pages in Arrow batches.

    ``transcribe(batch, prompt_id)`` returns one text per page, empty where it was refused. Returns
    the converted pages, ready for the page cache, and the refused pages for the next pass.
    """
    prompt_id = [K.PRESET_PROMPT, *K.RETRY_PROMPTS][retry_pass]
    schema = TY.StructType([*pages.schema.fields, TY.StructField("text", TY.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=transcribe(batch, prompt_id))

    done = pages.mapInPandas(run, schema)
    held = ~F.coalesce(T.is_blank("text"), F.lit(True))
    prompt = F.lit(None if prompt_id == K.PRESET_PROMPT else prompt_id).cast("string")
    converted = done.filter(held).withColumns({"model": F.lit(model), "prompt": prompt})
    return converted, done.filter(~held).drop("text")


def convert_in_passes(
    pages: DataFrame, transcribe: Callable[[pd.DataFrame, str], pd.Series], model: str, path: str, passes: int = K.MAX_RETRY_PASSES + 1
) -> tuple[DataFrame, DataFrame]:
    """Run the ladder of prompts over ``pages`` (``doc, page_num, ...``): what one prompt is refused, the next one is asked.

    Each pass is stored below ``path`` before the next begins. A pass that is complete is not run again, so a run stopped
    at any point goes on where it was; a pass cut off half-way is written anew. Returns all converted pages, with the prompt
    and pass that got them, and the pages refused by every prompt.
    """
    spark, open_pages, done = pages.sparkSession, pages, []
    for number in range(min(passes, K.MAX_RETRY_PASSES + 1)):
        place = f"{path.rstrip('/')}/pass={number}"
        if not stored_whole(spark, place):
            converted, refused = convert_missing(open_pages, transcribe, model, number)
            both = converted.withColumn("held", F.lit(True)).unionByName(refused.withColumn("held", F.lit(False)), allowMissingColumns=True)
            both.write.mode("overwrite").parquet(place)
        stored = spark.read.parquet(place)
        done.append(stored.filter("held").drop("held").withColumn("retry_pass", F.lit(number)))
        open_pages = stored.filter("NOT held").select(*pages.columns)
        if open_pages.isEmpty():
            break
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out, open_pages
