"""Token and cost estimates, rate cards, savings and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.text import budget_tokens, let, rounded, strip

RATE_FIELDS = ["input_standard", "output_standard", "input_batch", "output_batch", "context_cache"]
RATE_SCHEMA = "model_id string, " + ", ".join(f"{f} double" for f in RATE_FIELDS)


def base_rate_card(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in K.BASE_RATES], RATE_SCHEMA)


def merge_rates(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Known models with the newer rates where there are any; unknown models are not added."""
    newer = updates.select("model_id", *[F.col(f).alias(f"_{f}") for f in RATE_FIELDS])
    return base.join(newer, "model_id", "left").select(
        "model_id", *[F.coalesce(f"_{f}", f).alias(f) for f in RATE_FIELDS])


def with_rates(df: DataFrame, rate_card: DataFrame, default: str = K.DEFAULT_MODEL, model: str = "model") -> DataFrame:
    """Rates of each row's model, those of the default model where it is not on the card."""
    fallback = rate_card.filter(F.col("model_id") == default)
    joined = df.join(rate_card.withColumnRenamed("model_id", model), model, "left")
    return joined.select(*df.columns, *[
        F.coalesce(F.col(f), fallback.select(f).scalar()).alias(f) for f in RATE_FIELDS])


def cost_columns(pages: Column, input_standard, output_standard, input_batch, output_batch) -> dict[str, Column]:
    """Tokens and costs of a number of pages.

    Money is rounded half up to six decimals; the noise of binary fractions is cut off before, so
    that exact halves always go up.
    """
    tin, tout = pages * K.INPUT_TOKENS_PER_PAGE, pages * K.OUTPUT_TOKENS_PER_PAGE
    price = lambda i, o: F.round(F.round(tin / 1_000_000 * i + tout / 1_000_000 * o, 10), 6)
    return {
        "input_tokens": tin.cast("bigint"), "output_tokens": tout.cast("bigint"), "total_tokens": (tin + tout).cast("bigint"),
        "cost_standard_usd": price(input_standard, output_standard), "cost_batch_usd": price(input_batch, output_batch)}


def cost_estimate(df: DataFrame, pages: str = "pages") -> DataFrame:
    """Estimate per row of a table that carries rates."""
    return df.withColumns(cost_columns(F.col(pages), *[F.col(f) for f in RATE_FIELDS[:4]]))


def aggregate_cost(df: DataFrame, rate_card: DataFrame, keys: list[str], model: str = "model", pages: str = "pages") -> DataFrame:
    """Pages are summed first, then priced."""
    sums = df.groupBy(*keys, model).agg(F.sum(pages).cast("bigint").alias("pages"))
    return cost_estimate(with_rates(sums, rate_card, model=model))


# --- savings and budgets -------------------------------------------------------------------------------
def projected_saving(candidates: DataFrame) -> DataFrame:
    """Measured saving over files that have a lightweight copy, a fixed guess while none has."""
    measured = candidates.filter(F.col("deflated_size").isNotNull() & (F.col("size") > 0))
    sums = measured.agg(F.sum("size").alias("o"), F.sum("deflated_size").alias("l"))
    rate = F.greatest(F.lit(0.0), 1 - F.col("l") / F.col("o"))
    return sums.select(F.coalesce(rate, F.lit(K.DEFAULT_SAVING_RATE)).alias("rate"))


def budget_fit(selection: DataFrame, budget: int = K.DEFAULT_CONTEXT_BUDGET, rate: Column | None = None) -> DataFrame:
    """How a selection of files fits a token budget before and after deflation."""
    rate = projected_saving(selection).scalar() if rate is None else rate
    known = F.col("deflated_size")
    sums = selection.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("original"),
        F.coalesce(F.sum(known), F.lit(0)).alias("measured"),
        F.coalesce(F.sum(F.when(known.isNull(), F.col("size"))), F.lit(0)).alias("open"))
    light = F.col("measured") + F.col("open") * (1 - rate)
    tokens = sums.select("files", budget_tokens("original").alias("original_tokens"), budget_tokens(light).alias("light_tokens"))
    share = rounded(F.col("light_tokens") / F.lit(budget) * 100, 1)
    fits = F.col("light_tokens") <= budget
    room = F.when(fits, F.col("files")).otherwise(F.floor(F.lit(budget) / F.col("light_tokens") * F.col("files")))
    return tokens.select(
        "*", share.alias("percent"), fits.alias("fits"), F.abs(F.lit(budget) - F.col("light_tokens")).alias("difference"),
        room.cast("bigint").alias("filings_that_fit"))


# --- rate card documents ---------------------------------------------------------------------------------
_INPUT_ROW = r"(?iU)\|\s*Input price[^|]*\|\s*[^|]+\|\s*\$?([0-9\.]+)"
_OUTPUT_ROW = r"(?iU)\|\s*Output price[^|]*\|\s*[^|]+\|\s*\$?([0-9\.]+)"
_CACHE_ROW = r"(?iU)\|\s*Context caching price[^|]*\|\s*[^|]+\|\s*\$?([0-9\.]+)"


def extract_rate_cards(docs: DataFrame, text: str = "text") -> DataFrame:
    """Model rates found in pricing documents: one row per model section with both standard rates.

    Absent batch rates are half the standard ones, an absent cache rate a tenth of the input rate.
    """
    keys = [c for c in docs.columns if c != text]
    sections = docs.select(*keys, F.explode(F.split(F.col(text), r"(?U)\n##\s+", -1)).alias("_s"))
    table = lambda title: F.regexp_extract(
        "_s", rf"(?U)###\s+{title}\s+([\s\S]*?)(?=###|\n##|\n?\z)", 1)
    parsed = sections.select(
        *keys, "_s", F.regexp_extract("_s", r"(?md)^\*`([^`]+)`", 1).alias("_id"),
        table("Standard").alias("_std"), table("Batch").alias("_bat"))
    number = lambda c, pattern: F.regexp_extract(c, pattern, 1).try_cast("double")
    rated = parsed.filter(F.col("_id") != "").select(
        *keys, strip("_id").alias("model_id"), strip(F.split(strip("_s"), "\n")[0]).alias("name"),
        number("_std", _INPUT_ROW).alias("i"), number("_std", _OUTPUT_ROW).alias("o"), number("_std", _CACHE_ROW).alias("c"),
        number("_bat", _INPUT_ROW).alias("bi"), number("_bat", _OUTPUT_ROW).alias("bo"),
        _description(F.col("_s")).alias("description"))
    return rated.filter(F.col("i").isNotNull() & F.col("o").isNotNull()).select(
        *keys, "model_id", "name", F.col("i").alias("input_standard"), F.col("o").alias("output_standard"),
        F.coalesce("bi", F.round(F.col("i") * 0.5, 4)).alias("input_batch"),
        F.coalesce("bo", F.round(F.col("o") * 0.5, 4)).alias("output_batch"),
        F.coalesce("c", F.round(F.col("i") * 0.1, 4)).alias("context_cache"), "description")


def _description(section: Column) -> Column:
    """Text lines between the model's title and its first table or sub-heading."""

    def read(lines: Column) -> Column:
        ends = F.array_position(F.transform(lines, lambda l: l.startswith("###") | l.startswith("|")), True)
        upto = F.when(ends > 0, ends.cast("int") - 1).otherwise(F.size(lines))
        kept = F.filter(F.slice(lines, 1, upto), lambda l: (l != "") & ~l.startswith("[Try it") & ~l.startswith("*`"))
        return F.array_join(kept, " ")

    rows = F.split(strip(section), "\n", -1)
    body = let(rows, lambda r: F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), strip))
    return let(body, read)


def rate_freshness(synced_at: Column, now: Column) -> Column:
    """When rates were last synced, in words, and whether that is too long ago."""
    seconds = F.round((F.unix_micros(now) - F.unix_micros(synced_at)) / 1_000_000)

    def phrase(s: Column) -> Column:
        minutes, hours, days = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
        ago = lambda n, unit: F.concat(
            n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))
        when = F.when(s.isNull(), "never").when(s < 60, "just now").when(minutes < 60, ago(minutes, "minute")).when(
            hours < 24, ago(hours, "hour")).otherwise(ago(days, "day"))
        return F.struct(when.alias("synced"), (s.isNull() | (days >= K.STALE_AFTER_DAYS)).alias("stale"))

    return let(seconds, phrase)
