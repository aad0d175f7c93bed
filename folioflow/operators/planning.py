"""Batch plans: cutting folders into jobs, admitting jobs under a budget, following their states."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions import text as T
from folioflow.operators.cost import cost_columns
from folioflow.operators.ledger import document_coverage
from folioflow.operators.ordering import scan_in_order
from folioflow.plans.storage import materialise

BLOCK_PAGES = 250_000
FOLD_BLOCK = 4096
FAN = 64  # summaries composed or chained in one group


# --- cutting folders -------------------------------------------------------------------------------------
def _fill(state: np.ndarray, pages: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Put one document into the open job. State is the job's pages, -1 for no open job; anything
    above the limit counts as limit + 1. Returns the new state and where a new job was opened."""
    opened = (state >= 0) & (state + pages > limit)
    return np.minimum(np.where(opened, 0, np.maximum(state, 0)) + pages, limit + 1), opened


def _block_effect(frame: pd.DataFrame, limit: int) -> pd.DataFrame:
    """What a block of documents does to every state the open job may be in when it starts."""
    state = np.arange(-1, limit + 2)
    which = np.arange(len(state))
    base, cuts = np.zeros(len(state), dtype=np.int64), np.zeros(len(state), dtype=np.int64)
    for i, pages in enumerate(frame.sort_values("position")["pages"].to_numpy()):
        state, opened = _fill(state, int(pages), limit)
        cuts = cuts + opened
        if i % 64 == 63 and len(state) > 1:  # states that have met stay together
            base, (state, back) = base + cuts[which], np.unique(state, return_inverse=True)
            which, cuts = back[which], np.zeros(len(state), dtype=np.int64)
    total, out = base + cuts[which], state[which]
    starts = np.flatnonzero(np.r_[True, (np.diff(out) != 0) | (np.diff(total) != 0)])
    return pd.DataFrame({
        "folder": [frame["folder"].iloc[0]], "block": [frame["block"].iloc[0]],
        "starts": [(starts - 1).tolist()], "outs": [out[starts].tolist()], "cuts": [total[starts].tolist()],
        "held": [int(frame["pages"].sum())]})


def _compose(blocks: pd.DataFrame, fan: int) -> pd.DataFrame:
    """One effect from those of neighbouring blocks, applied one after another; it has no more steps than the first."""
    blocks = blocks.sort_values("block")
    first = blocks.iloc[0]
    outs, cuts = np.asarray(first["outs"]), np.asarray(first["cuts"])
    for starts, then, more in zip(blocks["starts"][1:], blocks["outs"][1:], blocks["cuts"][1:]):
        at = np.searchsorted(starts, outs, side="right") - 1
        outs, cuts = np.asarray(then)[at], cuts + np.asarray(more)[at]
    return pd.DataFrame({
        "folder": [first["folder"]], "block": [first["block"] // fan], "starts": [list(first["starts"])], "outs": [outs.tolist()],
        "cuts": [cuts.tolist()], "held": [int(blocks["held"].sum())]})


def _chain(blocks: pd.DataFrame, entry: pd.DataFrame | None = None) -> pd.DataFrame:
    """State and part with which each block starts, and the pages of the folder; ``entry`` is what the blocks above say."""
    blocks = blocks.sort_values("block")
    state, part, whole = (-1, 1, int(blocks["held"].sum())) if entry is None else (int(entry[c].iloc[0]) for c in ("state", "part", "whole"))
    starting = []
    for starts, outs, cuts in zip(blocks["starts"], blocks["outs"], blocks["cuts"]):
        starting.append((state, part))
        at = int(np.searchsorted(starts, state, side="right")) - 1
        state, part = int(outs[at]), part + int(cuts[at])
    return pd.DataFrame({
        "folder": blocks["folder"], "block": blocks["block"], "state": [e[0] for e in starting], "part": [e[1] for e in starting], "whole": whole})


def _number(docs: pd.DataFrame, entry: pd.DataFrame, limit: int) -> pd.DataFrame:
    docs = docs.sort_values("position")
    state, part, parts = int(entry["state"].iloc[0]), int(entry["part"].iloc[0]), []
    for pages in docs["pages"].tolist():
        opened = state >= 0 and state + pages > limit
        state = min((0 if opened else max(state, 0)) + pages, limit + 1)
        part += opened
        parts.append(part)
    return docs.assign(part=parts, whole=int(entry["whole"].iloc[0]))[["folder", "doc", "pages", "part", "whole"]]


def chunk_folders(inventory: DataFrame, max_pages: int = K.MAX_PAGES_PER_JOB) -> DataFrame:
    """Cut each folder's documents, in order, into jobs of at most ``max_pages`` without ever
    splitting a document. Adds ``part`` and ``group``, the job's name.

    The rule is sequential, but what a run of documents does depends only on how full the open job
    is when it starts. So blocks of bounded size are summarised in parallel for every such state, the
    summaries are composed ``FAN`` at a time, level by level, and starting states are handed back down
    the same tree. No group holds a folder, only ``FAN`` summaries or a block.
    """
    docs = inventory.select("folder", "doc", F.col("pages").cast("bigint").alias("pages"))
    weight = F.greatest(F.col("pages"), F.lit(1))
    placed = scan_in_order(docs, [F.col("folder"), F.col("doc")], "position", {"_upto": weight})
    size = max(BLOCK_PAGES, 16 * max_pages)
    blocked = materialise(placed.withColumn(
        "block", F.floor((F.col("_upto") - weight) / size).cast("bigint")).drop("_upto"), "blocks")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    effect = f"folder {kinds['folder']}, block bigint, starts array<bigint>, outs array<bigint>, cuts array<bigint>, held bigint"
    start = f"folder {kinds['folder']}, block bigint, state bigint, part bigint, whole bigint"
    levels = [blocked.groupBy("folder", "block").applyInPandas(lambda f: _block_effect(f, max_pages), effect)]
    last = blocked.agg(F.max("block")).first()[0] or 0
    fan, above = FAN, F.floor(F.col("block") / FAN).cast("bigint").alias("above")
    while last >= fan:
        levels[-1] = materialise(levels[-1], "effects")
        levels.append(levels[-1].groupBy("folder", above).applyInPandas(lambda f: _compose(f, fan), effect))
        last //= fan
    entries = levels[-1].groupBy("folder").applyInPandas(lambda b: _chain(b), start)
    for lower in reversed(levels[:-1]):
        entries = lower.groupBy("folder", above).cogroup(entries.groupBy("folder", "block")).applyInPandas(lambda b, e: _chain(b, e), start)
    numbered = blocked.groupBy("folder", "block").cogroup(entries.groupBy("folder", "block")).applyInPandas(
        lambda d, e: _number(d, e, max_pages),
        f"folder {kinds['folder']}, doc {kinds['doc']}, pages bigint, part bigint, whole bigint")
    suffix = F.when((F.col("part") > 1) | (F.col("whole") > max_pages), F.format_string(" (part %d)", "part")).otherwise("")
    return numbered.withColumn("group", F.concat("folder", suffix)).drop("whole")


def create_plan(
    inventory: DataFrame, plan_id: str, model: str = K.DEFAULT_MODEL, preset: str = "financial",
    max_tokens: int = K.MAX_ENQUEUED_TOKENS, max_pages: int = K.MAX_PAGES_PER_JOB, files: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A plan as three tables: its header, its groups in order, and the documents of each group."""
    chosen = inventory if files is None else inventory.join(files.select("doc").distinct(), "doc", "left_semi")
    members = chunk_folders(chosen, max_pages).withColumn("plan_id", F.lit(plan_id))
    groups = members.groupBy("plan_id", "group", "folder", "part").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages")).withColumns({
            "state": F.lit("pending"), "job_id": F.lit(None).cast("string"), "error": F.lit(None).cast("string"),
            "retry_pass": F.lit(0)})
    header = inventory.sparkSession.range(1).select(
        F.lit(plan_id).alias("plan_id"), F.lit(model).alias("model"), F.lit(preset).alias("preset"),
        F.lit(max_tokens).cast("bigint").alias("max_enqueued_tokens"))
    return header, groups, members


# --- admission ---------------------------------------------------------------------------------------------
def input_tokens(pages) -> Column:
    return pages * F.lit(K.INPUT_TOKENS_PER_PAGE)


def admit(
    groups: DataFrame, order: list[str], in_flight: int = 0, budget: int = K.MAX_ENQUEUED_TOKENS,
    only: str | None = None, max_new: int | None = None,
) -> DataFrame:
    """The pending groups to submit now: in plan order, stopping at the first that does not fit.

    A group whose ``missing`` is 0 is looked at in turn, with its full cost, but sends nothing and
    so uses up no budget; the column may be absent.
    """
    eligible = groups.filter(F.col("state") == "pending")
    if only:
        eligible = eligible.filter(F.lower("group").contains(only.lower()))
    sends = F.coalesce(F.col("missing") > 0, F.lit(True)) if "missing" in groups.columns else F.lit(True)
    cost = input_tokens(F.col("pages"))
    seen = scan_in_order(eligible, [F.col(c) for c in order], "turn", {
        "_spent": F.when(sends, cost).otherwise(0), "_sent": sends.cast("bigint")})
    before = F.col("_spent") - F.when(sends, cost).otherwise(0)
    stops = before + cost + F.lit(in_flight) > F.lit(budget)
    if max_new is not None:
        stops = stops | (F.col("_sent") - sends.cast("bigint") >= F.lit(max_new))
    judged = materialise(seen.withColumn("_stops", stops), "admission")
    first_stop = judged.filter("_stops").agg(F.min("turn").alias("t")).scalar()
    admitted = judged.filter(F.coalesce(F.col("turn") < first_stop, F.lit(True)))
    outcome = F.when(sends, "submitted").when(F.coalesce(F.col("retry_pass"), F.lit(0)) > 0, "collected").otherwise("complete") \
        if "retry_pass" in groups.columns else F.when(sends, "submitted").otherwise("complete")
    return admitted.withColumn("next_state", outcome).withColumn(
        "prompt_id", _prompt(F.col("retry_pass") if "retry_pass" in groups.columns else F.lit(0))).drop("_spent", "_sent", "_stops")


def _prompt(retry_pass: Column) -> Column:
    from folioflow.functions.text import retry_prompt_id

    return retry_prompt_id(retry_pass)


def enqueued_tokens(groups: DataFrame) -> DataFrame:
    """Tokens in flight over all plans, each job counted once (its last listed group)."""
    flying = groups.filter((F.col("state") == "submitted") & F.col("job_id").isNotNull())
    order = F.struct("plan_id", "group")
    per_job = flying.groupBy("job_id").agg(F.max_by("pages", order).alias("pages"))
    return per_job.agg(
        F.count(F.lit(1)).alias("jobs"), F.coalesce(F.sum(input_tokens(F.col("pages"))), F.lit(0)).cast("bigint").alias("enqueued_tokens"))


# --- coverage and summary -------------------------------------------------------------------------------------
def group_coverage(members: DataFrame, cache: DataFrame, model: str, keys: list[str]) -> DataFrame:
    """Pages of each group that hold text now, and how many are still missing.

    Counted from the cache; what a collection was once refused plays no part.
    """
    plan = members.select(*keys, "doc", F.col("pages").alias("total_pages"))
    covered = document_coverage(plan, cache, model)
    sums = covered.groupBy(*keys).agg(
        F.sum("total_pages").cast("bigint").alias("pages"), F.sum("cached_pages").cast("bigint").alias("converted"))
    return sums.withColumn("missing", F.greatest(F.col("pages") - F.col("converted"), F.lit(0)))


def plan_summary(groups: DataFrame, rates: DataFrame | None = None, key: str = "plan_id") -> DataFrame:
    """Groups and pages by state, progress, missing pages and whether the plan is finished.

    ``groups`` has ``state, pages, converted``; with ``rates`` (one row) the batch cost is estimated.
    """
    in_state = lambda s: F.col("state") == s
    by_state = [F.count(F.when(in_state(s), 1)).alias(f"{s}_groups") for s in K.GROUP_STATES]
    by_state += [F.sum(F.when(in_state(s), F.col("pages")).otherwise(0)).cast("bigint").alias(f"{s}_pages") for s in K.GROUP_STATES]
    sums = groups.groupBy(key).agg(
        F.count(F.lit(1)).alias("groups"), *by_state, F.sum("pages").cast("bigint").alias("total_pages"),
        F.sum("converted").cast("bigint").alias("converted_pages"),
        F.bool_and(F.col("state").isin(K.GROUP_STATES_FINISHED)).alias("is_finished"))
    done = F.col("collected_pages") + F.col("complete_pages")
    out = sums.withColumn("done_pages", done).withColumn(
        "percent", F.when(F.col("total_pages") > 0, T.rounded(done / F.col("total_pages") * 100, 1)).otherwise(0.0)).withColumn(
            "missing_pages", F.greatest(F.col("total_pages") - F.col("converted_pages"), F.lit(0)))
    if rates is None:
        return out
    rate = lambda c: rates.select(c).scalar()
    return out.withColumn("batch_cost_usd", cost_columns(
        F.col("total_pages"), rate("input_standard"), rate("output_standard"), rate("input_batch"), rate("output_batch"))[
            "cost_batch_usd"])


def missing_split(groups: DataFrame, max_passes: int = K.MAX_RETRY_PASSES, keys: Iterable[str] = ()) -> DataFrame:
    """Missing pages that a further pass may still get, and those that have used up every pass."""
    spent = F.coalesce("retry_pass", F.lit(0)) >= max_passes
    tally = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("missing"))), F.lit(0)).cast("bigint")
    return groups.groupBy(*keys).agg(tally(~spent).alias("retryable"), tally(spent).alias("exhausted"))


# --- group states -----------------------------------------------------------------------------------------------
GROUP_EVENTS = [
    "submit", "nothing_to_send", "submit_failed", "collected", "refused", "job_failed", "lost", "recovered",
    "reopen_failed", "reopen_holes",
]
_PASSES, _LOSSES = K.MAX_RETRY_PASSES + 1, K.MAX_RECOVERY_ATTEMPTS
_STATE_COUNT = len(K.GROUP_STATES) * _PASSES * _LOSSES


def encode_state(state: str, retry_pass: int = 0, losses: int = 0) -> int:
    return (K.GROUP_STATES.index(state) * _PASSES + retry_pass) * _LOSSES + losses


def decode_state(code: int) -> tuple[str, int, int]:
    rest, losses = divmod(code, _LOSSES)
    index, retry_pass = divmod(rest, _PASSES)
    return K.GROUP_STATES[index], retry_pass, losses


def next_state(state: str, retry_pass: int, losses: int, event: str) -> tuple[str, int, int]:
    """One transition of a group. Events that do not apply to the state change nothing."""
    more = retry_pass < K.MAX_RETRY_PASSES
    if state == "pending":
        if event == "submit":
            return "submitted", retry_pass, losses
        if event == "nothing_to_send":
            return ("collected" if retry_pass else "complete"), retry_pass, losses
        if event == "submit_failed":
            return "failed", retry_pass, losses
    if state == "submitted":
        if event == "refused" and more:
            return "pending", retry_pass + 1, losses
        if event in ("collected", "refused"):
            return "collected", retry_pass, losses
        if event == "job_failed":
            return "failed", retry_pass, losses
        if event == "recovered":
            return "submitted", retry_pass, 0
        if event == "lost":
            lost = losses + 1 >= K.MAX_RECOVERY_ATTEMPTS
            return ("failed", retry_pass, losses) if lost else ("submitted", retry_pass, losses + 1)
    if state == "failed" and event == "reopen_failed":
        return "pending", retry_pass, 0
    if state == "collected" and event == "reopen_holes" and more:
        return "pending", retry_pass + 1, losses
    return state, retry_pass, losses


def _transition_table() -> Column:
    rows = [[encode_state(*next_state(*decode_state(c), e)) for c in range(_STATE_COUNT)] for e in GROUP_EVENTS]
    return F.array(*[F.array(*[F.lit(v) for v in row]) for row in rows])


def fold_group_states(events: DataFrame, order: list[str], start: str = "pending") -> DataFrame:
    """Final state of each group after its events ``group, event`` in order.

    An event is a function on the few possible states and functions compose, so runs of at most
    FOLD_BLOCK events are reduced to one function each and those again, until one per group is left.
    A group with any share of all events is folded in parallel.
    """
    codes = F.array(*[F.lit(e) for e in GROUP_EVENTS])
    known = events.withColumn("_e", (F.array_position(codes, F.col("event")) - 1).cast("int")).filter("_e >= 0")
    placed = scan_in_order(known, [F.col("group"), *[F.col(c) for c in order]], "position")
    identity = F.sequence(F.lit(0), F.lit(_STATE_COUNT - 1))
    table = _transition_table()
    level = placed.select("group", F.floor(F.col("position") / FOLD_BLOCK).cast("bigint").alias("block"), "position", "_e")
    folded = level.groupBy("group", "block").agg(F.array_sort(F.collect_list(F.struct("position", "_e"))).alias("run"))
    effect = F.aggregate("run", identity, lambda f, e: F.transform(f, lambda s: F.get(F.get(table, e["_e"]), s)))
    runs = materialise(folded.select("group", "block", effect.alias("effect")), "fold")
    while _has_many(runs):
        again = runs.withColumn("_up", F.floor(F.col("block") / FOLD_BLOCK).cast("bigint")).groupBy("group", "_up").agg(
            F.array_sort(F.collect_list(F.struct("block", "effect"))).alias("run"))
        joined = F.aggregate("run", identity, lambda f, e: F.transform(f, lambda s: F.get(e["effect"], s)))
        runs = materialise(again.select("group", F.col("_up").alias("block"), joined.alias("effect")), "fold")
    final = F.get(F.col("effect"), F.lit(encode_state(start)))
    names = F.array(*[F.lit(s) for s in K.GROUP_STATES])
    coded = runs.select("group", final.alias("_c"))
    return coded.select(
        "group", F.get(names, F.floor(F.col("_c") / (_PASSES * _LOSSES)).cast("int")).alias("state"),
        (F.floor(F.col("_c") / _LOSSES) % _PASSES).cast("int").alias("retry_pass"))


def _has_many(runs: DataFrame) -> bool:
    return not runs.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
