"""Mixing sources to target weights by Pfair scheduling.

A source of weight w gets its block i (from 0) released at slot floor(i/w) and due by slot
ceil((i+1)/w). Earliest-deadline-first over these windows keeps every source within one block of its
weight at every slot. Weights are taken exactly, as fractions. The schedule is laid out in periods by parallel
tasks: where a period begins, each source has had its share rounded down or up, so no error is carried on.

Documents are shuffled within their source by a digest of the id and numbered through even buckets of the
digest, so a source with any share of the rows is numbered by many tasks. No document is dropped or repeated: once
a source has run out, slots that no other source is due for stay empty, and the others go on in their proportion.

Edge cases: a null source is the source of the empty name; sources without a given weight take the
derived one; rows with a null doc_id are spread by their text, where there is one; equal rows follow each other; an empty
table gives no rows; extra columns of any name are kept, but block, slot and place_in_block are replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.common import free_name


@dataclass(frozen=True)
class MixOptions:
    """``weights``: parts per source, positive; others get rows ** ``power``. ``period``: least slots a task lays out at once."""

    weights: dict[str, float] = field(default_factory=dict)
    power: float = 0.5
    period: int = 1000
    block_rows: int = 16
    bucket_rows: int = 2000
    most_sources: int = 20_000


def whole_parts(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights as whole parts of a period by largest remainders; every source gets one part at least."""
    period = max(period, 20 * len(weights))
    total, left = sum(weights.values()), period - len(weights)
    exact = {s: w / total * left for s, w in weights.items()}
    parts = {s: 1 + int(x) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in by_rest[: period - sum(parts.values())]:
        parts[s] += 1
    return parts


def whole_blocks(weights: list[int], slots: int) -> list[int]:
    """Blocks of every source in the first ``slots`` slots: its share rounded down or up, ``slots`` in all."""
    total = sum(weights)
    given = [w * slots // total for w in weights]
    by_rest = sorted(range(len(weights)), key=lambda k: (-(weights[k] * slots % total), k))
    for k in by_rest[: slots - sum(given)]:
        given[k] += 1
    return given


def lay_out(weights: list[int], blocks: list[int], period: int, p: int) -> Iterator[tuple[int, int, int]]:
    """(slot, source, block) of period ``p``, by earliest deadline first among released blocks.

    The blocks of a period follow from its bounds alone, so periods are laid out apart. Windows are those
    of the endless schedule, cut at the bounds; as each source has its share there, rounded, they can all be kept.
    """
    total, begin, end = sum(weights), p * period, (p + 1) * period
    until = [min(n, b) for n, b in zip(whole_blocks(weights, end), blocks)]
    waiting = [(max(i * total // weights[k], begin), k, i) for k, i in enumerate(whole_blocks(weights, begin)) if i < until[k]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    t = begin
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (min(-(-(i + 1) * total // weights[k]), end), k, i))
        _, k, i = heapq.heappop(ready)
        yield t, k, i
        if i + 1 < until[k]:
            heapq.heappush(waiting, (max((i + 1) * total // weights[k], begin), k, i + 1))
        t += 1


def schedule(parts: dict[str, int]) -> list[str]:
    """The source of every slot of one period of whole parts."""
    names, weights = list(parts), list(parts.values())
    return [names[k] for _, k, _ in lay_out(weights, weights, sum(weights), 0)]


def slots_of_blocks(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int], o: MixOptions) -> DataFrame:
    """(_source, block, slot) of all blocks, a period of slots at a time in parallel tasks."""
    names = sorted(weights)
    exact = [Fraction(weights[s]) for s in names]
    if any(w <= 0 for w in exact):
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in exact))
    parts, counts = [int(w * scale) for w in exact], [blocks[s] for s in names]
    total = sum(parts)
    # Every source has a block in each period, so that shares rounded at the bounds never fall.
    period = max([o.period, *(-(-total // w) for w in parts)])
    periods = max((-(-n * total // (w * period)) for n, w in zip(counts, parts)), default=0)

    def run(frames):
        for frame in frames:
            for p in frame["id"].tolist():
                placed = lay_out(parts, counts, period, p)
                while rows := list(islice(placed, 50_000)):
                    yield pd.DataFrame({"_source": [names[k] for _, k, _ in rows], "block": [i for _, _, i in rows], "slot": [t for t, _, _ in rows]})

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, periods, 1, max(1, min(periods, width))).mapInPandas(run, "_source string, block long, slot long")


def mix(docs: DataFrame, options: MixOptions | None = None) -> DataFrame:
    """``docs`` with block (number in its source), slot and place_in_block, in the mixed order."""
    o, spark = options or MixOptions(), docs.sparkSession
    own = free_name(docs, "_mix")
    of, digest, bucket, row, before, start = (f"{own}_{c}" for c in ("source", "digest", "bucket", "row", "before", "slot"))
    ties = [c for c in ("doc_id", "text") if c in docs.columns]
    # Rows without an id are told apart by their text, so that they spread over the buckets too.
    nameless = F.hex(F.xxhash64("text")) if "text" in docs.columns else F.lit("")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), nameless).cast("binary"))
    keyed = docs.withColumn(of, F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn(digest, key)
    counted = keyed.groupBy(F.col(of).alias("name")).agg(F.count(F.lit(1)).alias("n")).limit(o.most_sources + 1)
    sizes = {r["name"]: r["n"] for r in counted.collect()}
    if len(sizes) > o.most_sources:
        raise ValueError(f"more than {o.most_sources} sources")
    weights = {s: o.weights.get(s, n**o.power) for s, n in sizes.items()}
    plan = slots_of_blocks(spark, weights, {s: -(-n // o.block_rows) for s, n in sizes.items()}, o)
    plan = plan.select(F.col("_source").alias(of), "block", F.col("slot").alias(start))

    buckets = max(1, -(-max(sizes.values(), default=1) // o.bucket_rows))
    keyed = keyed.withColumn(bucket, F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("int"))
    counts = keyed.groupBy(of, bucket).agg(F.count(F.lit(1)).alias("n"))
    lower = Window.partitionBy(of).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(of, bucket, F.coalesce(F.sum("n").over(lower), F.lit(0)).alias(before))
    inside = Window.partitionBy(of, bucket).orderBy(digest, *ties)
    ranked = keyed.withColumn(row, F.row_number().over(inside)).join(counts, [of, bucket])
    number = F.col(before) + F.col(row) - 1
    placed = ranked.withColumn("block", F.floor(number / o.block_rows)).join(plan, [of, "block"])
    placed = placed.withColumn("slot", F.col(start)).withColumn("place_in_block", (number % o.block_rows).cast("int"))
    names = [*docs.columns, *(c for c in ("block", "slot", "place_in_block") if c not in docs.columns)]
    mixed = placed.select(*names)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(width, "slot", "place_in_block").sortWithinPartitions("slot", "place_in_block")
