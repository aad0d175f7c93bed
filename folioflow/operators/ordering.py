"""Numbering and running sums over a total order, without pulling rows into one task.

Rows are range-partitioned on a unique order, stored, and summed per partition. The one-row-per-
partition totals give each partition its offset; the rest is a window inside each partition. No
partition holds more than its share, whatever the keys look like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.plans.storage import materialise


def scan_in_order(
    df: DataFrame, order: list, position: str | None = "position", sums: dict[str, Column] | None = None
) -> DataFrame:
    """Add a 1-based ``position`` and, per entry of ``sums``, the running sum up to and with the row.

    ``order`` must be unique per row: ties would leave the order open.
    """
    sums = sums or {}
    valued = df.select("*", *[F.coalesce(c, F.lit(0)).alias(f"_v_{n}") for n, c in sums.items()])
    stored = materialise(
        valued.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "ordered")
    totals = stored.groupBy("_slice").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    # One row per partition: bounded by the number of partitions, so one task and a broadcast are safe.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_o_rows"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy("_slice").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = stored.join(F.broadcast(offsets), "_slice")
    extra = [(F.col("_o_rows") + F.row_number().over(inside)).cast("bigint").alias(position)] if position else []
    extra += [(F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(upto)).alias(n) for n in sums]
    return joined.select(*df.columns, *extra)


def next_in_order(df: DataFrame, order: list, flag: Column, value: Column, out: str = "next") -> DataFrame:
    """Add the value of the first flagged row at or after each row in a unique order (NULL for none).

    Inside a range partition this is a window; a row with no flagged row left in its partition takes
    the first of the following partitions, of which there is one candidate per partition.
    """
    marked = df.withColumn("_mark", F.when(flag, value))
    stored = materialise(marked.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "ordered")
    sort_key = F.struct(*order)
    firsts = stored.groupBy("_slice").agg(F.min_by("_mark", F.when(F.col("_mark").isNotNull(), sort_key)).alias("_first"))
    # Read backwards, "the next flagged row" is the last one seen, a frame that only grows.
    # The first window runs over one row per partition.
    backwards = Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    following = firsts.select("_slice", F.last("_first", ignorenulls=True).over(backwards).alias("_later"))
    onward = Window.partitionBy("_slice").orderBy(*[c.desc() for c in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    joined = stored.join(F.broadcast(following), "_slice")
    here = F.last("_mark", ignorenulls=True).over(onward)
    return joined.select(*df.columns, F.coalesce(here, F.col("_later")).alias(out))


def running_max(df: DataFrame, order: list, values: dict[str, Column]) -> DataFrame:
    """Add, per entry of ``values``, the largest value at or before each row in a unique order.

    Structs that begin with the first order column restart with it, as later keys are larger.
    """
    stored = materialise(
        df.withColumns(values).repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "ordered")
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    tops = stored.groupBy("_slice").agg(*[F.max(n).alias(f"_t_{n}") for n in values])
    before = tops.select("_slice", *[F.max(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in values])
    upto = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = stored.join(F.broadcast(before), "_slice")
    return joined.select(*df.columns, *[F.greatest(F.col(f"_b_{n}"), F.max(n).over(upto)).alias(n) for n in values])


def number_within(df: DataFrame, key: str, order: list, out: str = "number") -> DataFrame:
    """Add the 0-based number of each row within its key; ``order`` must be unique within a key."""
    whole = [F.col(key), *order]
    placed = scan_in_order(df, whole, position="_at")
    first = running_max(placed, whole, {"_first": F.struct(F.col(key).alias("k"), (-F.col("_at")).alias("at"))})
    return first.withColumn(out, F.col("_at") + F.col("_first.at")).drop("_at", "_first")


def dedupe_keep_first(df: DataFrame, key: str, pos: str) -> DataFrame:
    """One row per key, the one with the smallest position (order-preserving de-duplication)."""
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(pos)).alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in others]).select(*df.columns)
