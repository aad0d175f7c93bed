"""Joins that stay even when one key carries a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000
SMALL_GROUP = 10_000


def lookup(facts: DataFrame, table: DataFrame, key: str, how: str = "inner", hot_keys: int = HOT_KEYS,
           counts: DataFrame | None = None) -> DataFrame:
    """Join facts to a table with at most one row per key.

    A key is hot when it carries more than ``1/hot_keys`` of the facts, so fewer than ``hot_keys``
    keys can be hot. The table rows of those keys are broadcast, all others are joined by shuffle,
    where no key can exceed that share. ``counts`` (``key, _n``) may be passed where it is known.
    """
    counts = counts if counts is not None else facts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    seen = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.max("_n").alias("top")).first()
    if not seen["total"] or seen["top"] * hot_keys <= seen["total"] or seen["top"] <= SMALL_GROUP:
        return facts.join(table, key, how)
    hot = counts.filter((F.col("_n") * hot_keys > F.lit(seen["total"])) & (F.col("_n") > SMALL_GROUP)).select(key)
    hot_rows = F.broadcast(table.join(F.broadcast(hot), key, "left_semi"))
    flagged = facts.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    even = flagged.filter(F.col("_hot").isNull()).drop("_hot").join(table, key, how)
    skewed = flagged.filter(F.col("_hot")).drop("_hot").join(hot_rows, key, how)
    return even.unionByName(skewed)
