"""Vectors of a table: validity and packing, shared by the two vector operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v array<double>, ok): one row per id; of several vectors of an id, the smallest array counts.

    ``ok`` is false for null, empty and zero vectors and for null or non-finite components.
    """
    v = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    v = v.groupBy("id").agg(F.min("v").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x.isNotNull() & (x != 0))
    return v.withColumn("ok", F.coalesce(finite & some, F.lit(False)) & F.col("id").isNotNull())


def matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.float64) for x in column])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by the largest component first, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
