"""Comparing two versions of a document page by page."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow import constants as K
from folioflow.functions.markdown import for_mode
from folioflow.functions.text import collapse
from folioflow.operators.word_diff import TOKEN, difference


def compare_pages(a: DataFrame, b: DataFrame, keys: list[str], mode: str = "source") -> DataFrame:
    """Pages of both sides with ``status``: same, changed, only_a or only_b.

    ``keys`` name the document pair; pages are rows ``keys, page_num, text``. Rewrapping alone is no
    change. Texts are reduced before the join, so equality is decided where the pair meets.
    """
    on = [*keys, "page_num"]
    left = a.filter(F.col("page_num").isNotNull()).select(*on, for_mode("text", mode).alias("text_a"))
    right = b.filter(F.col("page_num").isNotNull()).select(*on, for_mode("text", mode).alias("text_b"))
    status = F.when(F.col("text_b").isNull(), "only_a").when(F.col("text_a").isNull(), "only_b").when(
        collapse("text_a") == collapse("text_b"), "same").otherwise("changed")
    return left.join(right, on, "full_outer").select(*on, "text_a", "text_b", status.alias("status"))


def compare_summary(compared: DataFrame, keys: list[str]) -> DataFrame:
    count = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    sums = compared.groupBy(*keys).agg(
        count("changed").alias("changed"), count("changed", "same").alias("shared"),
        count("only_a").alias("only_a"), count("only_b").alias("only_b"))
    return sums.withColumn("wholesale", is_wholesale(F.col("changed"), F.col("shared")))


def is_wholesale(changed, shared):
    """Nearly everything differs: the two documents are hardly versions of each other."""
    return F.when(shared > 0, changed / shared >= K.WHOLESALE_SHARE).otherwise(F.lit(False))


# --- word-level differences ---------------------------------------------------------------------------
DIFF_SCHEMA = TY.ArrayType(TY.StructType([
    TY.StructField("op", TY.StringType()), TY.StructField("tokens", TY.ArrayType(TY.StringType()))]))
COUNTS = ("added", "removed", "inserted", "deleted")


def diff_pages(compared: DataFrame, limit: int | None = None) -> DataFrame:
    """Word-level difference of each changed page pair: ``ops``, words ``added`` and ``removed``, tokens
    (words and the white space between them) ``inserted`` and ``deleted``, the fewest that rebuild the page.

    Unchanged pairs are filtered natively; the rest is independent per row, so Arrow batches of
    pairs go to the search wherever they are. ``limit`` bounds the tokens of one script, see ``difference``.
    """
    changed = compared.filter(F.col("status") == "changed").drop("status")
    # The search costs far more than moving its input: use every core, whatever the bytes say.
    session = changed.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    changed = changed.repartition(tasks)
    keys = [c for c in changed.columns if c not in ("text_a", "text_b")]
    schema = TY.StructType([changed.schema[k] for k in keys] + [TY.StructField("ops", DIFF_SCHEMA)]
                           + [TY.StructField(c, TY.LongType()) for c in COUNTS])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ops = [difference(TOKEN.findall(x), TOKEN.findall(y), limit)
                   for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())]
            size = lambda sign, real: pa.array([sum(
                sum(not t.isspace() for t in ts) if real else len(ts) for o, ts in one if o == sign) for one in ops], pa.int64())
            listed = pa.array([[{"op": o, "tokens": ts} for o, ts in one] for one in ops], arrow.field("ops").type)
            columns = [batch.column(k) for k in keys] + [listed, size("+", True), size("-", True), size("+", False), size("-", False)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return changed.mapInArrow(run, schema)


def page_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Page numbers in A only, in B only and in both."""
    on = [*keys, "page_num"]
    pa, pb = a.select(*on).filter("page_num is not null"), b.select(*on).filter("page_num is not null")
    both = pa.withColumn("_a", F.lit(1)).join(pb.withColumn("_b", F.lit(1)), on, "full_outer")
    where = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both")
    return both.select(*on, where.alias("membership"))
