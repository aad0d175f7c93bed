"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

Only DataFrame functions. Every item is cut into windows of ``size`` words (an item of fewer words is one window); their
64-bit hashes, words and items are broadcast. Each text is read once: its windows are hashed in place, looked up in the
set, and a window counts only if its words are those of the test window. Hits leave as (place, length, items); no text
and no word is shuffled to find them. Covered places are merged per document, and the words or the whole document go.

Scale: one scan of the texts per slice of the set. A slice holds about ``slice_pairs`` pairs of window and item, counted
before it is broadcast; a larger test set takes more slices, never a larger broadcast. Hits are collected per row, so
a passage in a third of all documents is spread over them; what one row collects is bounded by its own text.

Edge cases: a null or empty text has no words and no hits, an item of no words has no window. An item without id marks
words but is not listed; rows of one item_id are one item. Repeated rows, equal ids with other texts and null ids are
documents of their own, each returned. Empty tables give no hits, or no rows. Input columns pass through; of those
named as a result column the result takes the place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Store, free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class LeakOptions:
    size: int = 10               # words of a window
    slice_pairs: int = 200_000   # pairs of window and item in one broadcast


def words(text: Column) -> Column:
    """Lower-cased words (A-Z only) between ASCII characters that are neither letter nor digit."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)
    return F.array_remove(parts, "")


def window_hash(array: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(array, start + i) for i in range(length)])


def test_windows(items: DataFrame, o: LeakOptions, id_column: str, text_column: str) -> DataFrame:
    """(length, h, window, item), distinct: the windows of all items, their words joined by spaces."""
    w = items.select(F.col(id_column).cast("string").alias("item"), words(F.col(text_column)).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("length", F.least(F.size("w"), F.lit(o.size)))
    w = w.select("item", "w", "length", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))).alias("i"))
    # the hash of a test window is that of the scan: the words one by one, each length on its own
    h = F.coalesce(*[F.when(F.col("length") == n, window_hash(F.col("w"), F.col("i"), n)) for n in range(1, o.size + 1)])
    return w.select("length", h.alias("h"), F.array_join(F.slice("w", F.col("i") + 1, F.col("length")), " ").alias("window"), "item").distinct()


def scan(texts: DataFrame, known: DataFrame, lengths: list[int], slices: int) -> DataFrame:
    """(the columns of ``texts`` but ``w``, i, length, items): windows of ``texts`` found in the broadcast set."""
    keep, found = [c for c in texts.columns if c != "w"], None
    # explode_outer, so that no filter that splits the text a second time is inferred
    places = texts.select("*", F.explode_outer(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))).alias("i"))
    for n in lengths:
        at = places.withColumn("h", F.when(F.col("i") + n <= F.size("w"), window_hash(F.col("w"), F.col("i"), n)))
        for number in range(slices):
            part = known.filter(F.col("length") == n)
            if slices > 1:
                part = part.filter(F.pmod(F.xxhash64("window", "item"), F.lit(slices)) == number)
            part = part.groupBy("h", "window").agg(F.collect_set("item").alias("items"))
            met = at.join(F.broadcast(part.withColumnRenamed("h", "test_h")), F.col("h") == F.col("test_h"))
            met = met.filter(F.array_join(F.slice("w", F.col("i") + 1, n), " ") == F.col("window"))
            met = met.select(*keep, "i", F.lit(n).alias("length"), "items")
            found = met if found is None else found.unionByName(met)
    return found


def merged_spans(hits: Column) -> Column:
    """Disjoint rising spans (start, end) of the sorted hits (i, length); words from start to end - 1 are hit."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(none.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

    def step(a, x):
        joins = x.i <= a.end
        closed = F.when(joins | (a.end < 0), a.done).otherwise(F.concat(a.done, F.array(F.struct(a.start.alias("start"), a.end.alias("end")))))
        return F.struct(closed.alias("done"), F.when(joins, a.start).otherwise(x.i).alias("start"),
                        F.greatest(a.end, x.i + x.length).alias("end"))

    return F.aggregate(hits, start, step, lambda a: F.concat(a.done, F.array(F.struct(a.start.alias("start"), a.end.alias("end")))))


def kept_words(array: Column, spans: Column) -> Column:
    """The words outside the spans: the stretches before, between and after them."""
    ends = F.concat(F.array(F.lit(0)), spans.end)
    starts = F.concat(spans.start, F.array(F.size(array)))
    return F.flatten(F.zip_with(ends, starts, lambda e, s: F.slice(array, e + 1, s - e)))


def find_leaks(docs: DataFrame, items: DataFrame, options: LeakOptions | None = None, id_column: str = "doc_id",
               text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted as text), spans, contaminated."""
    o, spark = options or LeakOptions(), docs.sparkSession
    store = Store(spark, "leaks")
    known = store.save(test_windows(items, o, item_column, item_text), "windows")
    sizes = {r["length"]: r["n"] for r in known.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    slices = max(1, -(-sum(sizes.values()) // o.slice_pairs))
    row, key = free_name(docs, "row"), F.xxhash64(F.col(id_column), F.col(text_column))
    results = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
    docs = docs.drop(*[c for c in results if c not in (id_column, text_column)])
    # rows of one id and one text have the same hits, so the pair names them in every attempt of a task
    texts = docs.select(F.col(id_column).alias("id"), key.alias("k"), words(F.col(text_column)).alias("w"))
    none = F.array().cast("array<string>")
    no_spans = F.array().cast("array<struct<start:int,end:int>>")
    out = docs.withColumn(row, key).withColumn("n_words", F.size(words(F.col(text_column))).cast("long"))
    if sizes:
        hits = scan(texts, known, sorted(sizes), slices)
        per = hits.groupBy("id", "k").agg(F.sort_array(F.collect_set(F.struct("i", "length"))).alias("hits"),
                                          F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"))
        per = per.select(F.col("id").alias(row + "_id"), F.col("k").alias(row + "_k"), merged_spans(F.col("hits")).alias(row + "_spans"), F.col("found").alias(row + "_items"))
        per = store.save(per, "hits")
        store.keep(per)
        out = out.join(per, F.col(id_column).eqNullSafe(F.col(row + "_id")) & (F.col(row) == F.col(row + "_k")), "left")
        spans, found = F.coalesce(F.col(row + "_spans"), no_spans), F.coalesce(F.col(row + "_items"), none)
    else:
        spans, found = no_spans, none
    out = out.withColumn("spans", spans).withColumn("items", found)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return (out.withColumn("n_hit", covered).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)
            .drop(row, row + "_id", row + "_k", row + "_spans", row + "_items"))


def decontaminate(docs: DataFrame, items: DataFrame, whole: bool = False, options: LeakOptions | None = None, text_column: str = "text",
                  **columns) -> DataFrame:
    """Remove benchmark passages: the spans of hit words, or with ``whole`` every document that holds one.

    A document that loses words becomes its remaining words joined by spaces; others keep their text as it is.
    """
    found = find_leaks(docs, items, options, text_column=text_column, **columns)
    if whole:
        return found.filter("NOT contaminated")
    rest = F.array_join(kept_words(words(F.col(text_column)), F.col("spans")), " ")
    return found.withColumn(text_column, F.when(F.col("contaminated"), rest).otherwise(F.col(text_column)))
