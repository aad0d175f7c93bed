"""Hard-negative mining: slot-decomposed selection of the best negatives below every positive of an anchor.

The positives of an anchor, by falling score s1 >= s2 >= ..., give windows [low * s / 100, high * s / 100] of negative
scores. Their upper limits cut the scores into disjoint slots: slot i holds the scores up to the limit of positive i and
above the limit of positive i + 1. Every task keeps the k best rows of each slot of each anchor (the combiner), the tasks'
lists are merged, and since all of slot i scores above all of slot i + 1, the best of a window are the first k of the
slots i, i + 1, ... in that order: one walk over the slots from the last to the first answers all overlapping windows. The
lower limit cuts the tail of such a list. Exact.

Scale: every row meets every anchor once for the positives and once for the negatives, in blocks, without a shuffle of
vectors; tasks send at most k rows per anchor and slot. Anchors are handled ``pass_anchors`` at a time, so what goes through
the driver and to the tasks is bounded; a larger set takes more passes. No group by label or anchor holds rows, so a hot
label changes nothing.

Edge cases: rows whose id, label or vector is null, or with a null or non-finite component, take no part; zero and empty
vectors do. Of rows with one id the smallest label, then the smallest array counts. Vectors of another length than the
anchor's are not compared with it. Equal scores go by smaller id. Scores beyond the range of long end at its bound. An
empty table, or one without anchors, gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import LEAST, BestOf, Store

MOST = 2**63 - 1


@dataclass(frozen=True)
class MiningOptions:
    positives: int = 5          # best rows of the anchor's label
    negatives: int = 10         # rows returned for each window
    low: int = 30               # windows, as hundredths of the positive's score
    high: int = 90
    scale: int = 256            # components become floor(scale * x)
    pass_anchors: int = 20_000  # anchors handled in one pass over the table
    cells: int = 2_000_000      # scores held at once in a task


@dataclass(frozen=True)
class Anchors:
    """Anchors of one pass and one vector length, with the upper limits of their slots and the least wanted score."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    upper: np.ndarray | None = None
    least: np.ndarray | None = None


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole numbers; through doubles while these stay exact."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    if float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < 2.0**53:
        return (x @ y.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object)
    return np.clip(whole(x).dot(whole(y).T), LEAST, MOST).astype(np.int64)


def read_vectors(batch: pa.RecordBatch, scale: int):
    """(ids, labels, whole-number matrix) for every vector length of a batch."""
    ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
    vectors = batch.column("v")
    flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    starts = starts - starts[0]
    lengths = np.diff(starts)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield ids[at], labels[at], np.floor(scale * flat[starts[at][:, None] + np.arange(d)].reshape(len(at), d))


def best_in_task(groups: dict, slots: int, k: int, o: MiningOptions):
    """mapInArrow function: the ``k`` best rows of this task for every anchor, or every slot of it where limits are given."""

    def run(batches):
        best = {d: BestOf(len(a.value.ids) * slots, k) for d, a in groups.items()}
        size = 64
        for batch in batches:
            for ids, labels, x in read_vectors(batch, o.scale):
                if x.shape[1] not in groups:
                    continue
                a, top = groups[x.shape[1]].value, best[x.shape[1]]
                numbers, at = np.arange(len(a.ids)) * slots, 0
                while at < len(ids):  # short blocks first: they set the scores that later rows must reach
                    i, g = slice(at, at + size), scores(x[at : at + size], a.x)
                    at, size = at + size, min(2 * size, max(16, o.cells // len(a.ids)))
                    if a.upper is None:
                        key = np.broadcast_to(numbers, g.shape)
                        fits = (labels[i][:, None] == a.labels) & (ids[i][:, None] != a.ids) & (g >= top.floor)
                    else:
                        slot = sum((g <= a.upper[:, j]).astype(np.int64) for j in range(slots)) - 1
                        key = numbers + np.maximum(slot, 0)
                        fits = (labels[i][:, None] != a.labels) & (slot >= 0) & (g >= a.least) & (g >= top.floor[key])
                    row, column = np.nonzero(fits)
                    top.add(key[row, column], g[row, column], ids[i][row])
        for d, top in best.items():
            yield pa.RecordBatch.from_pydict({
                "anchor_id": pa.array(groups[d].value.ids[top.key // slots]), "slot": pa.array((top.key % slots).astype(np.int32)),
                "score": pa.array(top.score), "vec_id": pa.array(top.id)})

    return run


def merged(df: DataFrame, k: int) -> DataFrame:
    """(anchor_id, slot, best): the ``k`` best of all tasks' lists, in order, as structs (fall = -score, vec_id)."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    first = df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return first.groupBy("anchor_id", "slot").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("fall"), "vec_id"))).alias("best"))


def suffixes(lists: Column, k: int) -> Column:
    """For every slot the first ``k`` of it and all later slots; ``lists`` holds the slots' sorted lists."""
    none = F.slice(lists, 1, 0)
    walked = F.aggregate(F.reverse(lists), none, lambda done, one: F.concat(
        F.array(F.slice(F.concat(one, F.coalesce(F.get(done, F.lit(0)), F.slice(one, 1, 0))), 1, k)), done))
    return walked


def load(anchors: DataFrame, limits: dict | None, slots: int, o: MiningOptions) -> dict:
    """Broadcast anchors by vector length; ``limits`` maps an anchor to its positives' scores, falling."""
    out, context = {}, anchors.sparkSession.sparkContext
    for batch in anchors.select("id", "label", "v").toArrow().combine_chunks().to_batches():
        for ids, labels, x in read_vectors(batch, o.scale):
            out.setdefault(x.shape[1], []).append((ids, labels, x))
    groups = {}
    for d, parts in out.items():
        ids, labels, x = (np.concatenate(p) for p in zip(*parts))
        upper = least = None
        if limits is not None:
            wanted = np.array([i in limits for i in ids.tolist()], bool)
            ids, labels, x = ids[wanted], labels[wanted], x[wanted]
            upper = np.array([[o.high * s // 100 for s in limits[i]] + [-(2**63)] * (slots - len(limits[i])) for i in ids.tolist()], np.int64)
            least = np.array([-(-o.low * limits[i][-1] // 100) for i in ids.tolist()], np.int64)
        if len(ids):
            groups[d] = context.broadcast(Anchors(ids, labels, x, upper, least))
    return groups


def mine_negatives(table: DataFrame, is_anchor, options: MiningOptions | None = None, id_column: str = "vec_id",
                   vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``is_anchor(id)`` holds.
    """
    o, spark = options or MiningOptions(), table.sparkSession
    store = Store(spark, "negatives")
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"),
                        F.col(vector_column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v")
    rows = store.save(rows, "rows")
    every = rows.filter(is_anchor(F.col("id")))
    count = every.count()
    passes, found = -(-count // o.pass_anchors), []
    listed = "anchor_id long, slot int, score long, vec_id long"
    for number in range(passes):
        anchors = every.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == number)
        groups = load(anchors, None, 1, o)
        if not groups:
            continue
        near = merged(rows.mapInArrow(best_in_task(groups, 1, o.positives, o), listed), o.positives)
        near = store.save(near.select("anchor_id", F.col("best").alias("positives")), "positives")
        # windows below zero are empty, as low * s > high * s; a pass's limits are at most pass_anchors * positives numbers
        wanted = near.select("anchor_id", F.filter("positives", lambda p: p.fall <= 0).fall.alias("fall")).filter(F.size("fall") > 0).toArrow()
        limits = {a: [-f for f in fall] for a, fall in zip(wanted["anchor_id"].to_pylist(), wanted["fall"].to_pylist())}
        groups = load(anchors, limits, o.positives, o)
        if not groups:
            continue
        slots = merged(rows.mapInArrow(best_in_task(groups, o.positives, o.negatives, o), listed), o.negatives)
        by_slot = slots.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "best"))).alias("slots"))
        both = near.join(by_slot, "anchor_id")
        lists = F.transform(F.sequence(F.lit(0), F.lit(o.positives - 1)), lambda i: F.coalesce(
            F.try_element_at("slots", i), F.slice(F.map_values("slots")[0], 1, 0)))
        windows = both.withColumn("lists", lists).withColumn("windows", suffixes(F.col("lists"), o.negatives))
        pairs = windows.select("anchor_id", "windows", F.posexplode("positives").alias("slot", "p"))
        pairs = pairs.withColumn("positive_score", -F.col("p.fall")).filter("positive_score >= 0")
        enough = F.filter(F.get("windows", F.col("slot")), lambda n: F.lit(o.low).cast("decimal(20,0)") * F.col("positive_score")
                          <= F.lit(-100).cast("decimal(20,0)") * n.fall)
        found.append(store.save(pairs.select("anchor_id", F.col("p.vec_id").alias("positive_id"), "positive_score", F.posexplode(enough).alias("place", "n"))
                     .select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("n.vec_id").alias("negative_id"),
                             "positive_score", (-F.col("n.fall")).alias("negative_score")), "found"))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    store.keep(*found)
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out
