"""Ranked lexical search with hashed max-sketches.

Index: every document becomes its sorted term hashes with their impacts (what a term adds to a score per unit of its weight)
and a sketch: impacts, scaled to a byte and rounded up, are folded by three hashes of their term into coordinates, each
keeping the maximum. None of a term's coordinates is below its impact, so weights times the least of them bound the score.

Search: a task looks up the coordinates of all terms of a batch of items in a block of sketches, one matrix product gives
the bounds of all pairs, and each item rescores documents exactly in falling order of their bounds until the bound falls
below its k-th best score. Only rescored documents have their term lists read. Tasks return k rows per item; their best k
are the answer. Exact: sketches only decide what need not be rescored. Terms are known by 64-bit hashes.

Scale: the texts are read twice (lengths, index) and the index once per slice of items for the frequencies of its terms and
once for the search; nothing of the corpus is shuffled or gathered. Items are cut into slices of about ``slice_terms``
terms, so what the driver and the tasks hold does not grow with the number of items. A sketch has at least ``spread``
coordinates per distinct term, so long documents are bounded as tightly as short ones: one absent term in sixty meets others
on all three.

Edge cases: a null text, or one without terms, is never a result and counts for nothing. Repeated rows and equal ids are
documents of their own; those without id (or with the greatest long as id) come last among equal scores, with a null id.
Rows of one item_id are one item, those without id too; an item without terms gives no rows. Empty tables give no
rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import BestOf, Store, WordHashes

NO_ID = 2**63 - 1
#: What separates terms: every ASCII character that is neither letter nor digit.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPELLING = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


@dataclass(frozen=True)
class SearchOptions:
    k: int = 50
    spread: int = 10           # coordinates per distinct term, at least
    slice_terms: int = 50_000  # terms of the items searched in one pass
    items_at_once: int = 128   # items of one matrix product
    block_rows: int = 1_000    # documents of one matrix product
    rescored_at_once: int = 64


def terms(text: bytes) -> list[bytes]:
    return text.translate(SPELLING).split()


def term_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")).cast("long")


def coordinates(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """Three coordinates of every hash, each from other bits of it."""
    return [((hashes >> np.uint64(shift) & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) for shift in (0, 16, 32)]


def sketch_size(n: int, spread: int) -> int:
    """At least ``spread`` coordinates per term; four sizes per power of two, so that many documents share one."""
    step = 1 << max(0, (spread * n).bit_length() - 3)
    return max(16, -(-spread * n // step) * step)


def sketch_of(hashes: np.ndarray, impacts: np.ndarray, spread: int) -> tuple[int, bytes]:
    """(scale, coordinates): scale times the least of a term's coordinates is at least its impact."""
    scale = -(-int(impacts.max()) // 255)
    size = sketch_size(len(hashes), spread)
    folded, scaled = np.zeros(size, np.uint8), (-(-impacts // scale)).astype(np.uint8)
    for at in coordinates(hashes, size):
        np.maximum.at(folded, at, scaled)
    return scale, folded.tobytes()


def index_texts(n_docs: int, n_terms: int, o: SearchOptions):
    """mapInArrow function: (id, scale, sketch, hashes, impacts) of every text that has terms."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("id"), batch.column("text")):
                found = terms(text.as_py() or b"")
                if not found:
                    continue
                m = 50 + 50 * len(found) * n_docs // n_terms
                counts = Counter(found)
                hashes = np.fromiter((known[t] for t in counts), np.uint64, len(counts))
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                order = np.argsort(hashes)
                hashes, tf = hashes[order], tf[order]
                impacts = 1_000_000_000 * tf // (1000 * tf + 20 * m)
                scale, sketch = sketch_of(hashes, impacts, o.spread)
                rows.append((i.as_py(), scale, sketch, hashes.tobytes(), impacts.astype(np.int32).tobytes()))
            if rows:
                ids, scales, sketches, hashes, impacts = zip(*rows)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(ids, pa.int64()), "scale": pa.array(scales, pa.int32()), "sketch": pa.array(sketches, pa.binary()),
                    "hashes": pa.array(hashes, pa.binary()), "impacts": pa.array(impacts, pa.binary())})

    return run


def item_terms(batches):
    """mapInArrow function: (item, h), the term hashes of every item."""
    known = WordHashes()
    for batch in batches:
        pairs = [(i.as_py(), np.uint64(known[t]).astype(np.int64)) for i, text in zip(batch.column("item"), batch.column("text"))
                 for t in set(terms(text.as_py() or b""))]
        if pairs:
            items, hashes = zip(*pairs)
            yield pa.RecordBatch.from_pydict({"item": pa.array(items, pa.int64()), "h": pa.array(hashes, pa.int64())})


class Lookup:
    """Finds 64-bit hashes in a sorted set; a table of their low bits rules most others out first."""

    def __init__(self, wanted: np.ndarray):
        self.wanted, bits = wanted, max(10, (16 * len(wanted)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(wanted & self.mask).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes``, places in the set) of the hashes that it holds."""
        at = np.flatnonzero(self.seen[(hashes & self.mask).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.wanted, hashes[at]), len(self.wanted) - 1)
        same = self.wanted[place] == hashes[at]
        return at[same], place[same]


def frequencies(wanted):
    """mapInArrow function: (h, df), in how many of this task's documents each wanted term is."""

    def run(batches):
        lookup, df = Lookup(wanted.value), np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for one in batch.column("hashes"):
                df[lookup(np.frombuffer(one.as_buffer(), np.uint64))[1]] += 1
        yield pa.RecordBatch.from_pydict({"h": pa.array(wanted.value[df > 0].view(np.int64)), "df": pa.array(df[df > 0])})

    return run


@dataclass(frozen=True)
class Items:
    """Some items with the sorted hashes of their terms and the weights, terms by items."""

    numbers: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray      # int64
    factors: np.ndarray      # the same in single precision

    def of(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        own = self.weights[:, item] > 0
        return self.hashes[own], self.weights[own, item]


def bounds(sketches: list, scales: np.ndarray, items: Items) -> np.ndarray:
    """Upper bounds of the scores, documents by items."""
    out = np.empty((len(sketches), items.factors.shape[1]), np.float64)
    sizes = np.array([len(s) for s in sketches])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        folded = np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(len(at), size)
        a, b, c = coordinates(items.hashes, int(size))
        seen = np.minimum(np.minimum(folded[:, a], folded[:, b]), folded[:, c])
        out[at] = seen.astype(np.float32) @ items.factors
    most = int((items.weights > 0).sum(axis=0).max())
    return out * scales[:, None] * (1 + (most + 16) * 2.0**-22)  # more than single precision can lose on so many terms


def search_task(parts, o: SearchOptions):
    """mapInArrow function: the ``k`` best documents of this task for every item, as (number, score, id)."""

    def run(batches):
        groups = [(g, [BestOf(1, o.k) for _ in g.numbers], [(Lookup(h), w) for h, w in map(g.of, range(len(g.numbers)))]) for g in parts.value]
        for batch in batches:
            for start in range(0, batch.num_rows, o.block_rows):
                block = batch.slice(start, o.block_rows)
                ids = block.column("id").fill_null(NO_ID).to_numpy()
                scales, sketches = block.column("scale").to_numpy(), block.column("sketch").to_pylist()
                hashes, impacts = block.column("hashes"), block.column("impacts")
                for group, best, own in groups:
                    limits = bounds(sketches, scales, group)
                    for item, (top, (lookup, weights)) in enumerate(zip(best, own)):
                        limit, floor = limits[:, item], max(1, top.floor[0])
                        open_ = np.flatnonzero(limit >= floor)
                        open_ = open_[np.argsort(-limit[open_], kind="stable")]
                        for i in range(0, len(open_), o.rescored_at_once):
                            if limit[open_[i]] < max(1, top.floor[0]):
                                break
                            chosen = open_[i : i + o.rescored_at_once]
                            h = [np.frombuffer(hashes[int(d)].as_buffer(), np.uint64) for d in chosen]
                            u = np.concatenate([np.frombuffer(impacts[int(d)].as_buffer(), np.int32) for d in chosen])
                            of = np.repeat(np.arange(len(chosen)), [len(x) for x in h])
                            at, term = lookup(np.concatenate(h))
                            score = np.zeros(len(chosen), np.int64)
                            np.add.at(score, of[at], weights[term] * u[at])
                            some = score >= max(1, top.floor[0])
                            top.add(np.zeros(some.sum(), np.int64), score[some], ids[chosen[some]])
        for group, best, _ in groups:
            for number, top in zip(group.numbers, best):
                if len(top.id):
                    yield pa.RecordBatch.from_pydict({"number": pa.array(np.full(len(top.id), number, np.int32)), "score": pa.array(top.score),
                                                      "id": pa.array(top.id, mask=top.id == NO_ID)})

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def rank_documents(docs: DataFrame, items: DataFrame, options: SearchOptions | None = None, id_column: str = "doc_id", text_column: str = "text",
                   item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of every item with a score above 0: item_id, rank, doc_id, score."""
    o, spark = options or SearchOptions(), docs.sparkSession
    store, schema = Store(spark, "search"), "item_id long, rank int, doc_id long, score long"
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    n = texts.select(term_count(F.col("text")).alias("n")).filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    asked = items.select(F.col(item_column).cast("long").alias("item"), F.col(item_text).cast("binary").alias("text"))
    pairs = store.save(asked.mapInArrow(item_terms, "item long, h long").distinct(), "items")
    n_pairs = pairs.count()
    if not n[0] or not n_pairs:
        return spark.createDataFrame([], schema)
    index = store.save(texts.withColumn("text", F.col("text").cast("binary")).mapInArrow(
        index_texts(n[0], n[1], o), "id long, scale int, sketch binary, hashes binary, impacts binary"), "index", "zstd")
    slices, found, context = -(-n_pairs // o.slice_terms), [], spark.sparkContext
    for number in range(slices):
        part = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == number).toArrow()
        if not part.num_rows:
            continue
        by_item: dict = {}
        for item, h in zip(part["item"].to_pylist(), part["h"].to_numpy().view(np.uint64)):
            by_item.setdefault(item, []).append(h)
        wanted = context.broadcast(np.unique(part["h"].to_numpy().view(np.uint64)))
        df = index.select("hashes").mapInArrow(frequencies(wanted), "h long, df long").groupBy("h").agg(F.sum("df").alias("df")).toArrow()
        known = dict(zip(df["h"].to_numpy().view(np.uint64).tolist(), df["df"].to_pylist()))
        names, groups = list(by_item), []
        for start in range(0, len(names), o.items_at_once):
            numbers = np.arange(start, min(start + o.items_at_once, len(names)))
            own = [np.array(by_item[names[i]], np.uint64) for i in numbers]
            hashes = np.unique(np.concatenate(own))
            weights = np.zeros((len(hashes), len(own)), np.int64)
            of_term = np.array([weight(n[0], known.get(h, 0)) for h in hashes.tolist()], np.int64)
            for column, h in enumerate(own):
                at = np.searchsorted(hashes, h)
                weights[at, column] = of_term[at]
            groups.append(Items(numbers, hashes, weights, weights.astype(np.float32)))
        met = index.mapInArrow(search_task(context.broadcast(groups), o), "number int, score long, id long")
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        best = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= o.k)
        named = spark.createDataFrame(list(enumerate(names)), "number int, item_id long")
        found.append(store.save(best.join(F.broadcast(named), "number").select("item_id", "rank", F.col("id").alias("doc_id"), "score"), "found"))
    store.keep(*found)
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out
