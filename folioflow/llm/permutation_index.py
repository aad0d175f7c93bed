"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``prefix`` nearest pivots in order. The index is a table of shards of at
most ``shard_rows`` vectors, dealt by the hash of the id. Within a shard the vectors are posted in one inverted file per
pivot with their rank of it. A query walks the files of its own nearest pivots, which gives the footrule
distance of the two prefixes (an absent pivot counts as rank ``prefix``); the ``share`` of the shard with
the smallest footrule is reranked by the exact Euclidean distance in double precision, and the best of all
shards are the result. Query blocks meet every shard, so neither side is ever broadcast or gathered whole.

``tests/llm`` measures recall against brute force; README states the measured values.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither
do those whose length differs from the pivots' (the commonest length); a repeated vec_id is one vector; ties go to the smaller
vec_id; fewer candidates than ``k`` are all returned; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.common import Store
from folioflow.llm.vectors import distinct_vectors, matrix


@dataclass(frozen=True)
class IndexOptions:
    """``pivots`` vectors with the smallest id hashes are the pivots: the only part fitted on a sample."""

    k: int = 10
    pivots: int = 256
    prefix: int = 64
    share: float = 0.15
    least: int = 400
    shard_rows: int = 8192
    query_rows: int = 2048


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each row, nearest first, ties to the smaller pivot number."""
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    return np.argsort(d, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def permutations(vectors: DataFrame, pivots: np.ndarray, o: IndexOptions) -> DataFrame:
    """(id, v binary, order binary): packed vector and its ordered nearest pivots."""

    def run(frames):
        for frame in frames:
            frame = frame[frame["v"].map(len) == pivots.shape[1]]
            if len(frame):
                x = matrix(frame["v"])
                yield pd.DataFrame({"id": frame["id"], "v": [r.tobytes() for r in x],
                                    "order": [r.tobytes() for r in orders(x, pivots, o.prefix)]})

    return vectors.mapInPandas(run, "id long, v binary, order binary")


def search_shard(dim: int, prefix: int, n_pivots: int, o: IndexOptions):
    def run(key, shard, queries):
        out = []
        shard = shard.sort_values("id")
        ids = shard["id"].to_numpy()
        x = np.frombuffer(b"".join(shard["v"]), np.float64).reshape(-1, dim)
        order = np.frombuffer(b"".join(shard["order"]), np.int16).reshape(-1, prefix)
        by_pivot = np.argsort(order.ravel(), kind="stable")
        ends = np.searchsorted(order.ravel()[by_pivot], np.arange(n_pivots + 1))
        rows, ranks = by_pivot // prefix, by_pivot % prefix
        absent = np.full(len(ids), prefix * (prefix + 1) // 2, np.int32)  # the shard's own pivots, all unmatched
        size = min(len(ids), max(o.least, int(np.ceil(o.share * len(ids)))))
        for qid, qv, qo in zip(queries["id"], queries["v"], queries["order"]):
            q = np.frombuffer(qv, np.float64)
            foot = absent + prefix * (prefix + 1) // 2
            for rank, pivot in enumerate(np.frombuffer(qo, np.int16)):
                at = slice(ends[pivot], ends[pivot + 1])
                r = ranks[at]
                foot[rows[at]] += (np.abs(r - rank) - (prefix - r) - (prefix - rank)).astype(np.int32)
            near = np.argpartition(foot, size - 1)[:size] if size < len(ids) else np.arange(len(ids))
            if size < len(ids):  # ties at the cut go to the smaller id
                cut = foot[near].max()
                sure, tied = np.nonzero(foot < cut)[0], np.nonzero(foot == cut)[0]
                near = np.concatenate([sure, tied[: size - len(sure)]])
            near = near[ids[near] != qid]
            with np.errstate(over="ignore"):
                d = np.sqrt(((x[near] - q) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], d))[: o.k]
            out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[near[best]], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def nearest(table: DataFrame, is_query, options: IndexOptions | None = None, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors found of every vector for which ``is_query(id)`` holds: query_id, rank, vec_id, score."""
    o, spark = options or IndexOptions(), table.sparkSession
    store = Store(spark, "permutations")
    vectors = store.save(distinct_vectors(table, id_column, vector_column).filter("ok").select("id", "v"), "vectors")
    schema = "query_id long, vec_id long, score double"
    common = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = (vectors.filter(F.size("v") == common["d"]).orderBy(F.xxhash64("id"), "id").limit(o.pivots).select("v").collect())
    pivots = np.unique(np.array([r["v"] for r in fitted]), axis=0)
    prefix = min(o.prefix, len(pivots))
    index = store.save(permutations(vectors, pivots, o), "index")
    store.keep(index)
    n = index.count()
    queries = index.filter(is_query(F.col("id")))
    shards, blocks = -(-n // o.shard_rows), max(1, -(-queries.count() // o.query_rows))
    numbered = lambda df, count: F.pmod(F.xxhash64("id", F.lit(7)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = index.withColumn("shard", numbered(index, shards)).withColumn("block", every(blocks))
    right = queries.withColumn("block", numbered(queries, blocks)).withColumn("shard", every(shards))
    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        search_shard(int(common["d"]), prefix, len(pivots), o), schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= o.k).select("query_id", "rank", "vec_id", "score")
