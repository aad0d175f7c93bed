"""Helpers shared by the operators of this folder: stored tables, word hashes, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.plans.storage import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LEAST = -(2**63 - 1)


#: For operators with many shuffles or large values: shuffle files go when a table is written, Arrow batches are cut by bytes.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


class Store:
    """Tables written below the shared checkpoint folder; a lost executor costs a re-read of them.

    ``settings`` hold while a table is written.
    """

    def __init__(self, spark: SparkSession, label: str, settings: dict[str, str] | None = None):
        self.spark, self.root = spark, f"{checkpoint_dir(spark)}/folioflow/{label}-{uuid.uuid4().hex}"
        self.number, self.paths, self.settings = 0, set(), settings or {}

    def save(self, df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
        self.number += 1
        path = f"{self.root}/{self.number}-{label}"
        before = {name: self.spark.conf.get(name) for name in self.settings}
        try:
            for name, value in self.settings.items():
                self.spark.conf.set(name, value)
            df.write.parquet(path, compression=compression)
        finally:
            for name, value in before.items():
                self.spark.conf.set(name, value)
        self.paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stored_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete tables of this store that nothing reads any more."""
        for df in frames:
            if df is not None and getattr(df, "stored_path", None) in self.paths:
                self.paths.remove(df.stored_path)
                path = self.spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *frames: DataFrame) -> None:
        """Delete all tables of this store but those that the result still reads."""
        kept = {df.stored_path for df in frames}
        for place in sorted(self.paths - kept):
            self.paths.remove(place)
            path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class WordHashes(dict):
    """Remembers the 64-bit hash of each word (bytes); forgets all when it holds ``bound`` words."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


class BestOf:
    """The ``k`` best (score falling, id rising) of every key, and the score a newcomer must reach."""

    def __init__(self, keys: int, k: int):
        self.k, self.floor = k, np.full(keys, LEAST, np.int64)
        self.key, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = np.concatenate([self.key, key]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        full = place == self.k - 1
        self.floor[key[full]] = score[full]
        stay = place < self.k
        self.key, self.score, self.id = key[stay], score[stay], ids[stay]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that their order is as good as random."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` or a longer one, such that no column of ``df`` starts with it, in any case."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def crc_mod(column: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``: the folds of the contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def components(edges: DataFrame, store: Store, a: str = "a", b: str = "b", rounds: int = 60, few: int = 100_000) -> DataFrame:
    """Connected components of ``edges``: (node, component), component the smallest node reachable.

    Alternates the large-star and small-star steps; every minimum is combined before the shuffle and
    stored before it is joined back, so that a node with any number of neighbours is split by the
    adaptive skew join. At most ``few`` edges are one partition: a round is one task and stores only its result.
    Ends when a round changes nothing; RuntimeError if ``rounds`` are not enough.
    """
    now = store.save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    mark, one = None, lambda df: df
    for _ in range(rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        alone = seen[0] <= few
        if alone:
            one = lambda df: df.coalesce(1)
        keep = (lambda df, label: df) if alone else store.save
        both = one(now.union(now.select("v", "u")))
        low = keep(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "low")
        large = keep(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        low2 = keep(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.join(low2, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = store.save(one(moved.union(low2.select("u", F.col("m").alias("v")))).distinct(), "stars")
        store.drop(now, low, large, low2)
        now = after
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    stars = one(now).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return stars.union(one(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


def chunks(frames: Iterable, rows: int):
    """Pandas frames cut to at most ``rows`` rows."""
    for frame in frames:
        for i in range(0, len(frame), rows):
            yield frame.iloc[i : i + rows]
