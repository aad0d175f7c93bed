"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on random lines. The first ``sorted_lines`` projections are sorted into
cells as wide as the query window; a pair meets where their projections on such a line differ by a
window or less, and only on the first line for which this holds. For the pairs that meet, window collisions
are counted over all ``lines``; those with at least the calibrated count are verified by the exact cosine. The
window and the count are chosen from the wished recall at the threshold itself; closer pairs have more.
Before that, collisions are counted over the sides of zero on which two vectors lie on further lines, kept as the bits
of one number: nearly all unrelated pairs end there, after one comparison of two numbers.

Equal vectors are one class from the start. A cell of any size is split into blocks by the hash of the id
and handled as pairs of blocks, so a task holds three blocks at most; blocks grow with the largest cell up to a bound, so that a
vector is sent a bounded number of times until then, and copies leave a task in small batches. Tasks return sums of links per vector and a spanning
forest of their links, never the pairs. The work is quadratic in the size of a cell: a window on a
line holds a fixed share of dissimilar vectors, which is a property of the method.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths never link; a repeated vec_id is one vector (the smallest array), returned
once; a null vec_id links with nothing and has no component; extra columns are ignored; ties cannot arise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Store, components
from folioflow.llm.vectors import distinct_vectors, matrix, unit


@dataclass(frozen=True)
class CollisionOptions:
    """``miss``: share of pairs at the threshold that each of the two filters may lose; the count of sides loses a thousandth of it.

    ``block_rows`` to ``most_rows`` bound what a task holds and do not change the result.
    """

    cosine: float = 0.95
    sorted_lines: int = 3
    lines: int = 14
    miss: float = 0.001
    block_rows: int = 4096
    most_rows: int = 16_384
    seed: int = 11


def normal_inside(z: float) -> float:
    return math.erf(z / math.sqrt(2))


def calibrate(o: CollisionOptions) -> tuple[float, int]:
    """Window half-width and least count.

    A pair at distance d differs by N(0, d^2) on a random line. The window makes the pair miss all
    sorted lines with probability ``miss``; the count is the largest that loses ``miss`` at most.
    """
    inside = 1 - o.miss ** (1 / o.sorted_lines)
    low, high = 0.0, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_inside(mid) < inside else (low, mid)
    distance = math.sqrt(max(2 - 2 * o.cosine, 1e-12))
    lost, least = 0.0, 0
    for k in range(o.lines + 1):
        lost += math.comb(o.lines, k) * inside**k * (1 - inside) ** (o.lines - k)
        if lost > o.miss:
            break
        least = k + 1
    return high * distance, least


def lines_of(dim: int, o: CollisionOptions) -> np.ndarray:
    return np.random.default_rng([o.seed, dim]).standard_normal((dim, o.lines))


SIDES = 64
BLOCKS_IN_A_CELL = 8
SENT_ROWS = 10_000  # copies of vectors that leave a task at a time


def sides(x: np.ndarray, o: CollisionOptions) -> np.ndarray:
    """One number for each row: its sides of zero on 64 random lines."""
    lines = np.random.default_rng([o.seed, x.shape[1], SIDES]).standard_normal((x.shape[1], SIDES))
    return np.packbits(x @ lines >= 0, axis=1).view(np.int64).ravel()


def most_apart(o: CollisionOptions) -> int:
    """The number of different sides that a pair at the threshold exceeds with a probability of ``miss`` / 1000 at most.

    The sides of a pair differ on a random line with probability angle / pi.
    """
    differ, left = math.acos(o.cosine) / math.pi, 1.0
    for k in range(SIDES):
        left -= math.comb(SIDES, k) * differ**k * (1 - differ) ** (SIDES - k)
        if left <= o.miss / 1000:
            return k
    return SIDES


def project(classes: DataFrame, width: float, o: CollisionOptions) -> DataFrame:
    """(id, c, dim, v, p, bits, cells): packed unit vectors, sorted projections, sides and cells."""

    def run(frames):
        for frame in frames:
            sizes = frame["v"].map(len)
            for dim, part in frame.groupby(sizes.to_numpy()):
                x = unit(matrix(part["v"]))
                p = (x @ lines_of(int(dim), o))[:, : o.sorted_lines]
                yield pd.DataFrame({
                    "id": part["id"], "c": part["c"], "dim": int(dim), "v": [r.tobytes() for r in x],
                    "p": [r.tobytes() for r in p], "bits": sides(x, o), "cells": list(np.floor(p / width).astype(np.int32))})

    return classes.mapInPandas(run, "id long, c long, dim int, v binary, p binary, bits long, cells array<int>")


def block_pairs(projected: DataFrame, sizes: dict, o: CollisionOptions) -> DataFrame:
    """Rows sent to pairs of blocks: side 0 is the left block, 1 another of its cell, 2 one of the next."""

    rows_in_a_block = min(max(o.block_rows, -(-max(sizes.values(), default=0) // BLOCKS_IN_A_CELL)), max(o.block_rows, o.most_rows))

    def blocks(dim, t, cell):
        return -(-sizes.get((dim, t, cell), 0) // rows_in_a_block)

    def packed(frame, at, rows):
        out = frame.iloc[at][["id", "c", "v", "p", "bits"]].reset_index(drop=True)
        return pd.concat([pd.DataFrame(rows, columns=["dim", "t", "cell", "i", "j", "side"], dtype=np.int32), out], axis=1)

    def run(frames):
        for frame in frames:
            at, rows = [], []
            for n, (i, dim, cells) in enumerate(zip(frame["id"], frame["dim"], frame["cells"])):
                mix = ((int(i) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> 20
                for t, cell in enumerate(cells):
                    here, after, before = (blocks(dim, t, cell + s) for s in (0, 1, -1))
                    b = mix % max(here, 1)
                    for j in range(max(here, after)):
                        at.append(n), rows.append((dim, t, cell, b, j, 0))
                    for j in range(b):
                        at.append(n), rows.append((dim, t, cell, j, b, 1))
                    for j in range(before):
                        at.append(n), rows.append((dim, t, cell - 1, j, b, 2))
                    if len(at) >= SENT_ROWS:
                        yield packed(frame, at, rows)
                        at, rows = [], []
            yield packed(frame, at, rows)

    return projected.mapInPandas(
        run, "dim int, t int, cell int, i int, j int, side int, id long, c long, v binary, p binary, bits long")


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (a, b)."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def match(width: float, least: int, most: int, o: CollisionOptions):
    """For a pair of blocks: (id, other, k): links of ``id`` by its partners' sizes, or a forest link."""

    def run(key, frame):
        dim, t, i, j = int(key[0]), int(key[1]), int(key[3]), int(key[4])
        frame = frame.sort_values("side", kind="stable")
        side, ids, c = frame["side"].to_numpy(), frame["id"].to_numpy(), frame["c"].to_numpy()
        x = np.frombuffer(b"".join(frame["v"]), np.float64).reshape(len(frame), dim)
        p = np.frombuffer(b"".join(frame["p"]), np.float64).reshape(len(frame), o.sorted_lines)
        n_left = int((side == 0).sum())
        first = 0 if i == j else n_left  # the block meets itself only in its own pair
        q = np.ascontiguousarray((x @ lines_of(dim, o))[:, o.sorted_lines :].T.astype(np.float32))
        links = np.zeros(len(ids), np.int64)
        forest = []
        bits = frame["bits"].to_numpy().view(np.uint64)
        for lo in range(0, n_left, 32):
            hi = min(lo + 32, n_left)
            start = max(first, lo) if i == j else first
            if start >= len(ids):
                break
            a, b = np.nonzero(np.bitwise_count(bits[lo:hi, None] ^ bits[None, start:]) <= most)
            a, b = a + lo, b + start
            meet = np.abs(p[a, t] - p[b, t]) <= width
            if i == j:  # inside the left block each pair once
                meet &= b > a
            a, b = a[meet], b[meet]
            meet, collisions = np.ones(len(a), bool), np.ones(len(a), np.int8)
            for s in range(o.sorted_lines):
                if s != t:
                    close = np.abs(p[a, s] - p[b, s]) <= width
                    if s < t:
                        meet &= ~close
                    collisions += close
            for s in range(len(q)):
                collisions += np.abs(q[s, a] - q[s, b]) <= np.float32(width)
            meet &= collisions >= least
            a, b = a[meet], b[meet]
            for k in range(0, len(a), 50_000):
                u, w = a[k : k + 50_000], b[k : k + 50_000]
                good = np.einsum("ij,ij->i", x[u], x[w]) >= o.cosine
                u, w = u[good], w[good]
                links += np.bincount(u, weights=c[w], minlength=len(ids)).astype(np.int64)
                links += np.bincount(w, weights=c[u], minlength=len(ids)).astype(np.int64)
                forest += spanning(u, w)
                if len(forest) > 4 * len(ids):
                    forest = spanning(*np.array(forest).T)
        some = np.nonzero(links)[0]
        e = np.array(spanning(*np.array(forest).T), dtype=np.int64) if forest else np.zeros((0, 2), np.int64)
        return pd.DataFrame({
            "id": np.concatenate([ids[some], ids[e[:, 0]]]), "k": np.concatenate([links[some], np.zeros(len(e), np.int64)]),
            "other": pd.array(np.concatenate([np.zeros(len(some), np.int64), ids[e[:, 1]]]), dtype="Int64"),
            "forest": np.arange(len(some) + len(e)) >= len(some)})

    return run


def near_duplicates(table: DataFrame, options: CollisionOptions | None = None, id_column: str = "vec_id",
                    vector_column: str = "embedding") -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    o, store = options or CollisionOptions(), Store(table.sparkSession, "collisions")
    width, least = calibrate(o)
    vectors = store.save(distinct_vectors(table, id_column, vector_column), "vectors")
    valid = vectors.filter("ok")
    classes = store.save(valid.groupBy("v").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("c")), "classes")
    projected = store.save(project(classes.withColumnRenamed("cid", "id"), width, o), "projected")
    cells = (projected.select("dim", F.posexplode("cells").alias("t", "cell")).groupBy("dim", "t", "cell")
             .agg(F.count(F.lit(1)).alias("n")).collect())  # lines times cells: at most a few hundred rows a dimension
    sizes = {(r["dim"], r["t"], r["cell"]): r["n"] for r in cells}
    found = store.save(
        block_pairs(projected, sizes, o).groupBy("dim", "t", "cell", "i", "j")
        .applyInPandas(match(width, least, most_apart(o), o), "id long, k long, other long, forest boolean"), "found")
    degree = found.filter("not forest").groupBy("id").agg(F.sum("k").alias("k"))
    labels = store.save(components(found.filter("forest").select(F.col("id").alias("a"), F.col("other").alias("b")), store), "labels")
    by_class = store.save(
        classes.select("v", "c", F.col("cid").alias("id")).join(degree, "id", "left")
        .join(labels.withColumnRenamed("node", "id"), "id", "left")
        .select("v", (F.col("c") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")), "by_class")
    store.keep(vectors, by_class)
    linked = valid.join(by_class, "v").select("id", "n_links", "component")
    rest = vectors.filter(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(rest).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
