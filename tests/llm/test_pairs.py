"""Jaccard join, near-duplicate vectors, nearest neighbours: against brute force."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from folioflow.llm.collision_dedup import CollisionOptions, calibrate, near_duplicates
from folioflow.llm.jaccard_join import JoinOptions, jaccard_components
from folioflow.llm.permutation_index import IndexOptions, nearest

DOCS = "doc_id long, text string, n string, component string"


def shingles(text, k):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def smallest(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def brute_jaccard(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = []
    for x in ids:
        for y in ids:
            shared = len(sets[x] & sets[y])
            if x < y and shared and 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
                links.append((x, y))
    group = smallest(ids, links)
    return {i: (len(sets[i]), group[i]) for i in ids}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("crowded", [24, 3])
@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, crowded, k, percent):
    rng = random.Random(k)
    rows, base = [], [f"b{i}" for i in range(90)]
    rows += [(i, edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 5, 9]))) for i in range(70)]
    rows += [(100 + i, " ".join(f"u{rng.randrange(400)}" for _ in range(rng.randrange(1, 40)))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \t\x0b"), (203, "One"), (204, "one"), (205, "A b"), (206, "É b"), (207, "a B"), (208, "É B")]
    rows += [(300 + i, "common words that stand in every text " + " ".join(f"x{i}y{j}" for j in range(12))) for i in range(30)]
    rows.append((3, rows[3][1]))  # a repeated row
    df = spark.createDataFrame([(i, t, "n", "c") for i, t in rows], DOCS)
    got = jaccard_components(df, JoinOptions(words=k, percent=percent, crowded=crowded, leader_rounds=4)).collect()
    want = brute_jaccard(rows, k, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_join_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d", "", ""), (5, "a b c d", "", "")], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == {None: (2, None), 5: (2, 5)}
    assert jaccard_components(df.limit(0)).count() == 0


def test_texts_with_enough_own_shingles_need_no_crowded_list(spark, monkeypatch):
    from folioflow.llm import jaccard_join

    passage, rows, lists = " ".join(f"p{i}" for i in range(40)), [], []
    rows += [(i, passage + " " + " ".join(f"o{i}x{j}" for j in range(5))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + f" end{i}") for i in range(3)]
    through = jaccard_join.through_leaders
    monkeypatch.setattr(jaccard_join, "through_leaders", lambda crowds, *rest: lists.append(crowds.count()) or through(crowds, *rest))
    df = spark.createDataFrame([(i, t, "n", "c") for i, t in rows], DOCS)
    got = jaccard_components(df, JoinOptions(crowded=24)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_jaccard(rows, 3, 90)
    assert lists == [0]


@pytest.mark.parametrize("own_share", [0.1, 100])
def test_sets_of_common_shingles_end_in_few_rounds_and_labels_join_sets_only(spark, monkeypatch, own_share):
    from folioflow.llm import jaccard_join

    rng, base, rows, saved, labelled = random.Random(5), [f"b{i}" for i in range(60)], [], [], []
    passages = [" ".join(f"p{i}x{j}" for j in range(8)) for i in range(40)]
    rows += [(i, edited(rng, base, 1)) for i in range(30)]
    rows += [(100 + i, " ".join(passages[k] for k in sorted(rng.sample(range(40), 14)))) for i in range(60)]
    rows += [(200 + i, rows[30 + i][1] + " end") for i in range(4)]
    save, label = jaccard_join.Store.save, jaccard_join.with_label
    monkeypatch.setattr(jaccard_join.Store, "save", lambda self, df, name, *rest: saved.append(name) or save(self, df, name, *rest))
    monkeypatch.setattr(jaccard_join, "with_label", lambda df, labels: labelled.append((labels is not None, "token" in df.columns)) or label(df, labels))
    df = spark.createDataFrame([(i, t, "n", "c") for i, t in rows], DOCS)
    got = jaccard_components(df, JoinOptions(crowded=6, cheap=2, own_share=own_share)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_jaccard(rows, 3, 90)
    assert saved.count("seen") <= 2
    assert (True, False) in labelled and (True, True) not in labelled


def strayed(rng, copies, gaps, twins):
    """Copies of a text, too far from it and from each other to link, and twins of some of them."""
    base, rows = [f"b{i}" for i in range(150)], []
    rows += [(i, edited(rng, base, rng.randrange(2))) for i in range(30)]
    rows += [(100 + i, edited(rng, base, rng.choice([4, 4, 5, 6]))) for i in range(copies)]
    for i in range(gaps):  # words left out: the same new shingles in several texts
        gone = set(rng.sample(range(150), 5))
        rows.append((10_000 + i, " ".join(w for j, w in enumerate(base) if j not in gone)))
    return rows + [(20_000 + i, edited(rng, rows[30 + rng.randrange(copies)][1].split(), rng.randrange(1, 4))) for i in range(twins)]


def test_strayed_copies_make_few_pairs(spark, monkeypatch):
    from folioflow.llm import jaccard_join

    made, cross = [], jaccard_join.cross_pairs
    monkeypatch.setattr(jaccard_join, "cross_pairs", lambda lists, o: (lambda df: made.append(df.count()) or df)(cross(lists, o)))
    df = spark.createDataFrame([(i, t, "n", "c") for i, t in strayed(random.Random(7), 400, 0, 0)], DOCS)
    jaccard_components(df, JoinOptions(words=5, percent=80, crowded=20, needy_share=1, own_share=100)).count()
    print("pairs", made)
    assert len(made) == 1 and made[0] <= 430


@pytest.mark.parametrize("cheap", [0, 10])
def test_strayed_copies_equal_brute_force(spark, cheap):
    rng = random.Random(11)
    rows = strayed(rng, 70, 20, 50)
    far = [f"c{i}" for i in range(110)] + [f"b{i}" for i in range(30)]  # a second group, sharing a passage
    rows += [(30_000 + i, edited(rng, far, rng.choice([0, 1, 3, 4, 5]))) for i in range(60)]
    rows += [(40_000 + i, " ".join(f"b{j}" for j in range(i, 150))) for i in range(0, 60, 2)]  # of all sizes
    df = spark.createDataFrame([(i, t, "n", "c") for i, t in rows], DOCS)
    got = jaccard_components(df, JoinOptions(words=5, percent=80, crowded=8, needy_share=1, own_share=100, cheap=cheap)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_jaccard(rows, 5, 80)


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(120, 16))
    near = base[:40] + 0.06 * rng.normal(size=(40, 16))
    copies = np.repeat(base[:2], 15, axis=0)
    all_rows = np.vstack([base, near, copies, 3 * base[5:6]]).astype(np.float32).astype(float)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(all_rows)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] * 16, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1e30] * 16]
    return rows + [(1000 + i, v) for i, v in enumerate(odd)]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block_rows", [4096, 20])
def test_near_duplicates_equal_brute_force(spark, block_rows):
    rows = vectors()
    ok = {i: np.array(v) for i, v in rows if usable(v)}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b])
             and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= 0.95]
    group = smallest([i for i, _ in rows], links)
    degree = {i: sum(i in pair for pair in links) for i, _ in rows}
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>").selectExpr("*", "1 as kept", "'x' as v")
    got = near_duplicates(df, CollisionOptions(block_rows=block_rows)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (degree[i], group[i], group[i] == i) for i, _ in rows}
    assert len(got) == len(rows)


def test_near_duplicates_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicates(empty).count() == 0 and nearest(empty, lambda i: i % 2 == 0).count() == 0


def test_window_and_count_keep_pairs_at_the_threshold():
    o = CollisionOptions()
    width, least = calibrate(o)
    rng = np.random.default_rng(1)
    gaps = np.abs(rng.normal(size=(20000, o.lines))) * np.sqrt(2 - 2 * o.cosine)
    inside = gaps <= width
    assert inside[:, : o.sorted_lines].any(axis=1).mean() > 0.997 and (inside.sum(axis=1) >= least).mean() > 0.997


def test_sides_keep_pairs_at_the_threshold_and_few_others():
    from folioflow.llm.collision_dedup import most_apart, sides

    o, rng = CollisionOptions(), np.random.default_rng(2)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 20000, 64)))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    near = o.cosine * x + np.sqrt(1 - o.cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    apart = [np.bitwise_count((sides(x, o) ^ sides(v, o)).view(np.uint64)) for v in (near, y)]
    assert (apart[0] <= most_apart(o)).mean() >= 0.9998 and (apart[1] <= most_apart(o)).mean() < 0.01


@pytest.mark.parametrize("shard_rows,query_rows", [(8192, 2048), (40, 3)])
def test_nearest_recall_and_ties(spark, shard_rows, query_rows):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 16)))]
    rows += [(2000 + i, rows[0][1]) for i in range(30)]  # ties go to the smaller id
    rows += [(5000 + i, v) for i, v in enumerate([None, [0.0] * 16, [float("nan")] * 16, [1.0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 as rank", "0 as score")
    o = IndexOptions(pivots=64, prefix=32, least=60, shard_rows=shard_rows, query_rows=query_rows)
    got = {}
    for r in nearest(df, lambda i: i % 20 == 0, o).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ok = {i: np.array(v) for i, v in rows if usable(v) and len(v) == 16}
    assert set(got) == {i for i in ok if i % 20 == 0}
    hits = total = 0
    for q, found in got.items():
        true = sorted((np.sqrt(((ok[q] - v) ** 2).sum()), i) for i, v in ok.items() if i != q)[:10]
        assert sorted(found) == list(range(1, 11))
        for vec, score in found.values():
            assert score == np.sqrt(((ok[q] - ok[vec]) ** 2).sum())
        assert [found[r] for r in range(1, 11)] == sorted(found.values(), key=lambda x: (x[1], x[0]))
        hits += len({v for v, _ in found.values()} & {i for _, i in true})
        total += 10
    assert hits / total >= 0.9
    assert [got[0][r][0] for r in range(1, 11)] == list(range(2000, 2010))


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in nearest(df, lambda i: i % 100 == 0).orderBy("rank").collect()] == [(1, 3), (2, 1)]


def test_components_do_not_end_early(spark):
    from folioflow.llm.common import Store, components

    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components(chain, Store(spark, "chain")).collect()} == {0}
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        components(chain, Store(spark, "chain"), rounds=1)


def test_components_of_few_and_many_edges_are_equal(spark):
    from folioflow.llm.common import Store, components

    rng = random.Random(2)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    edges, want = spark.createDataFrame(pairs, "a long, b long"), smallest(range(120), pairs)
    for few in (0, 100_000):
        saved = Store(spark, "few")
        got = {r.node: r.component for r in components(edges, saved, few=few).collect()}
        assert got == {i: want[i] for i in {n for p in pairs if p[0] != p[1] for n in p}}
        assert saved.number <= 10 or not few


def test_copies_of_vectors_leave_a_task_in_small_batches(monkeypatch):
    from folioflow.llm import collision_dedup as C

    class Projected:
        def mapInPandas(self, run, schema):
            return run

    o, rows = CollisionOptions(block_rows=10, most_rows=20), 300
    frame = pd.DataFrame({"id": range(rows), "c": 1, "dim": 2, "v": [b"v"] * rows, "p": [b"p"] * rows, "bits": 0, "cells": [[0, 0, 0]] * rows})
    monkeypatch.setattr(C, "SENT_ROWS", 500)
    sizes = {(2, t, s): rows for t in range(3) for s in (-1, 0, 1)}
    sent = list(C.block_pairs(Projected(), sizes, o)(iter([frame])))
    assert max(len(f) for f in sent) < 600 and sum(len(f) for f in sent) > 20 * rows
    assert max(f["i"].max() for f in sent) == 14  # 300 rows of a cell in blocks of 20, the bound, and not in 8 blocks
    wide = C.block_pairs(Projected(), sizes, CollisionOptions(block_rows=10))(iter([frame]))
    assert max(f["i"].max() for f in wide) == C.BLOCKS_IN_A_CELL - 1
