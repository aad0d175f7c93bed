"""Hard negatives, ranked search and decontamination: against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.llm.decontamination import LeakOptions, decontaminate, find_leaks
from folioflow.llm.hard_negatives import MiningOptions, mine_negatives
from folioflow.llm.ranked_search import SearchOptions, coordinates, rank_documents, sketch_of, terms

VECTORS = "vec_id long, embedding array<double>, label int, slot int, score long, id long"


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute_negatives(rows, anchors):
    table, out = {}, set()
    for i, v, label, *_ in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(
            x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], r[1])):
        table.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    for a in sorted(i for i in table if anchors(i)):
        label, v = table[a]
        scored = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i, other == label)
                        for i, (other, w) in table.items() if i != a and len(w) == len(v))
        for p_score, p, _ in [s for s in scored if s[2]][:5]:
            fits = [(n, i) for n, i, same in scored if not same and 30 * -p_score <= 100 * -n <= 90 * -p_score]
            out |= {(a, p, rank, i, -p_score, -n) for rank, (n, i) in enumerate(fits[:10], 1)}
    return out


def negatives(spark, rows, **options):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = mine_negatives(df, lambda i: i % 10 == 0, MiningOptions(**options))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("options", [{}, {"pass_anchors": 12, "cells": 40}])
def test_negatives_equal_brute_force(spark, options):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.3, 0.0, 0.1, 0.2, 0.5]) for _ in range(6)], rng.randrange(3), 1, 2, 3) for i in range(150)]
    rows += [(i, [rng.gauss(0.2, 0.3) for _ in range(6)], 0, 1, 2, 3) for i in range(150, 220)]  # a hot label
    rows += [(220, [0.1, 0.2], 0, 0, 0, 0), (221, [0.3, 0.1], 0, 0, 0, 0), (222, [0.2, 0.1], 1, 0, 0, 0), (230, None, 1, 0, 0, 0),
             (240, [0.1, None] * 3, 1, 0, 0, 0), (250, [float("nan")] * 6, 1, 0, 0, 0), (260, [float("inf")] * 6, 1, 0, 0, 0),
             (270, [0.5] * 6, None, 0, 0, 0), (None, [0.5] * 6, 1, 0, 0, 0), (280, [0.0] * 6, 1, 0, 0, 0), (290, [], 1, 0, 0, 0),
             (291, [], 1, 0, 0, 0), (292, [], 2, 0, 0, 0), (20, [0.9] * 6, 1, 0, 0, 0), rows[30], rows[30]]
    got = negatives(spark, rows, **options)
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_huge_components_and_without_rows(spark):
    rows = [(i, [10.0 ** (i % 9 + 3), 1.0], i % 3, 0, 0, 0) for i in range(60)] + [(60, [1e300, 1.0], 0, 0, 0, 0), (63, [1e300, 2.0], 0, 0, 0, 0)]
    assert set(negatives(spark, rows)) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert negatives(spark, []) == [] and negatives(spark, [(1, [1.0], 1, 0, 0, 0)]) == []


def brute_ranking(docs, items, k):
    found = [(i, Counter(terms(t.encode()))) for i, t in docs if t and terms(t.encode())]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms((t or "").encode()))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in found:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            scores += [(-s, i is None, i)] * (s > 0)
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [SearchOptions(k=5), SearchOptions(k=7, slice_terms=80, items_at_once=2, block_rows=16, rescored_at_once=3, spread=1)])
def test_ranking_equals_brute_force(spark, options):
    rng = random.Random(3)
    common, rare = [f"w{i}" for i in range(30)], [f"r{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(n))
    docs = [(i, say(rng.choice([1, 5, 40, 300]))) for i in range(200)]
    docs += [(200, None), (201, ""), (202, " -- "), (203, "ÄRGER Straße été 42 w1"), (204, "ärger W1"), (None, "w1 w2 w3 only here"), (17, "w1 w2"),
             (17, "w1 w2"), (205, "W1\x00w2_w3.w4"), (206, "long " * 50_000 + "w5")] + [(300 + i, "w7 w8 r1") for i in range(40)]
    items = [(i, say(20)) for i in range(12)] + [(20, None), (21, "--"), (22, "w1 w1 W1"), (23, "ÄRGER straße"), (24, "w5 long"), (25, "nowhere"),
                                               (26, "w7"), (26, "w8"), (None, "w9 w10"), (27, docs[5][1])]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, rank int, score long").repartition(4)
    got = rank_documents(df, spark.createDataFrame(items, "item_id long, text string"), options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_ranking(docs, items, options.k)


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rank_documents(docs.limit(0), items).count() == 0 and rank_documents(docs, items.limit(0)).count() == 0


def test_sketch_bounds_every_impact():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 7, 900):
        hashes, impacts = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(1, 1_000_000, n)
        scale, sketch = sketch_of(hashes, impacts, 10)
        seen = np.frombuffer(sketch, np.uint8)
        bound = scale * np.min([seen[at] for at in coordinates(hashes, len(seen))], axis=0).astype(np.int64)
        assert (bound >= impacts).all() and len(sketch) <= 16 * max(n, 4)


def brute_leaks(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    named |= windows[tuple(w[j : j + n])] - {None}
        rest = " ".join(x for j, x in enumerate(w) if j not in hit) if hit else t
        out.append((i, len(w), len(hit), len(named), sorted(map(str, named)), bool(hit), rest))
    return out


@pytest.mark.parametrize("options", [LeakOptions(), LeakOptions(slice_pairs=7)])
def test_leaks_equal_brute_force(spark, options):
    rng = random.Random(8)
    say = lambda n, of=60: " ".join(rng.choice("abcdefghij") + str(rng.randrange(of)) for _ in range(n))
    items = [(i, say(25)) for i in range(9)] + [(9, say(9)), (10, "Zebra"), (11, None), (12, "--"), (None, say(12)), (30, "Ümläut ÉTÉ " + say(9)), (40, say(3) + " " * 5)]
    items += [(13, items[0][1]), (2, say(14))]
    plant = lambda i: items[i][1].upper().replace(" ", " ,\n")
    docs = [(i, say(40) + " " + plant(rng.randrange(len(items) - 7)) + ". " + say(rng.randrange(30))) for i in range(25)]
    docs += [(100, None), (101, ""), (102, "..."), (103, "the zebra, ZEBRA"), (104, " ".join(items[1][1].split()[3:14])), (105, " ".join(items[1][1].split()[3:12])),
             (106, (say(40) + " zebra ") * 900 + items[3][1]), (107, items[4][1] * 3), (None, items[5][1]), (None, "no leak"), (108, items[0][1]), (108, items[0][1]),
             (108, items[6][1] + " tail"), (109, items[13][1] + " x " + items[14][1]), (110, "été " + items[14][1].replace("ÉTÉ", "été"))]
    docs += [(200 + i, f"head{i} " + items[7][1]) for i in range(60)]  # a passage in many documents
    df = spark.createDataFrame([(i, t, "mine", 5, ["x"]) for i, t in docs], "doc_id long, text string, row string, n_hit int, items array<string>").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_leaks(df, bench, options)
    want = brute_leaks(docs, items)
    key = lambda r: tuple(map(str, r))
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()]
    assert sorted(got, key=key) == sorted((w[:6] for w in want), key=key)
    assert found.filter("row = 'mine'").count() == len(docs)
    cut = [(r.doc_id, r.text) for r in decontaminate(df, bench, options=options).collect()]
    assert sorted(cut, key=key) == sorted(((w[0], w[6]) for w in want), key=key)
    assert decontaminate(df, bench, whole=True, options=options).count() == sum(not w[5] for w in want)


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert find_leaks(docs.limit(0), items).count() == 0
    row = find_leaks(docs, items.limit(0)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
    assert find_leaks(docs, items).select(F.sum("n_hit")).first()[0] == 1


def test_native_path_has_no_python(spark, capsys):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    find_leaks(docs, items).explain()
    assert "Python" not in capsys.readouterr().out
