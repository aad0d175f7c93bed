import random
from pathlib import Path

import pytest

from folioflow.operators import similarity as S
from folioflow.plans.storage import checkpoint_dir, materialise


def sequential(forms, occurrences, threshold):
    """Visit occurrences one by one and keep leaders, as the definition says."""
    def score(a, b):
        if not a or not b or min(len(a), len(b)) / max(len(a), len(b)) < threshold:
            return 0.0
        return len(a & b) / len(a | b)

    leaders, assigned = [], []
    for form in occurrences:
        if any(f == form for f, _ in leaders):
            assigned.append(form)
            continue
        tried = sorted(enumerate(leaders), key=lambda il: (len(il[1][1]), il[0]))
        hit = next((f for _, (f, w) in tried if score(forms[form], w) >= threshold), None)
        if hit is None:
            leaders.append((form, forms[form]))
            hit = form
        assigned.append(hit)
    order = sorted(enumerate(leaders), key=lambda il: (len(il[1][1]), il[0]))
    matched = {
        f: f if any(f == g for g, _ in leaders) else next(g for _, (g, w) in order if score(ws, w) >= threshold)
        for f, ws in forms.items()}
    return [f for f, _ in leaders], assigned, matched


def corpus(seed, count, vocabulary, size):
    rng = random.Random(seed)
    forms, seen = {}, set()
    base = [f"w{i}" for i in range(vocabulary)]
    while len(forms) < count:
        if forms and rng.random() < 0.6:
            words = set(rng.choice(list(forms.values())))
            for _ in range(rng.randint(1, 3)):
                words ^= {rng.choice(base)}
        else:
            words = set(rng.sample(base, rng.randint(max(1, size - 4), size)))
        if words and frozenset(words) not in seen:
            seen.add(frozenset(words))
            forms[f"f{len(forms):03d}"] = words
    occurrences = list(forms) + [rng.choice(list(forms)) for _ in range(count // 2)]
    rng.shuffle(occurrences)
    return forms, occurrences


@pytest.mark.parametrize("seed,threshold,group,vocabulary,size", [
    (2, 0.7, 64, 25, 10), (3, 0.6, 4, 18, 8), (6, 0.5, 3, 10, 3)])
def test_leaders_equal_visiting_one_by_one(spark, monkeypatch, seed, threshold, group, vocabulary, size):
    """Small groups force the crowded path, where no group's pairs are listed."""
    monkeypatch.setattr(S, "PAIR_GROUP", group)
    forms, occurrences = corpus(seed, 60 if group == 64 else 22, vocabulary, size)
    want_leaders, want_scan, want_match = sequential(forms, occurrences, threshold)
    first = {f: occurrences.index(f) for f in forms}
    table = materialise(spark.createDataFrame(
        [(f, first[f], sorted(ws)) for f, ws in forms.items()], "form string, rank int, words array<string>"), "forms")
    clusters = S.leader_clusters(table, threshold)
    assert {r.form for r in clusters.leaders.collect()} == set(want_leaders)
    sections = spark.createDataFrame([(i, f) for i, f in enumerate(occurrences)], "rank int, form string")
    got = S.assign(sections, clusters).orderBy("rank").collect()
    assert [r.scan_fp for r in got] == want_scan
    assert {r.form: r.match_fp for r in got} == {f: want_match[f] for f in set(occurrences)}


def test_partitioning_does_not_matter(spark):
    forms, occurrences = corpus(9, 60, 30, 12)
    rows = [(f, i, sorted(ws)) for i, (f, ws) in enumerate(forms.items())]
    results = []
    for parts in (1, 16):
        table = materialise(spark.createDataFrame(rows, "form string, rank int, words array<string>").repartition(parts), "forms")
        clusters = S.leader_clusters(table, 0.7)
        results.append((sorted(r.form for r in clusters.leaders.collect()),
                        sorted((r.form, r.leader) for r in clusters.links.collect())))
    assert results[0] == results[1]


def test_many_near_copies_form_one_cluster(spark):
    """A third of all texts being copies with small changes costs no more than one link each."""
    base = [f"w{i}" for i in range(40)]
    rows = [(f"c{i:03d}", i, base + [f"x{i}"]) for i in range(200)]
    rows += [(f"o{i:03d}", 1000 + i, [f"o{i}_{j}" for j in range(30)]) for i in range(400)]
    table = materialise(spark.createDataFrame(rows, "form string, rank int, words array<string>"), "forms")
    clusters = S.leader_clusters(table, 0.85)
    assert clusters.leaders.count() == 401
    links = clusters.links.collect()
    assert len(links) == 199 and {r.leader for r in links} == {"c000"}


def test_dissimilar_texts_of_common_words_take_few_rounds(spark, monkeypatch, count=4000):
    """Every text shares its rarest words with many others and is similar to none."""
    rng, rounds, fronts = random.Random(count), [], S._fronts
    monkeypatch.setattr(S, "_fronts", lambda *args: rounds.append(1) or fronts(*args))
    monkeypatch.setattr(S, "PAIR_GROUP", 16)
    base = [f"w{i:02d}" for i in range(80)]
    rows = [(f"f{i:04d}", i, rng.sample(base, 40)) for i in range(count)]
    table = materialise(spark.createDataFrame(rows, "form string, rank int, words array<string>"), "forms")
    clusters = S.leader_clusters(table, 0.85)
    assert clusters.leaders.count() == count and clusters.links.count() == 0 and 0 < len(rounds) < 10


def test_bitmaps_leave_few_pairs_and_lose_none(spark, monkeypatch):
    checked, verify = [], S.verify
    monkeypatch.setattr(S, "verify", lambda pairs, *args: checked.append(pairs.count()) or verify(pairs, *args))
    rng = random.Random(4)
    base = [f"w{i:02d}" for i in range(120)]
    sets = [rng.sample(base, 60) for _ in range(150)]
    sets += [[*s[:57], "x", "y"] for s in sets[:40]]
    rows = [(f"f{i:03d}", i, s) for i, s in enumerate(sets)]
    table = materialise(spark.createDataFrame(rows, "form string, rank int, words array<string>"), "forms")
    links = {(r.form, r.leader) for r in S.leader_clusters(table, 0.85).links.collect()}
    assert links == {(f"f{150 + i:03d}", f"f{i:03d}") for i in range(40)}
    assert sum(checked) < 200  # of 17,955 pairs


def test_links_walked_in_rounds_equal_links_walked_at_once(spark, monkeypatch):
    rng = random.Random(6)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}
    edges = materialise(spark.createDataFrame([(f"f{a}", f"f{b}", a, b) for a, b in pairs], "a string, b string, a_rank int, b_rank int"), "edges")
    gone = set()
    for a, b in sorted(pairs, key=lambda p: (p[1], p[0])):
        gone |= {b} if a not in gone else set()
    for most in (10_000, 5):
        monkeypatch.setattr(S, "SOLVED_AT_ONCE", most)
        assert {r.form for r in S._decide(edges).collect()} == {f"f{i}" for i in gone}


def test_texts_stay_in_place_when_pairs_meet_them(spark):
    from folioflow.operators.deflate import with_peer_group
    from folioflow.plans.storage import materialise_by

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = [(f"f{i}", i, [f"w{j}" for j in range(i % 7, i % 7 + 9)]) for i in range(60)]
    forms = materialise_by(spark.createDataFrame(rows, "form string, rank long, words array<string>"), "form", "forms")
    pairs = spark.createDataFrame([("f0", "f7"), ("f0", "f1")], "a string, b string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = S.verify(pairs, forms, 0.85)
        assert plan(found).count("Exchange hashpartitioning") == 2  # the pairs, once per side
        assert [(r.a, r.b) for r in found.collect()] == [("f0", "f7")]
        docs = spark.createDataFrame([("d", "e1", "t"), ("d2", "e2", "u")], "doc string, entity string, text string")
        grouped = with_peer_group(docs, spark.createDataFrame([("e1", "F1")], "entity string, grp string"))
        assert "hashpartitioning" not in plan(grouped) and {r.doc: r.grp for r in grouped.collect()} == {"d": "F1", "d2": "E2"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("cells,group", [(1 << 24, 64), (16, 3)])
def test_a_sketch_of_the_frequencies_loses_no_pair_and_no_table_stays(spark, monkeypatch, cells, group):
    """No word is common enough to be known exactly, and in 16 cells nearly all frequencies are mixed."""
    monkeypatch.setattr(S, "COMMON_WORDS", 1)
    monkeypatch.setattr(S, "SKETCH_CELLS", cells)
    monkeypatch.setattr(S, "PAIR_GROUP", group)
    forms, _ = corpus(7, 40, 60, 12)
    rows = [(f, i, sorted(ws) + [f"only-{f}"]) for i, (f, ws) in enumerate(forms.items())]
    want, _, _ = sequential({f: set(ws) for f, _, ws in rows}, list(forms), 0.6)
    table = materialise(spark.createDataFrame(rows, "form string, rank int, words array<string>"), "forms")
    heads = S.rare_first(table, 0.6)
    if cells > 16:  # a word of one text only takes its place in the prefix and is no candidate
        alone = {r[0] for r in spark.createDataFrame([(f"only-{f}",) for f in forms], "w string").selectExpr("xxhash64(w)").collect()}
        assert not alone & {h for r in heads.collect() for h in r.head}
    folder = Path(checkpoint_dir(spark)) / "folioflow"
    before = set(folder.iterdir())
    clusters = S.leader_clusters(table, 0.6)
    assert sorted(r.form for r in clusters.leaders.collect()) == sorted(want)
    assert len(set(folder.iterdir()) - before) == 2  # leaders and links
