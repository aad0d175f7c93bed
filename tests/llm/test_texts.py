"""Toxicity, substrings, languages, pieces, lines, pages, mixing and the pipeline."""

import hashlib
import random
import zlib

import pytest

import corpus_pipeline
from folioflow.llm import fm_dedup, html_text, language_id, line_dedup, mixing, piece_transducer, toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], DOCUMENTS)


# --- toxicity ---------------------------------------------------------------------------------------------
def test_grammar_marks_targets_negation_and_reports():
    machine = toxicity.grammar(toxicity.ToxicityOptions())
    symbols = toxicity.Symbols(frozenset({"idio"}), (4, 5))
    names = toxicity.PATTERNS

    def fired(text):
        f = toxicity.clause_features(text, symbols, machine)
        return {n for n, x in zip(names, f) if x}

    assert fired("What an IDIOT.") == {"insult"}
    assert fired("you idiots") == {"insult", "insult_target"}
    assert fired("he said you are no idiot") == {"insult", "insult_target", "insult_negated", "insult_reported"}
    assert fired("he said so. idiot") == {"insult"}
    assert fired("I will kill you; then") == {"threat"} and fired("you I kill") == {"threat", "threat_target"}
    assert fired("") == set() and fired(None) == set()


def toxic_rows(n=400):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "ba ke li mo nu".split() for b in "ra se ti vo".split()]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(40), "grumpf" + rng.choice(["ig", "en", ""]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out_accuracy_and_edges(spark):
    rows, labels = toxic_rows()
    rows += [(None, "x"), (900, None), (901, ""), (902, "grumpf " * 50_000), (3, rows[3][1])]
    docs = documents(spark, rows).selectExpr("*", "'mine' as score", "7 as extra")
    table = spark.createDataFrame(labels + [(5000, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, table).collect()
    assert len(got) == len(rows) and {r.extra for r in got} == {7} and all(0 <= r.score <= 1 for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].score == by_id[901].score and by_id[901].predicted == 0 and by_id[902].predicted == 1
    assert not by_id[None].held_out


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents(spark, [(1, "all is well"), (2, "I will kill you and you")])
    assert {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, none).collect()}[1] == 0
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


# --- substrings -------------------------------------------------------------------------------------------
def brute_cut(rows, window):
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, text in rows:
        words = (text or "").encode().split()
        gone = {s + j for s in range(len(words) - window + 1) if first[tuple(words[s : s + window])] < i for j in range(window)}
        out[i] = (len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode())
    return out


@pytest.mark.parametrize("hot", [2000, 2])
@pytest.mark.parametrize("window,gram", [(50, 16), (12, 4)])
def test_cut_repeats_equals_brute_force(spark, window, gram, hot):
    rng = random.Random(window)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(40):
        own = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            a, b = sorted(rng.sample(range(71), 2))
            own[len(own) // 2 : len(own) // 2] = passage[a:b]
        if i % 7 == 0:
            own = own + own  # repeats within a document stay
        rows.append((i, " ".join(own)))
    rows += [(100, rows[4][1]), (101, rows[4][1]), (102, None), (103, ""), (104, "x " * 400), (105, "x " * 300), (106, "é ü " * 60)]
    want = brute_cut(rows, window)
    o = fm_dedup.SubstringOptions(window=window, gram=gram, hot=hot, shard_segments=5)
    got = fm_dedup.cut_repeats(documents(spark, rows + rows[:1]), o).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == want and len(got) == len(rows) + 1
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_cut_repeats_deals_a_hot_window_to_many_shards(spark, tmp_path, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [(i, f"a{i} b{i} c{i} {passage} d{i} e{i} f{i}") for i in range(300)]
    search = fm_dedup.search_shard

    def noted(o):
        inner, folder = search(o), str(tmp_path)

        def run(key, frame):
            with open(f"{folder}/{key[0]}", "w") as f:
                f.write(str(len(frame)))
            return inner(key, frame)

        return run

    monkeypatch.setattr(fm_dedup, "search_shard", noted)
    o = fm_dedup.SubstringOptions(window=12, gram=4, hot=10, shard_segments=40)
    got = fm_dedup.cut_repeats(documents(spark, rows), o).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == brute_cut(rows, 12)
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(sizes) >= 900 and max(sizes) < 150


def test_cut_repeats_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = {r.doc_id: r.n_removed for r in fm_dedup.cut_repeats(documents(spark, [(None, text), (4, text), (9, text)])).collect()}
    assert got == {None: 0, 4: 0, 9: 60}
    assert fm_dedup.cut_repeats(documents(spark, [])).count() == 0


# --- lines ------------------------------------------------------------------------------------------------
def brute_lines(rows, run, words=line_dedup.WORDS):
    """Every run of ``run`` lines, or fewer that hold ``words`` words, goes where it also stands earlier."""
    order = sorted((i, k) for i, t in rows if t is not None for k in range(len(t.split("\n"))))
    lines = {i: t.split("\n") for i, t in rows if t is not None}
    seen, gone = set(), {}
    for i, k in order:
        for n in range(1, run + 1):
            key = tuple(lines[i][k : k + n])
            if len(key) == n and (n == run or sum(len(x.split()) for x in key) >= words):
                if key in seen:
                    gone.setdefault(i, set()).update(range(k, k + n))
                seen.add(key)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(lines[i]) if k not in gone.get(i, ())) for i, t in rows}


@pytest.mark.parametrize("run, words", [(1, 50), (3, 50), (3, 4), (4, 7)])
def test_lines_equal_brute_force(spark, run, words):
    rng = random.Random(run)
    rows = [(i, "\n".join(f"line {rng.randrange(25)}" + " w" * rng.randrange(3) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n\n\n\n"), (104, "\n".join(f"l{i}" for i in range(3000)))]
    docs = documents(spark, rows).selectExpr("*", "5 as n_lines", "'x' as _doc", "'y' as _lines", "'z' as _line_gone")
    got = line_dedup.dedup_lines(docs, run, words).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows, run, words)
    assert all(r.n_lines - r.n_removed == len(r.text.split("\n")) for r in got if r.text)
    assert {(r["_doc"], r["_lines"], r["_line_gone"]) for r in got} == {("x", "y", "z")} and line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_a_repeated_long_line_goes_alone(spark):
    long, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}"), (3, f"d\n{short}"), (4, short), (5, long), (6, f"{short}\ntail"), (7, f"x\n{short}\ntail\ny")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: f"a\n{long}\nb", 2: "c", 3: f"d\n{short}", 4: short, 5: "", 6: f"{short}\ntail", 7: "x\ny"}


def test_only_selected_lines_travel(spark):
    text = "\n".join(f"line {i}" for i in range(4000))
    found = line_dedup.fingerprints(documents(spark, [(1, text)]), 3, 50).collect()
    assert 1800 < len(found) < 2200  # two of four lines for windows of three
    runs = {r.p - c // 3 for r in found for c in r.runs}
    assert runs == set(range(3998))  # and every window has one of them


def test_matches_name_their_earliest_position(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("folioflow.llm.common.checkpoint_dir", lambda s: str(tmp_path))
    docs = documents(spark, [(1, "x\na\nb\nc"), (2, "a\nb\nc\nd"), (3, "a\nb\nc\nd")])
    got = line_dedup.matches(docs, line_dedup.Store(spark, "t"), 3, 50).collect()
    assert sorted((r.doc_id, r.i, r.n, r.source.doc_id, r.source.i) for r in got) == [(2, 0, 3, 1, 1), (3, 0, 3, 1, 1), (3, 1, 3, 2, 1)]


def test_lines_repeated_rows_and_null_ids(spark):
    text = "a\nb\nc"
    got = line_dedup.dedup_lines(documents(spark, [(1, text), (1, text), (None, text), (2, text)])).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", text), ("1", text), ("2", ""), ("None", text)]


# --- languages --------------------------------------------------------------------------------------------
def test_language_held_out_and_spans(spark):
    rng = random.Random(2)
    syllables = {"aa": "ka to mi ru".split(), "bb": "sch ung ver eit".split(), "cc": "ция ста про ение".split()}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows = [(i, text(lang, 30), lang, "s", 0) for i, lang in enumerate(rng.choice(list(syllables)) for _ in range(300))]
    rows += [(900, None, "aa", "s", 0), (901, "12 ! ?", "bb", "s", 0), (902, "", None, None, None), (None, text("cc", 9), None, "s", 0)]
    mixed = text("aa", 40) + " " + text("cc", 15)
    rows.append((903, mixed, None, "s", 0))
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert held and all(r.lang_pred == rows[r.doc_id][2] for r in held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert [(s.lang, s.first, s.words) for s in got[903].spans] == [("aa", 0, 40), ("cc", 40, 15)] and 0.5 < got[903].score < 1
    assert got[None].lang_pred == "cc" and not got[None].held_out
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(documents(spark, [(1, "some words")])).collect()} == {"und"}


def test_viterbi_equals_exhaustive_search():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    sizes = np.array([5, 1, 4, 0, 6])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scores = -rng.random((sizes.sum(), 3)) * 4
    labels = language_id.viterbi(scores, starts, sizes, 1.5)
    for a, n in zip(starts, sizes):
        def total(path):
            return sum(scores[a + t, y] for t, y in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))

        best = max(map(total, itertools.product(range(3), repeat=int(n))))
        assert total(labels[a : a + n].tolist()) == pytest.approx(best)


# --- pieces -----------------------------------------------------------------------------------------------
def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.MODEL)
    rng = random.Random(4)
    letters = "abcdefgh ▁  éü日本語𠮷\n\t012 .,-<>ing the"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += [None, "", " ", "   lead", "x\x00y", "a" * 500, "the " * 3000, "日" * 200, "<s>hi</s>"] + [" " * k + "ab" for k in range(40)]
    docs = documents(spark, list(enumerate(texts))).selectExpr("*", "1 as pieces", "2 as _text")
    encoded = piece_transducer.encode_pieces(docs, keep_text=False)
    got = {r.doc_id: r for r in encoded.collect()}
    for i, t in enumerate(texts):
        assert got[i].pieces == model.encode(t or ""), repr(t)
        assert got[i].round_trip and got[i].n_pieces == len(got[i].pieces) and got[i]["_text"] == 2
    back = {r.doc_id: r.text for r in piece_transducer.decode_pieces(encoded).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert piece_transducer.encode_pieces(docs.limit(0)).count() == 0


def test_long_words_take_linear_time():
    import time

    import sentencepiece

    rng, t = random.Random(9), piece_transducer.PieceTransducer(bound=2000)
    word = "".join(rng.choice("abcdefghinorst") for _ in range(400_000))
    began = time.process_time()
    ids = t.encode(word)
    assert time.process_time() - began < 20 and t.decode(ids) == word
    model = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.MODEL)
    assert t.encode(word[:20_000]) == model.encode(word[:20_000])
    words = " ".join(word[i : i + 9] for i in range(0, 90_000, 9))  # more words than are remembered
    assert t.encode(words) == model.encode(words) and len(t.paths) <= 2000
    assert t.decode([10**9, *t.encode("ab")]).strip() == "ab"


def test_one_arc_a_place_stands_for_all_states():
    rng, t = random.Random(11), piece_transducer.PieceTransducer()
    for _ in range(400):
        word = "▁" + "".join(rng.choice("abcdehinorst日𠮷é") for _ in range(rng.randrange(1, 14)))
        assert t.shortest(word) == t.shortest_of_states(word), word


# --- mixing -----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("parts", [{"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 333, "b": 250, "c": 17, "d": 400}])
def test_schedule_keeps_within_one_block(parts):
    order, period = mixing.schedule(parts), sum(parts.values())
    given = dict.fromkeys(parts, 0)
    for t, s in enumerate(order, 1):
        given[s] += 1
        assert all(abs(given[x] - t * w / period) < 1 for x, w in parts.items())
    assert given == parts


def test_mix_keeps_rows_and_weights(spark):
    rows = [(i, f"t{i}", None, "big" if i % 3 else ["x", "y", None][i % 9 // 3], 1) for i in range(900)] + [(None, "n", None, "x", 1), (5, "t5", None, "big", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "'mine' as _source", "'old' as slot", "1 as _digest", "2 as _bucket", "3 as _mix_row")
    o = mixing.MixOptions(weights={"big": 2, "x": 1, "y": 1, "": 1}, block_rows=4, bucket_rows=50, period=5)
    got = mixing.mix(docs, o).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(r[0]), r[1]) for r in rows)
    assert [r.slot for r in got] == sorted(r.slot for r in got)
    assert {(r["_source"], r["_digest"], r["_bucket"], r["_mix_row"]) for r in got} == {("mine", 1, 2, 3)}
    slots = {}
    for r in got:
        slots.setdefault(r.slot, []).append(r)
    assert all(len({(x.source or "", x.block) for x in s}) == 1 and len(s) <= 4 for s in slots.values())
    parts = mixing.whole_parts({"": 1.0, "big": 2.0, "x": 1.0, "y": 1.0}, 5)
    period = sum(parts.values())
    counts = dict.fromkeys(parts, 0)
    for t in range(20):
        if t in slots:
            counts[slots[t][0].source or ""] += 1
        assert all(abs(c - (t + 1) * parts[s] / period) < 1 for s, c in counts.items())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_keeps_to_target_weights_over_many_periods(spark):
    sizes = {"hot": 3500} | {f"s{k:02}": 350 for k in range(20)}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    o = mixing.MixOptions(block_rows=1, period=100)
    at = {r.slot: r.source for r in mixing.mix(docs, o).select("slot", "source").collect()}
    assert len(at) == len(rows)
    total = sum(n**0.5 for n in sizes.values())
    given = dict.fromkeys(sizes, 0)
    for t in range(max(at) + 1):
        if t in at:
            given[at[t]] += 1
        assert all(abs(given[s] - (t + 1) * n**0.5 / total) < 1 + 1e-6 for s, n in sizes.items() if given[s] < n), t


# --- pages ------------------------------------------------------------------------------------------------
def test_leaf_blocks_of_broken_markup():
    page = """<!DOCTYPE html><title>no</title><script>var t="</p>";</script><style>p{}</style><p>One &amp; <b>two<br>three<p>Four<ul><li>a<li>b</ul>
    <!-- <p>hidden</p> --><div>x<3 &euro;</div><p>end"""
    assert [b.text for b in html_text.leaf_blocks(page)] == ["One & two three", "Four", "a", "b", "x<3 €", "end"]
    assert html_text.leaf_blocks(None) == [] and html_text.leaf_blocks("<!-- open <p>x") == []


@pytest.mark.parametrize("page,texts", [
    ("<svg class='i' /><p>One<p>Two <svg><title>no</title><text>no</text></svg>end", ["One", "Two end"]),
    ("<svg viewBox='0'><path d='M0'><article><p>One</article><svg/><p>Two", ["One", "Two"]),
    ("<p>One<object data='x'><p>Two</object><p>Three", ["One", "Two", "Three"]),
    ("<object data='x'/><p>One", ["One"]),
    ("<canvas><p>One</canvas><p>Two", ["One", "Two"]),
    ("<canvas id='c'/><p>One", ["One"])])
def test_leaf_blocks_after_drawings_and_objects(page, texts):
    assert [b.text for b in html_text.leaf_blocks(page)] == texts


def test_extraction_of_held_out_layouts(spark):
    rng = random.Random(8)

    def sentence():
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(4, 40))) + "."

    def page(i, parts):
        menu = "".join(f"<li><a href='/{k}'>{sentence()[:8]}</a></li>" for k in range(5))
        return (f"<html><body><nav><ul>{menu}</ul></nav><div class='ad'>{sentence()}</div><article><h1>{parts[0]}</h1>"
                + "".join(f"<p>{p}" for p in parts[1:]) + f"<section id='comments'><p>{sentence()}</p></section></article><footer>&copy; {sentence()}</footer></body></html>")

    truth = {i: [sentence() for _ in range(rng.randint(2, 9))] for i in range(300)}
    rows = [(i, f"u{i}", page(i, parts)) for i, parts in truth.items()] + [(900, None, None), (901, "u", ""), (None, "u", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text")
    got = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    assert sum(got[i].text == "\n".join(t) for i, t in truth.items()) / len(truth) > 0.98
    assert got[900].text == "" and got[901].n_chars == 0 and None in got
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_field_gradient_matches_differences():
    import numpy as np

    rng = np.random.default_rng(1)
    score, pair = rng.normal(size=(4, 3, 2)), rng.normal(size=(2, 2))
    mask = np.array([[1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)

    def log_total(s, p):
        out = 0.0
        for k in range(3):
            v = s[0, k]
            for t in range(1, mask[:, k].sum()):
                v = s[t, k] + np.logaddexp(v[0] + p[0], v[1] + p[1])
            out += np.logaddexp(*v)
        return out

    node, edge = html_text.marginals(score, pair, mask)
    for a in range(2):
        for b in range(2):
            moved = pair.copy()
            moved[a, b] += 1e-6
            assert edge[a, b] == pytest.approx((log_total(score, moved) - log_total(score, pair)) / 1e-6, abs=1e-4)
    moved = score.copy()
    moved[1, 0, 1] += 1e-6
    assert node[1, 0, 1] == pytest.approx((log_total(moved, pair) - log_total(score, pair)) / 1e-6, abs=1e-4)


# --- the pipeline -----------------------------------------------------------------------------------------
def test_pipeline_equals_its_parts(spark, tmp_path):
    import sentencepiece

    from test_pairs import brute_jaccard

    rows, labels = toxic_rows()
    rng = random.Random(1)
    base = " ".join(f"v{i}" for i in range(120))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows]
    rows += [(1000 + i, base + f" tail{i}" * (i % 3), "en", "s0", 0) for i in range(20)]
    rows += [(1100 + i, "\n".join(["own " * 5 + str(i), "same one", "same two", "same three"]), None, None, 0) for i in range(8)]
    rows += [(1200, None, None, None, None), (1201, "", "en", "s1", 0)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        assert docs.columns == list(corpus_pipeline.COLUMNS) or name == "SentencePiece"
    truth = {i: t for i, _, t in labels}
    clean = {r.doc_id: r.text for r in kept["toxicity"]}
    assert sum(truth.get(r[0], 0) == 1 and r[0] in clean for r in rows) <= 3 and all(r[0] in clean for r in rows if not truth.get(r[0], 0))
    lines = brute_lines(list(clean.items()), line_dedup.RUN)
    assert {r.doc_id: r.text for r in kept["line dedup"]} == lines
    groups = brute_jaccard(list(lines.items()), 5, 80)
    stay = {i: lines[i] for i, (_, c) in groups.items() if c == i}
    assert {r.doc_id: r.text for r in kept["n-gram Jaccard join"]} == stay
    assert {r.doc_id: r.text for r in kept["mixing to target weights"]} == stay
    model = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.MODEL)
    want = {i: model.encode(t or "") for i, t in stay.items()}
    assert {r.doc_id: r.pieces for r in kept["SentencePiece"]} == want
    assert {r.doc_id: r.pieces for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
    assert hashlib.sha256(b"").hexdigest() and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_schedule_outlives_parquet(spark, tmp_path):
    sizes = {"hot": 3200, "a": 800, "b": 800}
    rows = [(i, f"text {i}", "en", s, 0) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    for name, stage in corpus_pipeline.STAGES[-2:]:
        stage(spark, docs, str(tmp_path)).repartition(5).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = sorted(docs.collect(), key=lambda r: (r.slot, r.place_in_block))
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    for n in (160, 800, 1600, 3000):  # a and b have run out after 3,200 rows
        shares = {s: sum(r.source == s for r in got[:n]) / n for s in sizes}
        assert all(abs(shares[s] - w) * n <= 32 for s, w in (("hot", 0.5), ("a", 0.25), ("b", 0.25)))
