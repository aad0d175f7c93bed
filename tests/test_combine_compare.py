import random

import pytest
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.operators import combine as C
from folioflow.operators import compare as M
from folioflow.operators import word_diff as W
from folioflow.sources.files import write_consolidated

HEADER = "# Report {y}\n\n> Source Document: `x`  \n\n---\n\n"


def reports(spark):
    rows = [(f"r{y}", i, f"Report {y}", "Acme", f"Report {y}.md", HEADER.format(y=y) + "\n".join(f"<!-- Page {p} -->\nText {y} {p}." for p in range(1, n + 1)))
            for i, (y, n) in enumerate([(2020, 2), (2019, 2), (2021, 1)])] + [("x", 3, "Annex", "Acme", "Annex.md", "no pages")]
    return spark.createDataFrame(rows, "doc string, pos int, title string, folder string, file_name string, text string")


def test_orders(spark):
    df = reports(spark).drop("text")
    order = lambda mode: [r.title for r in C.order_documents(df, mode).orderBy("position").collect()]
    assert order("chronological_asc") == ["Report 2019", "Report 2020", "Report 2021", "Annex"]
    assert order("chronological_desc") == ["Annex", "Report 2021", "Report 2020", "Report 2019"]
    assert order("alpha_desc") == ["Report 2021", "Report 2020", "Report 2019", "Annex"]
    assert order("custom") == ["Report 2020", "Report 2019", "Report 2021", "Annex"]


def test_combined_text_and_totals(spark, tmp_path):
    df = reports(spark)
    parts = C.combine(df, sort_mode="chronological_asc", generated_at="2024-01-01 00:00").cache()
    text = "\n".join(r.text for r in parts.orderBy(*C.PART_ORDER).collect()).strip() + "\n"
    assert text.startswith("# Consolidated Accounts & Filings — Acme\n\n> **Consolidated Archive**: 4 Document(s)  \n> **Total Pages**: 6 pages  \n")
    assert "| 1 | Report 2019 | 2019 | 2 pgs | [View Section &rarr;](#1-report-2019) |" in text and "| 4 | Annex | — | 1 pgs |" in text
    assert "\n# 2. Report 2020\n\n> 📄 **Source**: `Report 2020.md`  \n> 📂 **Folder**: `Acme` | **Pages**: 2 pages  \n\n<!-- Page 1 -->" in text
    assert "> Source Document" not in text and text.endswith("no pages\n\n\n---\n")
    total = C.combine_summary(parts, df).first()
    assert tuple(total) == (4, 6, len(text.split()), len(text))
    out = tmp_path / "all"
    write_consolidated(parts, str(out))
    assert "".join(p.read_text() for p in sorted(out.glob("part-*"))) == text


def test_labels_and_destinations(spark):
    label = C.collection_label(reports(spark)).first()
    assert (label.title, label.file_name) == ("Consolidated Document — Acme (2019–2021)", "Acme_Consolidated_2019_2021.md")
    assert C.destination("Acme", "x") == "Acme/Consolidated/x.md" and C.destination("General / Root", "") == "Consolidated/Consolidated_Document.md"
    df = spark.createDataFrame([("/w/A/Markdown/x.md", "# T\n> **Consolidated Archive**: 2"), ("/w/A/Markdown/y.md", "z" * 5000 + "**Consolidated Archive**"),
                                ("/w/A/Consolidated/x.md", "**Consolidated Archive**")], "path string, text string")
    assert [tuple(r) for r in C.misplaced_consolidations(df).collect()] == [("/w/A/Markdown/x.md", "/w/A/Consolidated/x.md")]


def pages(spark, texts):
    return spark.createDataFrame([("d", n, t) for n, t in texts.items()], "pair string, page_num int, text string")


def test_page_comparison(spark):
    a = pages(spark, {1: "same  text", 2: "old", 3: "gone", 5: "| a | b |"})
    b = pages(spark, {1: "same\ntext", 2: "new", 4: "added", 5: "a · b"})
    got = {r.page_num: r.status for r in M.compare_pages(a, b, ["pair"]).collect()}
    assert got == {1: "same", 2: "changed", 3: "only_a", 4: "only_b", 5: "changed"}
    prose = M.compare_summary(M.compare_pages(a, b, ["pair"], "prose"), ["pair"]).first()
    assert tuple(prose) == ("d", 1, 3, 1, 1, False)
    assert M.diff_pages(M.compare_pages(a, b, ["pair"])).filter("page_num = 2").select("added", "removed").first() == (1, 1)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("cells", [1 << 26, 8])
def test_edit_scripts_are_minimal_and_reassemble(monkeypatch, cells):
    """Few kept cells force the halving of tables."""
    monkeypatch.setattr(W, "KEPT_CELLS", cells)
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        ops = W.difference(a, b)
        assert [t for o, ts in ops for t in ts if o != "+"] == a and [t for o, ts in ops for t in ts if o != "-"] == b
        assert sum(len(ts) for o, ts in ops if o == "=") == lcs(a, b) == W.common_length(a, b)
        assert all(x[0] != y[0] and x[0] + y[0] != "+-" for x, y in zip(ops, ops[1:]))


def test_words_inserted_deleted_and_changed():
    ops = lambda a, b: [(o, "".join(ts)) for o, ts in W.difference(W.TOKEN.findall(a), W.TOKEN.findall(b))]
    assert ops("the same words", "the same words") == [("=", "the same words")] and ops("", "") == []
    assert [o for o, t in ops("assets under management", "assets under active management")] == ["=", "+", "="]
    assert [o for o, t in ops("net rental income rose", "net income rose")] == ["=", "-", "="]
    assert ops("profit of £12.4m", "profit of £15.9m") == [("=", "profit of "), ("-", "£12.4m"), ("+", "£15.9m")]


def test_rewritten_page_is_one_replacement_under_a_limit():
    a, b = ([x for i in range(900) for x in (f"{s}{i}", " ")] for s in "ab")
    assert W.difference(["x", *a], ["x", *b], K.MAX_EDIT_DISTANCE) == [("=", ["x"]), ("-", a[:-1]), ("+", b[:-1]), ("=", [" "])]
    assert sum(len(ts) for o, ts in W.difference(a, b) if o == "=") == 900
    assert [o for o, _ in W.difference(list("abcd"), list("axyd"), 3)] == ["=", "-", "+", "="] == [o for o, _ in W.difference(list("abcd"), list("axyd"), 4)]
    assert [o for o, _ in W.difference(list("abcbd"), list("axbyd"), 3)] == ["=", "-", "+", "="]


def test_long_pages_are_aligned_whole():
    rng = random.Random(2)
    a = [str(rng.randrange(3000)) for _ in range(20_000)]
    b = [t for t in a if rng.random() < 0.9]
    kept = sum(len(ts) for o, ts in W.difference(a, b) if o == "=")
    assert kept == len(b)
