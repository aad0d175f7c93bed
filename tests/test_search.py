import pytest
from pyspark.sql import functions as F

from folioflow.operators import search as S


@pytest.fixture(scope="module")
def docs(spark):
    far = "x" * 100
    return spark.createDataFrame([
        ("a", "Acme - 2025.md", "Acme", "<!-- Page 1 -->\nIntro.\n<!-- Page 2 -->\nThe dividend rose.\nA DIVIDEND of 3p."),
        ("b", "Beta - 2025.md", "Beta", "No such dividends here, word-dividend and dividend_x."),
        ("c", "Crux.md", "Crux", f"{far} left words {far} dividend {far} right words {far}"),
        ("d", "Dune.md", "Dune", "nothing (a+b) here")], "doc string, name string, folder string, text string")


def test_ranking_counts_and_pages(docs):
    got = S.search(docs, " dividend ", max_documents=2).collect()
    assert [(r.doc, r.match_count) for r in got] == [("b", 3), ("a", 2)]
    assert [m.page for m in got[1].matches] == [2, 2] and [m.page for m in got[0].matches] == [None] * 3
    hit = got[1].matches[0]
    assert hit.text[hit.match_start:hit.match_end] == "dividend" and "\n" not in hit.text
    assert [r.doc for r in S.search(docs, "dividend", max_documents=2, offset=2).collect()] == ["c"]
    total = S.search_summary(docs, "dividend", max_documents=2).first()
    assert tuple(total) == (6, 3, 4, True, True)
    assert S.search_summary(docs, "dividend", max_documents=2, offset=2).first().has_more is False


def test_case_words_and_literals(docs):
    count = lambda *a, **k: {r.doc: r.match_count for r in S.matching(docs, *a, **k).collect()}
    assert count("DIVIDEND", match_case=True) == {"a": 1}
    assert count("dividend", whole_word=True) == {"a": 2, "b": 1, "c": 1}
    assert count("(a+b)") == {"d": 1} and count("(a+b)", whole_word=True) == {}
    assert S.search(docs, "  ").count() == 0 and tuple(S.search_summary(docs, "").first()) == (0, 0, 0, False, False)


def test_snippets_are_cut_at_blanks(docs):
    hit = S.search(docs, "dividend").filter("doc = 'c'").first().matches[0]
    assert hit.text == "dividend" or hit.text.startswith("x") and hit.prefix_truncated and hit.suffix_truncated
    assert hit.text[hit.match_start:hit.match_end] == "dividend"


def test_first_k_does_not_change_counts(spark):
    df = spark.createDataFrame([("a", "aXbXcXd")], "doc string, text string")
    assert [(r.ordinal, r.start) for r in S.first_k(df, "x", 2).orderBy("ordinal").collect()] == [(0, 1), (1, 3)]


def test_page_search_reads_prose(spark):
    pages = spark.createDataFrame([("a", 1, "**net** assets and net\n\n[net](net)"), ("a", 2, "none")], "doc string, page_num int, text string")
    assert [(r.page_num, r.ordinal) for r in S.search_pages(pages, "NET").orderBy("ordinal").collect()] == [(1, 0), (1, 1), (1, 2)]


def test_quick_open(docs):
    assert [r.doc for r in S.quick_open(docs, "2025 acme").collect()] == ["a"]
    assert [(r.doc, r.score) for r in S.quick_open(docs.withColumn("name", F.lit("acme list")), "acme").collect()][0] == ("a", 3)
    assert S.quick_open(docs, "", 2).count() == 2


def test_limits_hold_as_given(spark):
    docs = spark.range(700).selectExpr("id as doc", "concat('n', id) as name", "'f' as folder", "'a tion b' as text")
    assert S.search(docs, "tion", max_documents=650).count() == 650
    assert S.search(docs, "t" * 600).count() == 0


def test_index_changes_no_result(spark, tmp_path):
    texts = ["The Kelvin \u212aelvin sign", "\u017ftop stop STOP", "\u0130stanbul istanbul \u0131stanbul", "stra\u00dfe caf\u00e9 na\u00efve", "a+b (c) a+b", "", None, "\U0001f600abc",
             "x" * 5000 + "needle", "nee dle"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    index = str(tmp_path / "index")
    S.build_index(df, index)
    for query in ("kelvin", "STOP", "istanbul", "fe caf\u00e9", "a+b", "ab", "needle", "\U0001f600abc", "\u00dfe", "nowhere at all", "KELVIN sign"):
        plain = {(r.doc, r.match_count) for r in S.matching(df, query).collect()}
        assert {(r.doc, r.match_count) for r in S.matching(S.narrowed(df, index, query), query).collect()} == plain, query
    assert S.narrowed(df, index, "needle").count() == 1


def test_pages_by_last_result_equal_pages_by_offset(docs):
    whole, page, after = S.search(docs, "dividend").collect(), [], None
    while True:
        rows = S.search(docs, "dividend", max_documents=1, after=after).collect()
        if not rows:
            break
        page += rows
        after = (rows[-1].match_count, rows[-1].folder, rows[-1]["name"], rows[-1].doc)
    assert [r.doc for r in page] == [r.doc for r in whole] and len(page) == 3
