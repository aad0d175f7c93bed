from pyspark.sql import functions as F

from folioflow.operators import pages as P
from folioflow.operators.sections import split_sections


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def frame(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc string, text string")


def test_split_takes_text_after_markers(spark):
    df = frame(spark, a="head\n<!-- Page 1 -->\n## Page 1\n\nalpha\n\n---\n<!-- page 2 -->\nbeta", b="no markers ", c="## Page 3\nx\n## Page 3\ny", d="")
    assert rows(P.split_pages(df), "doc", "page_num", "text") == [
        ("a", 1, "alpha"), ("a", 2, "beta"), ("b", 1, "no markers"), ("c", 3, "y")]


def test_reader_split_keeps_markers_and_preamble(spark):
    df = frame(spark, a="head\n<!-- Page 40 -->\n## Page 40\n\nalpha\n---", b="plain", c="<!-- Page 1 -->x<!-- Page 2 -->y<!-- Page 1 -->z")
    assert rows(P.parse_pages(df), "doc", "kind", "page_num", "text") == [
        ("a", "page", 40, "<!-- Page 40 -->\n## Page 40\n\nalpha"), ("a", "preamble", None, "head"), ("b", "page", 1, "plain"),
        ("c", "page", 1, "<!-- Page 1 -->z"), ("c", "page", 2, "<!-- Page 2 -->y")]


def test_sequential_split_restarts(spark):
    far = "x" * 200
    df = frame(spark, a=f"m\n<!-- Page 1 -->\n## Page 1\none\n<!-- Page 1 -->{far}\n<!-- Page 1 -->two")
    got = rows(P.split_sequential(df), "position", "label", "text")
    assert got == [
        (1, "1", f"<!-- Page 1 -->\n## Page 1\none\n<!-- Page 1 -->{far}"), (2, "1", "<!-- Page 1 -->two"), (None, "preamble", "m")]


def test_counts_and_attribution(spark):
    df = frame(spark, a="x<!-- Page 1 -->aa<!-- Page 2 -->b## Page 2", b="none")
    got = df.select("doc", P.count_pages("text").alias("n"), P.page_at("text", F.lit(0)).alias("p0"),
                    P.page_at("text", F.lit(1)).alias("p1"), P.page_at("text", F.lit(25)).alias("p2"))
    assert rows(got, "doc", "n", "p0", "p1", "p2") == [("a", 2, None, 1, 2), ("b", 1, None, None, None)]


def test_assemble_and_split_round_trip(spark):
    docs = spark.createDataFrame([("a", "A", "A.pdf", "m", 3), ("e", "E", "E.pdf", "m", 0)], "doc string, stem string, source_name string, model_name string, total_pages int")
    pages = spark.createDataFrame([("a", 1, "```\none\n```"), ("a", 3, " three\n\ntext ")], "doc string, page_num int, text string")
    text = P.document_text(P.assemble(docs, pages))
    assert rows(P.split_pages(text.filter("doc = 'a'")), "page_num", "text") == [
        (1, "one"), (2, "> **[Page 2 conversion pending/failed]**"), (3, "three\n\ntext")]
    whole = {r.doc: r.text for r in text.collect()}
    assert whole["a"].startswith("# A\n\n> Source Document: `A.pdf`  \n> Total Pages: 3  \n> Converted with Gemini Model: `m`  \n\n---\n\n\n<!-- Page 1 -->\n## Page 1\n\none\n\n---\n")
    assert whole["e"].endswith("---\n")


def test_sections(spark):
    text = "pre\n# One\nbody\n## Page 7\nmore\n|a|b|\n**A bold heading here**\nzz\n### Page 8\n  \n# Two **x**\n"
    df = frame(spark, a=text, b="## Page 1\ntext\n## Page 2\nmore\n# H\nq", c="plain")
    got = rows(split_sections(df), "doc", "section_ord", "heading", "level", "body", "has_table")
    assert got == [
        ("a", 0, None, 0, "pre\n", False), ("a", 1, "One", 1, "# One\nbody\n\nmore\n|a|b|\n", True),
        ("a", 2, "A bold heading here", 2, "**A bold heading here**\nzz\n", False), ("a", 3, "Two **x", 1, "# Two **x**\n", False),
        ("b", 0, None, 0, "\ntext\n\nmore\n", False), ("b", 1, "H", 1, "# H\nq", False), ("c", 0, None, 0, "plain", False)]


def test_lines_keep_their_ends(spark):
    got = split_sections(frame(spark, a="x\n\ny"), unit="lines").orderBy("section_ord").collect()
    assert [r.body for r in got] == ["x\n", "\n", "y"]
