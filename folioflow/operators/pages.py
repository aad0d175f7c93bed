"""Page structure: assembling documents from pages and splitting them back.

Splitting works inside each row on arrays of pieces, so it is one narrow stage: a text is cut at its
markers and exploded, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.markdown import unwrap_page_fence
from folioflow.functions.text import col, let, strip


def pieces(c, pattern: str) -> Column:
    """A text cut at a pattern: ``[{marker, body, start}]``; the first piece has no marker.

    Concatenating markers and bodies in order gives the text back.
    """
    text = col(c)
    bodies = F.split(text, pattern, -1)
    markers = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.concat(F.array(F.lit("")), markers), bodies, lambda m, b: F.struct(
        m.alias("marker"), b.alias("body")))


def marker_number(marker) -> Column:
    return F.regexp_extract(col(marker), r"([0-9]+)", 1).try_cast("bigint")


def count_pages(c) -> Column:
    """Distinct page numbers named by markers, at least one."""
    found = F.regexp_extract_all(col(c), F.lit(K.PAGE_BOUNDARY_LOOSE), F.lit(0))
    return F.greatest(F.size(F.array_distinct(F.transform(found, marker_number))), F.lit(1)).cast("bigint")


def page_at(c, offset: Column) -> Column:
    """Number of the last page comment that starts at or before an offset, NULL before the first.

    One fold over the pieces with a running offset, so the cost is linear in the number of markers.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("page"))

    def step(acc, piece):
        hit = (piece["marker"] != "") & (acc["at"] <= offset)
        return F.struct(
            (acc["at"] + F.length(piece["marker"]) + F.length(piece["body"])).cast("bigint").alias("at"),
            F.when(hit, marker_number(piece["marker"])).otherwise(acc["page"]).alias("page"))

    return F.aggregate(pieces(c, K.PAGE_COMMENT), start, step, lambda acc: acc["page"])


def _without_rule(text: Column) -> Column:
    return let(strip(text), lambda t: F.when(
        t.endswith("---"), strip(F.substring(t, F.lit(1), F.length(t) - 3))).otherwise(t))


def _numbered(pages: Column) -> Column:
    """Pages sorted by number, then by position."""
    return F.array_sort(F.transform(pages, lambda p, i: F.struct(
        p["page_num"].alias("page_num"), i.alias("at"), p["text"].alias("text"))))


def _last_per_number(numbered: Column) -> Column:
    """Of pages with the same number only the last stays; ``numbered`` must be a column."""
    return F.filter(numbered, lambda p, i: ~F.coalesce(
        F.get(numbered, i + 1)["page_num"].eqNullSafe(p["page_num"]) & (F.size(numbered) > i + 1), F.lit(False)))


def split_pages(df: DataFrame, text: str = "text") -> DataFrame:
    """Pages of each document: the text after each marker, the last piece winning per number."""
    cut = pieces(text, K.PAGE_BOUNDARY)
    found = F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), lambda p: F.struct(
        marker_number(p["marker"]).alias("page_num"), _without_rule(p["body"]).alias("text")))
    whole = F.array(F.struct(
        F.lit(1).cast("bigint").alias("page_num"), F.lit(0).alias("at"), strip(text).alias("text")))
    keys = [c for c in df.columns if c != text]
    rows = df.filter(F.col(text) != "").select(*keys, _numbered(found).alias("_found"), whole.alias("_whole"))
    rows = rows.select(*keys, F.explode(
        F.when(F.size("_found") > 0, _last_per_number(F.col("_found"))).otherwise(F.col("_whole"))).alias("_p"))
    return rows.select(*keys, "_p.page_num", "_p.text")


def drop_adjacent_markers(cut: Column, within: int | None = None) -> Column:
    """Indices (1-based) of the pieces that open a page.

    A marker repeating the number of the marker just before it opens nothing; with ``within`` only
    when it also starts fewer than that many characters after it.
    """
    indices = F.sequence(F.lit(2), F.size(cut))

    def opens(i: Column) -> Column:
        here, before = F.get(cut, i - 1), F.get(cut, i - 2)
        same = marker_number(here["marker"]) == marker_number(before["marker"])
        if within is not None:
            same = same & (F.length(before["marker"]) + F.length(before["body"]) < within)
        return (i == 2) | ~F.coalesce(same, F.lit(False))

    return F.when(F.size(cut) > 1, F.filter(indices, opens)).otherwise(F.array().cast("array<int>"))


def _opened_pages(df: DataFrame, text: str, within: int | None) -> DataFrame:
    """Rows ``(keys, _opens, _blocks, _lead)``: one block per opening marker, markers kept in the text."""
    keys = [c for c in df.columns if c != text]
    rows = df.filter(F.col(text) != "").select(*keys, F.col(text).alias("_text"), pieces(text, K.PAGE_BOUNDARY).alias("_cut"))
    rows = rows.withColumn("_opens", drop_adjacent_markers(F.col("_cut"), within))

    def block(i: Column, k: Column) -> Column:
        until = F.coalesce(F.get(F.col("_opens"), k + 1), F.size("_cut") + 1)
        span = F.slice("_cut", i, until - i)
        body = F.array_join(F.transform(span, lambda p: F.concat(p["marker"], p["body"])), "")
        return F.struct(marker_number(F.get(F.col("_cut"), i - 1)["marker"]).alias("page_num"),
                        _without_rule(body).alias("text"))

    return rows.select(
        *keys, "_text", F.transform("_opens", block).alias("_blocks"), strip(F.col("_cut")[0]["body"]).alias("_lead"))


def parse_pages(df: DataFrame, text: str = "text") -> DataFrame:
    """Reader's split: markers stay in the text, repeated markers merge, text before page one is kept.

    Rows have ``kind`` 'page' or 'preamble'; the preamble has no page number.
    """
    keys = [c for c in df.columns if c != text]
    rows = _opened_pages(df, text, None).withColumn("_sorted", _numbered(F.col("_blocks")))
    number, string = "bigint", "string"
    pages = F.transform(_last_per_number(F.col("_sorted")), lambda b: F.struct(
        F.lit("page").alias("kind"), b["page_num"].alias("page_num"), b["text"].alias("text")))
    whole = F.array(F.struct(
        F.lit("page").alias("kind"), F.lit(1).cast(number).alias("page_num"), strip("_text").alias("text")))
    lead = F.array(F.struct(
        F.lit("preamble").alias("kind"), F.lit(None).cast(number).alias("page_num"), F.col("_lead").cast(string).alias("text")))
    out = F.when(F.size("_blocks") == 0, whole).when(F.col("_lead") != "", F.concat(lead, pages)).otherwise(pages)
    return rows.select(*keys, F.explode(out).alias("_p")).select(*keys, "_p.kind", "_p.page_num", "_p.text")


def split_sequential(df: DataFrame, text: str = "text") -> DataFrame:
    """Split of a consolidated document: pages keyed by position, the claimed number as label."""
    keys = [c for c in df.columns if c != text]
    rows = _opened_pages(df, text, K.SEQUENTIAL_MARKER_GAP)
    page = lambda position, label, body: F.struct(
        position.cast("bigint").alias("position"), label.cast("string").alias("label"), body.alias("text"))
    blocks = F.transform("_blocks", lambda b, i: page(i + 1, b["page_num"], b["text"]))
    whole = F.array(page(F.lit(1), F.lit("1"), strip("_text")))
    lead = F.array(page(F.lit(None), F.lit("preamble"), F.col("_lead")))
    out = F.when(F.size("_blocks") == 0, whole).when(F.col("_lead") != "", F.concat(lead, blocks)).otherwise(blocks)
    return rows.select(*keys, F.explode(out).alias("_p")).select(*keys, "_p.position", "_p.label", "_p.text")


def assemble(docs: DataFrame, pages: DataFrame, key: str = "doc") -> DataFrame:
    """Documents as ordered parts ``(key, part, text)``: part 0 is the header, part n is page n.

    ``docs`` has ``key, stem, source_name, model_name, total_pages``; ``pages`` has
    ``key, page_num, text``. Absent or empty pages get a notice. A document of any length stays one
    row per page, so none has to fit into one task; ``document_text`` joins the parts where one row
    per document is wanted.
    """
    header = F.concat_ws(
        "\n", F.concat(F.lit("# "), F.col("stem"), F.lit("\n")),
        F.concat(F.lit("> Source Document: `"), F.col("source_name"), F.lit("`  ")),
        F.concat(F.lit("> Total Pages: "), F.col("total_pages").cast("string"), F.lit("  ")),
        F.concat(F.lit("> Converted with Gemini Model: `"), F.col("model_name"), F.lit("`  \n")), F.lit("---\n"))
    heads = docs.select(key, F.lit(0).cast("bigint").alias("part"), header.alias("text"))
    numbers = docs.filter(F.col("total_pages") > 0).select(
        key, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("total_pages").cast("bigint"))).alias("part"))
    present = pages.select(key, F.col("page_num").cast("bigint").alias("part"), F.col("text").alias("_page"))
    number = F.col("part").cast("string")
    pending = F.concat(F.lit("> **[Page "), number, F.lit(" conversion pending/failed]**"))
    content = unwrap_page_fence(F.coalesce(F.nullif(F.col("_page"), F.lit("")), pending))
    body = F.concat(F.lit("\n<!-- Page "), number, F.lit(" -->\n## Page "), number, F.lit("\n\n"), content, F.lit("\n\n---\n"))
    bodies = numbers.join(present, [key, "part"], "left").select(key, "part", body.alias("text"))
    return heads.unionByName(bodies)


def document_text(parts: DataFrame, key: str = "doc", order: str = "part", separator: str = "\n") -> DataFrame:
    """One row per document from its ordered parts, for documents small enough to be one value."""
    joined = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order), F.col("text")))), lambda p: p["text"]), separator)
    return parts.groupBy(key).agg(joined.alias("text"))
