"""Consolidating documents into one, as ordered parts that are never held in one place."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions import text as T
from folioflow.functions.markdown import strip_document_header
from folioflow.operators.ordering import scan_in_order
from folioflow.operators.pages import count_pages

PART_ORDER = ["block", "position", "line"]
HEADER_END = r"(?m)^[ \t]*(?:<!--|---|##)"
HEADER_BANNER = r"(?m)^[ \t]*>[ \t]*" + re.escape(K.CONSOLIDATED_BANNER)


def combinable(df: DataFrame, include_consolidated: bool = False, include_lightweight: bool = False) -> DataFrame:
    keep = F.lit(True)
    if not include_consolidated:
        keep = keep & ~F.col("is_consolidated")
    if not include_lightweight:
        keep = keep & ~F.col("is_lightweight")
    return df.filter(keep)


def skipped_count(df: DataFrame, include_consolidated: bool = False, include_lightweight: bool = False) -> DataFrame:
    kept = combinable(df, include_consolidated, include_lightweight).agg(F.count(F.lit(1)).alias("n"))
    return df.agg((F.count(F.lit(1)) - kept.scalar()).alias("skipped"))


def sort_keys(mode: str) -> list:
    """Sort keys of a mode; undated titles sort as year 9999, so last ascending and first descending."""
    year, title = F.coalesce(T.year_of("title"), F.lit(K.UNDATED_YEAR)), F.lower("title")
    return {
        "chronological_asc": [year, title], "chronological_desc": [-year, title],
        "alpha_asc": [title], "alpha_desc": [F.desc(title)],
    }.get(mode, [F.col("pos")])


def order_documents(df: DataFrame, mode: str = "custom") -> DataFrame:
    """Number documents ``doc, title[, pos]`` in the order of a mode; ties go by ``doc``."""
    return scan_in_order(df, [*sort_keys(mode), F.col("doc")], "position")


def with_pages(df: DataFrame) -> DataFrame:
    return df.withColumn("pages", count_pages("text"))


def resolve_title(title: str | None) -> Column:
    """The given title, else one from the collection (an aggregate over its documents)."""
    if title and title.strip():
        return F.lit(title)
    named = F.when(F.col("folder") != "", F.col("folder"))
    single = (F.count_distinct(named) == 1) & ~F.max(named).isin("Accounts", "documents", "PDFs")
    return F.when(single, F.concat(F.lit("Consolidated Accounts & Filings — "), F.max(named))).otherwise(
        F.format_string("Consolidated Markdown Document (%d Documents)", F.count(F.lit(1))))


def section_heading() -> Column:
    return F.concat(F.col("position").cast("string"), F.lit(". "), F.col("title"))


def contents(ordered: DataFrame) -> DataFrame:
    """Contents table of numbered documents: ``position, title, year, pages, anchor``."""
    year = F.coalesce(T.year_of("title").cast("string"), F.lit("—"))
    return ordered.select("doc", "position", "title", year.alias("year"), "pages", T.slug(section_heading()).alias("anchor"))


def combine(
    df: DataFrame, title: str | None = None, toc: bool = True, source_meta: bool = True, strip_headers: bool = True,
    sort_mode: str = "custom", generated_at: str | None = None, generated_via: str = "folioflow",
) -> DataFrame:
    """Parts ``block, position, line, text`` of the combined document of ``doc, title, folder, file_name, text``.

    The document is the parts in PART_ORDER joined by line breaks. Every part belongs to one source
    document or to the header, so a collection of any size stays distributed.
    """
    generated_at = generated_at or datetime.now().strftime("%Y-%m-%d %H:%M")
    # Two passes over the texts: page counts first, bodies last. Only titles are put in order.
    light = order_documents(with_pages(df).drop("text"), sort_mode)
    ordered = light.join(df.select("doc", "text"), "doc")
    text_of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def lines(source: DataFrame, block: int, texts: list[Column]) -> DataFrame:
        items = F.array(*[F.struct(F.lit(i).alias("line"), t.alias("text")) for i, t in enumerate(texts)])
        position = F.col("position") if "position" in source.columns else F.lit(0).cast("bigint")
        return source.select(position.alias("position"), F.explode(items).alias("_i")).select(
            F.lit(block).alias("block"), "position", "_i.line", "_i.text")

    head = light.agg(
        resolve_title(title).alias("title"), F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"))
    banner = text_of(
        "> **Consolidated Archive**: ", F.col("documents"), " Document(s)  \n> **Total Pages**: ", F.col("pages"),
        f" pages  \n> **Generated via**: {generated_via} on {generated_at}\n")
    out = lines(head, 0, [text_of("# ", F.col("title"), "\n"), banner])
    if toc:
        out = out.unionByName(lines(head, 1, [
            F.lit("## 📋 Table of Contents\n"), F.lit("| # | Document | Year / Period | Pages | Section Link |"),
            F.lit("| :-: | :--- | :-: | :-: | :--- |")]))
        row = text_of("| ", F.col("position"), " | ", F.col("title"), " | ", F.col("year"), " | ", F.col("pages"),
                      " pgs | [View Section &rarr;](#", F.col("anchor"), ") |")
        out = out.unionByName(lines(contents(light), 2, [row])).unionByName(lines(head, 3, [F.lit("\n---\n")]))
    body = F.coalesce("text", F.lit(""))
    body = strip_document_header(body) if strip_headers else T.strip(body)
    meta = [
        text_of("> 📄 **Source**: `", F.col("file_name"), "`  "),
        text_of("> 📂 **Folder**: `", F.col("folder"), "` | **Pages**: ", F.col("pages"), " pages  \n"),
    ] if source_meta else []
    return out.unionByName(lines(ordered, 4, [
        text_of("\n# ", section_heading(), "\n"), *meta, body, F.lit("\n\n---\n")]))


def combine_summary(parts: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents, pages, words and characters of the combined text.

    The last part loses its trailing line break and the text gains a final one, so characters are
    the parts' lengths plus one separator between any two.
    """
    sums = parts.agg(F.sum(T.word_count("text")).alias("w"), (F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("c"))
    totals = with_pages(documents).agg(F.count(F.lit(1)).alias("total_documents"), F.sum("pages").alias("total_pages"))
    return totals.select("*", sums.select("w").scalar().alias("total_words"), sums.select("c").scalar().alias("total_chars"))


def collection_label(selection: DataFrame) -> DataFrame:
    """Title and file name suggested for a selection of ``folder, title``."""
    folder = F.when(F.col("folder") != "", F.col("folder"))
    facts = selection.select(folder.alias("folder"), T.year_of("title").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("folder").alias("folders"), F.max("folder").alias("one"),
        F.min("year").alias("lo"), F.max("year").alias("hi"))
    span = F.when(F.col("lo").isNull(), "").when(
        F.col("lo") == F.col("hi"), F.concat(F.lit(" "), F.col("lo").cast("string"))).otherwise(
            F.concat(F.lit(" ("), F.col("lo").cast("string"), F.lit("–"), F.col("hi").cast("string"), F.lit(")")))
    specific = (F.col("folders") == 1) & ~F.col("one").isin("Accounts", "documents", K.ROOT_FOLDER_LABEL)
    label = F.when(specific, F.col("one")).when(
        F.col("folders") > 1, F.concat(F.col("folders").cast("string"), F.lit(" Folders"))).otherwise("Documents")
    named = facts.select("n", "folders", label.alias("label"), span.alias("span"))
    clean = F.regexp_replace(F.regexp_replace("label", r"[^\w\s-]", ""), r"\s+", "_")
    years = F.regexp_replace(F.regexp_replace("span", r"[^\w-]", "_"), r"^_+|_+$", "")
    suffix = F.when(years != "", F.concat(F.lit("_"), years)).otherwise("")
    file_name = F.regexp_replace(F.concat(clean, F.lit("_Consolidated"), suffix, F.lit(".md")), "__+", "_")
    empty = F.col("n") == 0
    return named.select(
        "folders", F.when(empty, "").otherwise(F.concat(F.lit("Consolidated Document — "), "label", "span")).alias("title"),
        F.when(empty, "Consolidated_Document.md").otherwise(file_name).alias("file_name"))


def destination(folder: str | None, file_name: str | None) -> str:
    """Where a consolidation is written, relative to the workspace."""
    name = (file_name or "").strip() or "Consolidated_Document.md"
    name = name if name.lower().endswith(".md") else name + ".md"
    inside = "" if not folder or folder in K.ROOT_TARGETS else folder + "/"
    return f"{inside}{K.CONSOLIDATED_DIR}/{name}"


def misplaced_consolidations(df: DataFrame) -> DataFrame:
    """Combined documents lying among transcripts (``path, text``), with where they belong.

    Such a document says so in a block quote of its header, the text before the first page marker, rule or section;
    a transcript that quotes the banner elsewhere stays.
    """
    among = (F.try_element_at(T.path_parts("path"), F.lit(-2)) == K.MARKDOWN_DIR) & ~T.is_consolidated("path")
    header = F.split("text", HEADER_END, 2)[0]
    banner = F.col("text").contains(K.CONSOLIDATED_BANNER) & header.rlike(HEADER_BANNER)
    moved = F.regexp_replace("path", r"Markdown/([^/]*)$", f"{K.CONSOLIDATED_DIR}/$1")
    return df.filter(among & banner).select("path", moved.alias("destination"))
