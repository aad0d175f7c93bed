"""Cutting documents into sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.text import has_table, is_blank, strip
from folioflow.operators.pages import pieces


def heading_sections(text: Column) -> Column:
    """``[{heading, level, body, has_table}]`` of a text, in order, cut at headings.

    A heading is a ``#`` line or a bold line of at least ten characters (level 2). A "Page N" heading
    is dropped and the text under it joins the section before it, or opens an untitled one.
    """
    cut = pieces(text, K.SECTION_HEADING)

    def describe(p: Column) -> Column:
        hashes = F.regexp_extract(p["marker"], r"^(#{1,6})", 1)
        title = F.regexp_extract(p["marker"], r"(?dsU)^#{1,6}\s+(.+)$", 1)
        bold = strip(F.btrim(F.regexp_extract(p["marker"], r"(?ds)^(\*{2}[^*\n]{10,}\*{2})", 1), F.lit("*")))
        heading = F.when(p["marker"] == "", F.lit(None)).when(
            hashes != "", strip(F.btrim(strip(title), F.lit("*")))).otherwise(bold)
        level = F.when(p["marker"] == "", 0).when(hashes != "", F.length(hashes)).otherwise(2)
        page = F.coalesce(heading.rlike(K.PAGE_HEADING_TEXT), F.lit(False))
        kept = F.when(page, F.when(is_blank(p["body"]), F.lit("")).otherwise(p["body"])).otherwise(
            F.concat(p["marker"], p["body"]))
        return F.struct(
            F.when(~page, heading).alias("heading"), F.when(page, 0).otherwise(level).cast("int").alias("level"),
            kept.alias("body"), (~page & (p["marker"] != "")).alias("real"),
            F.when(page, kept != "").otherwise((p["marker"] == "") & ~is_blank(kept)).alias("loose"))

    return F.transform(cut, describe)


def with_units(df: DataFrame, unit: str = "headings", text: str = "text", out: str = "_u") -> DataFrame:
    """Add the sections of a text as an array ``[{heading, level, body}]``.

    ``unit`` is 'headings' or 'lines' (line ends kept). Arrays that a later lambda looks into are
    columns of their own, so that they are computed once per row and not once per element.
    """
    if unit == "lines":
        lines = F.regexp_extract_all(F.col(text), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
        return df.withColumn(out, F.transform(lines, lambda line: F.struct(
            F.lit(None).cast("string").alias("heading"), F.lit(0).alias("level"), line.alias("body"))))
    described = df.withColumn("_d", heading_sections(F.col(text)))
    return described.withColumn("_o", section_openings(F.col("_d"))).withColumn(
        out, absorb_page_headings(F.col("_d"), F.col("_o"))).drop("_d", "_o")


def section_openings(described: Column) -> Column:
    """Indices of the pieces that open a section; the others continue the one before."""
    reals = F.filter(F.sequence(F.lit(1), F.size(described)), lambda i: F.get(described, i - 1)["real"])
    first_loose = F.array_position(F.transform(described, lambda s: s["loose"]), True).cast("int")
    first_real = F.array_position(F.transform(described, lambda s: s["real"]), True).cast("int")
    leads = (first_loose > 0) & ((first_real == 0) | (first_loose < first_real))
    return F.concat(F.when(leads, F.array(first_loose)).otherwise(F.array().cast("array<int>")), reals)


def absorb_page_headings(described: Column, opens: Column) -> Column:
    """Merge pieces that follow a page heading into the section they continue."""

    def section(i: Column, k: Column) -> Column:
        until = F.coalesce(F.get(opens, k + 1), F.size(described) + 1)
        body = F.array_join(F.transform(F.slice(described, i, until - i), lambda s: s["body"]), "")
        here = F.get(described, i - 1)
        return F.struct(here["heading"].alias("heading"), here["level"].alias("level"), body.alias("body"))

    return F.transform(opens, section)


def split_sections(df: DataFrame, text: str = "text", unit: str = "headings") -> DataFrame:
    """One row per section: ``section_ord, heading, level, body, has_table``; other columns are kept.

    Stays inside the row until the final explode, so no shuffle is needed to keep sections in order.
    """
    keys = [c for c in df.columns if c != text]
    return explode_units(with_units(df, unit, text), keys)


def explode_units(rows: DataFrame, keys: list[str]) -> DataFrame:
    out = rows.select(*keys, F.posexplode("_u").alias("_at", "_s"))
    return out.select(
        *keys, F.col("_at").cast("bigint").alias("section_ord"), "_s.heading", "_s.level", "_s.body",
        has_table("_s.body").alias("has_table"))
