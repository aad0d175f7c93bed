"""Markdown reductions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.text import col, collapse, let, strip


def strip_document_header(c) -> Column:
    """Drop the first title with its quoted lines and rule; only the first match goes."""

    def cut(text: Column) -> Column:
        def without(head: Column) -> Column:
            at = F.instr(text, head)
            return F.when(head == "", text).otherwise(F.concat(
                F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(head), F.length(text))))

        return strip(let(F.regexp_extract(text, K.DOCUMENT_HEADER, 0), without))

    return let(strip(c), cut)


def unwrap_page_fence(c) -> Column:
    """Remove a code fence that wraps the whole page.

    Only when the opening line carries no language other than Markdown and the first line that can
    close it is the last line of the page.
    """

    def opening_part(lines: Column, group: int) -> Column:
        return F.regexp_extract(strip(F.get(lines, F.lit(0))), r"^(`{3,})[ \t]*([^\s`]*)[ \t]*$", group)

    def step(acc: Column, line: Column) -> Column:
        closing = F.length(F.regexp_extract(strip(line), r"^(`{3,})[ \t]*$", 1)) >= acc["ticks"]
        return F.struct(
            acc["ticks"].alias("ticks"), (acc["at"] + 1).alias("at"),
            F.when((acc["closed"] == 0) & closing, acc["at"] + 1).otherwise(acc["closed"]).alias("closed"))

    def unwrap(text: Column) -> Column:
        def inspect(lines: Column) -> Column:
            ticks = F.length(opening_part(lines, 1))
            rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
            # Fold with the opening length in the accumulator: the first line that can close it.
            start = F.struct(ticks.alias("ticks"), F.lit(0).alias("at"), F.lit(0).alias("closed"))
            closed = F.aggregate(rest, start, step, lambda acc: acc["closed"])
            wrapped = (
                (F.size(lines) > 1) & F.lower(opening_part(lines, 2)).isin(K.FENCE_INFO_UNWRAPPED)
                & (ticks > 0) & (closed == F.size(lines) - 1))
            inner = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
            return F.when(wrapped, strip(inner)).otherwise(text)

        return F.when(text.startswith("```"), let(F.split(text, K.LINE_BREAK, -1), inspect)).otherwise(text)

    return let(strip(c), unwrap)


def strip_page_heading(c) -> Column:
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?iU)\A<!--\s*Page\s+\d+\s*-->\s*", "")
    return strip(F.regexp_replace(text, r"(?iU)\A##\s+Page\s+\d+\s*", ""))


# Patterns applied to the whole text, in order, before table rows are read.
_BEFORE_TABLES = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?md)^[ \t]*```[^\n]*\n?", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?md)^[ \t]*#{1,6}[ \t]+", ""),
    (r"(?md)^[ \t]*>[ \t]?", ""),
    (r"(?md)^[ \t]*[-*+][ \t]+", ""),
    (r"(?md)^[ \t]*[0-9]+[.)][ \t]+", ""),
    (r"(?md)^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$", ""),
]
_TABLE_SEPARATOR = r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$"
_TABLE_LINE = r"^[ \t]*\|.*\|[ \t]*$"
_AFTER_TABLES = [
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"\*([^*\n]+)\*", "$1"),
    (r"(?Ud)(^|[\s(])_([^_\n]+)_(?=[\s).,;:!?]|\z)", "$1$2"),
    (r"`([^`\n]+)`", "$1"),
    (r"(?md)[ \t]+$", ""),
    (r"\n{3,}", "\n\n"),
]


def markdown_to_prose(c) -> Column:
    """The words a Markdown text renders to, as an ordered chain of rewrites."""
    text = F.coalesce(col(c), F.lit(""))
    for pattern, replacement in _BEFORE_TABLES:
        text = F.regexp_replace(text, pattern, replacement)

    def read_row(line: Column) -> Column:
        cells = F.split(F.regexp_replace(strip(line), r"^\||\|$", ""), r"\|", -1)
        return F.array_join(F.filter(F.transform(cells, strip), lambda cell: cell != ""), " · ")

    lines = F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(_TABLE_SEPARATOR))
    text = F.array_join(
        F.transform(lines, lambda line: F.when(line.rlike(_TABLE_LINE), read_row(line)).otherwise(line)), "\n")
    for pattern, replacement in _AFTER_TABLES:
        text = F.regexp_replace(text, pattern, replacement)
    return strip(text)


def for_mode(c, mode: str = "source") -> Column:
    text = strip_page_heading(c)
    return markdown_to_prose(text) if mode == "prose" else text


def comparable(c, mode: str = "source") -> Column:
    return collapse(for_mode(c, mode))
