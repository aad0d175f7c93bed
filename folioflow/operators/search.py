"""Full-text search.

Counting and locating matches is one narrow stage over the documents; only the ranked page of
results is ordered, and snippets are cut for that page alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.markdown import markdown_to_prose
from folioflow.functions.text import let, pdf_path_of, strip
from folioflow.operators.pages import page_at

_WORD = r"[\p{L}\p{N}_]"


def query_pattern(query: str, match_case: bool = False, whole_word: bool = False) -> str:
    """Regex for a literal query; a word boundary is a change between word and other characters."""
    body = re.escape(query)
    if whole_word:
        is_word = lambda ch: ch == "_" or ch.isalnum()
        before = rf"(?<!{_WORD})" if is_word(query[0]) else rf"(?<={_WORD})"
        after = rf"(?!{_WORD})" if is_word(query[-1]) else rf"(?={_WORD})"
        body = before + body + after
    return ("(?U)" if match_case else "(?iU)") + body


def clean_query(query: str) -> str:
    return (query or "").strip()


def match_count(text, query: str, match_case: bool = False, whole_word: bool = False) -> Column:
    return F.regexp_count(F.col(text), F.lit(query_pattern(query, match_case, whole_word))).cast("bigint")


def first_starts(text, query: str, k: int, match_case: bool = False, whole_word: bool = False) -> Column:
    """Offsets of the first ``k`` matches. A match is as long as the query, so the cuts give them."""
    width = len(query)
    cut = F.split(F.col(text), query_pattern(query, match_case, whole_word), k + 1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        here = (acc["at"] + F.length(piece)).cast("bigint")
        return F.struct((here + width).cast("bigint").alias("at"), F.concat(acc["found"], F.array(here)).alias("found"))

    return let(cut, lambda c: F.aggregate(F.slice(c, 1, F.size(c) - 1), start, step, lambda acc: acc["found"]))


def snippet(text: Column, start: Column, end: Column, page: Column | None = None) -> Column:
    """The words around a match: up to 70 characters each side, cut at blanks, with the match's
    place inside the snippet."""
    left0 = F.greatest(start - K.SNIPPET_RADIUS, F.lit(0))
    right0 = F.least(end + K.SNIPPET_RADIUS, F.length(text))
    before = F.substring(text, (left0 + 1).cast("int"), (start - left0).cast("int"))
    after = F.substring(text, (end + 1).cast("int"), (right0 - end).cast("int"))
    left = left0 + F.when(left0 > 0, F.instr(before, " ")).otherwise(0)

    def place(right: Column) -> Column:
        edges = F.struct(
            left.alias("left"), right.alias("right"), F.length(text).alias("length"),
            F.substring(text, (left + 1).cast("int"), (right - left).cast("int")).alias("raw"))

        def build(e: Column) -> Column:
            trimmed = F.length(e["raw"]) - F.length(F.ltrim(e["raw"], F.lit(K.SPACE_CHARS)))
            fields = [
                strip(F.replace(e["raw"], F.lit("\n"), F.lit(" "))).alias("text"),
                (start - e["left"] - trimmed).cast("bigint").alias("match_start"),
                (end - e["left"] - trimmed).cast("bigint").alias("match_end"),
                (e["left"] > 0).alias("prefix_truncated"), (e["right"] < e["length"]).alias("suffix_truncated")]
            return F.struct(*fields, *([] if page is None else [page.alias("page")]))

        return let(edges, build)

    last_blank = F.instr(F.reverse(after), " ")
    right = F.when((right0 < F.length(text)) & (last_blank > 0), end + F.length(after) - last_blank).otherwise(right0)
    return let(right, place)


def first_k(df: DataFrame, query: str, k: int = 5, match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """The first ``k`` matches of each document, one row each: ``ordinal, start`` and the snippet."""
    keys = [c for c in df.columns if c != "text"]
    hits = df.select(*keys, "text", F.posexplode(first_starts("text", query, k, match_case, whole_word)).alias("_at", "start"))
    found = hits.withColumn("_hit", snippet(
        F.col("text"), F.col("start"), F.col("start") + len(query), page_at("text", F.col("start"))))
    return found.select(*keys, F.col("_at").cast("bigint").alias("ordinal"), "start",
                        *[F.col("_hit")[n].alias(n) for n in (
                            "text", "match_start", "match_end", "prefix_truncated", "suffix_truncated", "page")])


def matching(df: DataFrame, query: str, match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """Documents that contain the query, with their number of matches.

    The filter stops at the first match of a text; only texts that have one are counted, once.
    """
    found = df.filter(F.col("text").rlike(query_pattern(query, match_case, whole_word)))
    return found.withColumn("match_count", match_count("text", query, match_case, whole_word))


# --- trigram postings ---------------------------------------------------------------------------------
#: Characters that a pattern without case matches to an ASCII letter.
FOLDED, FOLD = "ſKıİ" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "skii" + "abcdefghijklmnopqrstuvwxyz"
_GRAM = r"(?=([\x00-\x7F]{3}))"
RAREST_GRAMS = 4
NARROW_SHARE = 0.5


def trigrams(text: Column) -> Column:
    """The distinct runs of three ASCII characters, without case; whatever contains a text as a match holds those of it."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, FOLDED, FOLD), F.lit(_GRAM), F.lit(1)))


def build_index(df: DataFrame, path: str, key: str = "doc") -> None:
    """Store which documents hold which trigram, ordered by trigram so that a lookup reads few row groups.

    A trigram of nearly all documents is spread over as many files as its postings need.
    """
    postings = df.select(F.col(key).alias("doc"), F.explode(trigrams(F.col("text"))).alias("gram"))
    postings.repartitionByRange("gram", "doc").sortWithinPartitions("gram", "doc").write.mode("overwrite").parquet(f"{path}/postings")
    stored = df.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("gram").agg(F.count(F.lit(1)).alias("docs")).write.mode("overwrite").parquet(f"{path}/grams")
    df.agg(F.count(F.lit(1)).alias("docs")).write.mode("overwrite").parquet(f"{path}/size")


def narrowed(df: DataFrame, index: str, query: str, key: str = "doc") -> DataFrame:
    """The documents that hold the rarest trigrams of the query; all of them where that rules out too few to pay.

    Only a necessary test: the exact pattern decides on what is left.
    """
    spark, folded = df.sparkSession, query.translate(str.maketrans(FOLDED, FOLD))
    grams = {folded[i : i + 3] for i in range(len(folded) - 2) if folded[i : i + 3].isascii()}
    if not grams:
        return df
    counts = {r["gram"]: r["docs"] for r in spark.read.parquet(f"{index}/grams").filter(F.col("gram").isin(*grams)).collect()}
    if len(counts) < len(grams):
        return df.limit(0)
    chosen = sorted(grams, key=lambda g: (counts[g], g))[:RAREST_GRAMS]
    if counts[chosen[0]] > NARROW_SHARE * spark.read.parquet(f"{index}/size").first()["docs"]:
        return df
    postings = spark.read.parquet(f"{index}/postings").filter(F.col("gram").isin(*chosen)).distinct()
    held = postings.groupBy(F.col("doc").alias(key)).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(chosen))
    return df.join(held.select(key), key, "left_semi")


def rank_key(key: str = "doc") -> list[Column]:
    return [-F.col("match_count"), F.lower("folder"), F.lower("name"), F.col(key)]


def rank_results(df: DataFrame, limit: int, offset: int = 0, key: str = "doc", after: tuple | None = None) -> DataFrame:
    """One page in rank order: behind ``offset`` results, or behind the result ``after`` (match_count, folder, name, key),
    which costs no more for a late page than for the first."""
    if after is not None:
        count, folder, name, last = after
        df = df.filter(F.struct(*rank_key(key)) > F.struct(F.lit(-count).cast("bigint"), F.lower(F.lit(folder)), F.lower(F.lit(name)), F.lit(last).cast(df.schema[key].dataType)))
    return df.orderBy(*rank_key(key)).offset(max(0, offset)).limit(limit)


def search(
    df: DataFrame, query: str, match_case: bool = False, whole_word: bool = False, max_documents: int = 100,
    max_matches: int = 5, offset: int = 0, index: str | None = None, after: tuple | None = None,
) -> DataFrame:
    """One page of ranked results over documents ``doc, name, folder, text``; an empty query has none.

    The caller's limits hold as given. Only keys are ranked; the texts of the page's documents join them afterwards.
    ``index`` names the trigram postings of the same documents, ``after`` the last result of the page before.
    """
    query = clean_query(query)
    df = narrowed(df, index, query) if index and query else df
    limit, per_document = max(1, max_documents), max(1, max_matches)
    found = matching(df, query or "x", match_case, whole_word).select("doc", "folder", "name", "match_count")
    ranked = rank_results(found if query else found.limit(0), limit, offset, after=after).select("doc", "match_count")
    joined = df.join(ranked, "doc").select(*df.columns, "match_count")
    page = joined.orderBy(F.desc("match_count"), F.lower("folder"), F.lower("name"), "doc")
    starts = page.withColumn("_starts", first_starts("text", query or "x", per_document, match_case, whole_word))
    width = len(query)
    hits = F.transform("_starts", lambda s: snippet(F.col("text"), s, s + width, page_at("text", s)))
    out = starts.withColumn("matches", hits).drop("text", "_starts")
    if "markdown_path" in df.columns:
        out = out.withColumn("pdf_path", pdf_path_of("markdown_path"))
    return out


def search_summary(
    df: DataFrame, query: str, match_case: bool = False, whole_word: bool = False, max_documents: int = 100, offset: int = 0
) -> DataFrame:
    """Totals over all matching documents, whatever page of them is shown."""
    query = clean_query(query)
    counts = df.select(match_count("text", query, match_case, whole_word).alias("n")) if query else df.select(
        F.lit(0).cast("bigint").alias("n"))
    matched = F.count(F.when(F.col("n") > 0, 1))
    searched = F.count(F.lit(1)) if query else F.lit(0).cast("bigint")
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"), matched.alias("documents_matched"),
        searched.alias("documents_searched"))
    return totals.select(
        "*", (F.col("documents_matched") > max_documents).alias("truncated"),
        (F.col("documents_matched") > offset + max_documents).alias("has_more"))


def search_pages(pages: DataFrame, query: str, match_case: bool = False) -> DataFrame:
    """Matches as (page, ordinal within the page) over the words each page renders to."""
    query = clean_query(query)
    keys = [c for c in pages.columns if c != "text"]
    prose = pages.withColumn("_prose", markdown_to_prose("text"))
    found = F.transform(
        F.regexp_extract_all("_prose", F.lit(query_pattern(query or "x", match_case)), F.lit(0)), lambda m, i: i.cast("bigint"))
    hits = prose.select(*keys, F.explode(found).alias("ordinal"))
    return hits if query else hits.limit(0)


def quick_open(df: DataFrame, query: str, k: int = K.QUICK_OPEN_LIMIT) -> DataFrame:
    """Documents whose folder and name hold every term, best first.

    A term scores 3 where the folder starts with it, 2 where the folder contains it or the name
    starts with it, else 1.
    """
    terms = query.lower().split()
    if not terms:
        return df.orderBy("folder", "name").limit(k).withColumn("score", F.lit(0).cast("bigint"))
    name, folder = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("folder", F.lit("")))
    whole = F.concat(folder, F.lit(" "), name)
    every, score = F.lit(True), F.lit(0)
    for term in terms:
        every = every & whole.contains(term)
        score = score + F.when(folder.startswith(term), 3).when(folder.contains(term), 2).when(
            name.startswith(term), 2).otherwise(1)
    return df.filter(every).withColumn("score", score.cast("bigint")).orderBy(F.desc("score"), "name", "doc").limit(k)
