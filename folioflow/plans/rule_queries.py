"""Queries for rules that the driver's texts never meet, over texts composed from its tables.

The composed parts are known, so most SQL counterparts state the expected outcome by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions import text as T
from folioflow.operators import combine as CO
from folioflow.operators import inventory as I
from folioflow.operators import ledger as L
from folioflow.operators import reports as R
from folioflow.plans import data as X
from folioflow.plans.oracles import NL, WS, h16, oracle
from folioflow.plans.queries import query
from folioflow.plans.storage import scratch_path
from folioflow.sources.files import read_page_cache, write_page_cache
from folioflow.streaming import jobs as ST

HEADINGS = ["Going concern review", "Statement of directors' responsibilities", "Balance Sheet", "Notes", "KPI overview",
            "Income statement and dividend", None, "Responsibilities of the auditor"]
ENDINGS = ["", " All is well except for this.", " Mr A was appointed on 3 May 2024.", " The clerk was appointed by nobody.",
           "\n| a | b |\n", " A contingent liability.", " Ms B (resigned later) left."]


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''").replace("\n", f"' || {NL} || '") + "'"


def _guarded(spark, sf) -> DataFrame:
    """Documents under one of the headings, their texts with one of the endings."""
    d = X.table(spark, sf, "documents")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    return d.select(
        F.col("doc_id").alias("doc"), pick(HEADINGS, F.col("doc_id") % len(HEADINGS)).alias("heading"),
        F.concat(F.coalesce("text", F.lit("")), pick(ENDINGS, F.floor(F.col("doc_id") / len(HEADINGS)) % len(ENDINGS))).alias("body"))


@query
def guard_flags(spark, sf):
    return _guarded(spark, sf).select(
        "doc", T.is_protected("heading", "body").alias("is_protected"), T.is_financial("heading").alias("is_financial"),
        T.has_table("body").alias("has_table"))


@query
def guarded_sections(spark, sf):
    """The protected report over passages of equal heading and ending."""
    rows = _guarded(spark, sf).withColumn("ending", F.floor(F.col("doc") / len(HEADINGS)) % len(ENDINGS))
    library = rows.groupBy("heading", "ending").agg(
        F.bool_or(T.is_protected("heading", "body")).alias("is_protected"), F.bool_or(T.is_financial("heading")).alias("is_financial"),
        F.count(F.lit(1)).alias("files"))
    return R.protected_sections(library.withColumn("fp", T.text_hash(F.concat_ws("|", "heading", F.col("ending").cast("string")))))


def _any(text: str, words: list[str]) -> str:
    return f"len(list_filter([{', '.join(quoted(w) for w in words)}], lambda k: contains({text}, k))) > 0"


_BOARD = (r"(?im)(?:appointed|resigned|retired)\s*(?:on|with\s+effect\s+from|from)?\s*\d{1,2}\s+\w+\s+\d{4}"
          r"|\(\s*(?:appointed|resigned|retired)\b[^)]*\)|^\s*[-*•|]\s*[^\n]*\b(?:appointed|resigned|retired)\b")
GUARDED = f"""g AS (SELECT doc_id AS doc, [{', '.join(map(quoted, HEADINGS))}][doc_id % {len(HEADINGS)} + 1] AS heading,
  coalesce(text, '') || [{', '.join(map(quoted, ENDINGS))}][(doc_id // {len(HEADINGS)}) % {len(ENDINGS)} + 1] AS body FROM documents),
r AS (SELECT doc, heading, coalesce(lower(heading), '') AS h, lower(body) AS b, body FROM g),
f AS (SELECT doc, heading, CASE WHEN contains(h, 'responsibilities') AND (contains(h, 'director') OR contains(h, 'statement')) THEN false
  WHEN {_any('h', K.PROTECTED_HEADING_KEYWORDS)} THEN true
  ELSE {_any('b', K.PROTECTED_BODY_KEYWORDS)} OR regexp_matches(body, '{_BOARD}') END AS is_protected,
  {_any('h', K.FINANCIAL_STATEMENT_KEYWORDS)} AS is_financial, regexp_matches(body, '(?m)^\\|.*\\|') AS has_table FROM r)"""
oracle(
    guard_flags=f"WITH {GUARDED} SELECT doc, is_protected, is_financial, has_table FROM f",
    guarded_sections=f"""WITH {GUARDED}, l AS (SELECT heading, (doc // {len(HEADINGS)}) % {len(ENDINGS)} AS ending, bool_or(is_protected) AS p,
        bool_or(is_financial) AS fin, count(*) AS files FROM f GROUP BY ALL)
      SELECT {h16("concat_ws('|', heading, ending::VARCHAR)")} AS fp, coalesce(heading, '(untitled)') AS heading,
        concat_ws(', ', CASE WHEN fin THEN 'Financial statement' END, CASE WHEN p THEN 'Protected keyword' END) AS reason, files FROM l WHERE p OR fin""",
)


# --- amounts ----------------------------------------------------------------------------------------------
@query
def novel_amounts(spark, sf):
    """Every third order's canonical text lacks its price, which is then new."""
    o = X.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    price = F.format_string("£%d,%03d.50", key % 997 + 1, key % 1000)
    fee = F.concat(F.lit("£"), (key % 90 + 1).cast("string"), F.lit(" million"))
    rows = o.select(key.alias("doc"), F.concat(F.lit("Paid "), price, F.lit(" in all, £nil later and "), fee, F.lit(".")).alias("body"),
                    F.concat(F.when(key % 3 == 0, F.lit("Nothing")).otherwise(price), F.lit(" or £NIL; "), fee).alias("canonical"))
    money = T.money_tokens("body")
    return rows.select("doc", F.array_join(money, "|").alias("money"), T.novel_money(money, T.money_tokens("canonical")).alias("novel"))


oracle(novel_amounts="""WITH a AS (SELECT o_orderkey AS doc, '£' || (o_orderkey % 997 + 1) || ',' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || '.50' AS price,
    '£' || (o_orderkey % 90 + 1) || 'million' AS fee FROM orders)
  SELECT doc, array_to_string(list_sort([price, '£nil', fee]), '|') AS money, doc % 3 = 0 AS novel FROM a""")


# --- scaffolding ------------------------------------------------------------------------------------------
_HEADER = "Acme Trading Limited\nAnnual report and financial statements\nRegistered number 123\n52 weeks ended 3 May 2024\n"


@query
def scaffolding_steps(spark, sf):
    """All steps: stamp, page markers, running headers, both footers, rules and blank lines, each in some texts only."""
    key = F.col("c_custkey")
    part = lambda every, text: F.when(key % every != 0, F.lit(text)).otherwise(F.lit(""))
    stamp = F.concat(F.lit("\nMONDAY\nA1B2\n*AB"), key.cast("string"), F.lit("*\n01/02/2024\n#12\nCOMPANIES HOUSE"))
    text = F.concat(
        F.lit("Opening."), F.when(key % 2 == 0, stamp).otherwise(""), F.lit("\nOne.\n"), part(3, "<!-- Page 4 -->\n## Page 4\n"),
        F.lit("Two 2\n\n"), F.lit(_HEADER), F.lit("Three 3\n"), part(5, _HEADER), F.lit("Four.\n"),
        part(7, "Registered number 9 / 52 weeks ended 3 May 2024 | 17\n"), F.lit("Five.\n"),
        part(11, "Registered number 9 / 52 weeks ended 3 May 2024\n 18\n"), F.lit("Six.\n---\n"), part(13, "\n---\n"),
        F.lit("Seven.\n"), part(17, "## Page 5\n"), F.lit("Eight.\n\n\n\n\n\nNine.\n\n"))
    rows = X.table(spark, sf, "customer").select(key.alias("doc"), T.strip_scaffolding(text).alias("text"))
    # Blank lines left where a line went are layout; the words and rules that stay, and their order, are the result.
    return rows.select("doc", F.regexp_replace("text", r"\n+", "\n").alias("text"), F.expr(r"not text rlike '\n{4,}'").alias("tidy"))


oracle(scaffolding_steps=f"""SELECT c_custkey AS doc, 'Opening.' || {NL} || 'One.' || {NL} || 'Two 2' || {NL} || {quoted(_HEADER)} || 'Three 3' || {NL} ||
    'Four.' || {NL} || 'Five.' || {NL} || 'Six.' || {NL} || '---' || {NL} || 'Seven.' || {NL} || 'Eight.' || {NL} || 'Nine.' || {NL} AS text, true AS tidy FROM customer""")


# --- plain sets, times and caches --------------------------------------------------------------------------
@query
def combine_skipped(spark, sf):
    d = X.table(spark, sf, "documents").select(
        (F.col("doc_id") % 4 == 0).alias("is_consolidated"), (F.col("doc_id") % 6 == 0).alias("is_lightweight"))
    options = [(False, False), (True, False), (False, True), (True, True)]
    parts = [CO.skipped_count(d, c, l).select(F.lit(c).alias("consolidated"), F.lit(l).alias("lightweight"), "skipped") for c, l in options]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query
def occurrences_within_written(spark, sf):
    events = X.table(spark, sf, "events").select("event_id", F.col("user_id").alias("doc"))
    return I.within_written(events, events.filter("event_id % 50 = 0"))


@query
def job_times(spark, sf):
    """Submission times read from job ids; every third id is of another form."""
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("job_"), stamp)).otherwise(F.concat(F.lit("batch_"), stamp))
    e = X.table(spark, sf, "events").select("event_id", name.alias("job_id"))
    return e.select("event_id", F.unix_seconds(T.job_submitted_at("job_id")).alias("seconds"))


@query
def heartbeat_windows(spark, sf):
    e = X.table(spark, sf, "events").select("ts", F.col("user_id").alias("file"))
    beats = ST.heartbeat_counts(e)
    return beats.select(F.unix_seconds("window.start").alias("start"), "file", "beats")


@query
def page_cache_round_trip(spark, sf):
    """Pages are stored, every other one is converted again, blank ones are no conversions."""
    path = scratch_path(spark, "page-cache")
    pages = X.conversation_pages(spark, sf).select("doc", "page_num", "text", F.lit(X.MODEL).alias("model"), F.lit(1).alias("converted"))
    write_page_cache(pages, path)
    write_page_cache(pages.filter("page_num % 2 = 0").withColumns({"text": F.lit("again"), "converted": F.lit(2)}), path)
    write_page_cache(pages.filter("page_num % 2 = 1").withColumns({"text": F.lit(" "), "converted": F.lit(3)}), path)
    return L.newest_pages(read_page_cache(spark, path)).select("doc", "page_num", "text")


@query
def ingested_versions(spark, sf):
    """A stream of file versions, each day of an order line being one, read as the newest of each path."""
    lines = X.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("path"), F.col("l_linenumber").cast("bigint").alias("size"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("mtime"))
    source, table, progress = (scratch_path(spark, f"ingest-{n}") for n in ("source", "table", "progress"))
    lines.repartition(6).write.parquet(source)  # six batches
    ST.ingest_stream(spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(source), table, progress).awaitTermination()
    return ST.ingested(spark, table).select("path", "size", "mtime")


oracle(
    combine_skipped="""SELECT c AS consolidated, l AS lightweight, count(*) FILTER ((NOT c AND doc_id % 4 = 0) OR (NOT l AND doc_id % 6 = 0)) AS skipped
      FROM documents, (VALUES (false), (true)) a(c), (VALUES (false), (true)) b(l) GROUP BY ALL""",
    occurrences_within_written="SELECT event_id, user_id AS doc FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 50 = 0)",
    job_times="SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN epoch_us(date_trunc('second', ts)) // 1000000 END AS seconds FROM events",
    heartbeat_windows="SELECT (epoch_us(ts) // 30000000) * 30 AS start, user_id AS file, count(*) AS beats FROM events GROUP BY ALL",
    page_cache_round_trip=f"""SELECT conv_id AS doc, turn + 1 AS page_num, CASE WHEN turn % 2 = 1 THEN 'again' ELSE text END AS text
      FROM conversations WHERE turn % 2 = 1 OR trim(text, {WS}) <> ''""",
    ingested_versions="""SELECT l_partkey AS path, arg_max(l_linenumber::BIGINT, (l_shipdate, l_linenumber)) AS size, epoch_us(max(l_shipdate)::TIMESTAMP) AS mtime
      FROM lineitem GROUP BY 1""",
)
