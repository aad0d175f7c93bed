"""Queries that write files from the driver's tables and read them back, and queries over callers' functions.

Files lie below the shared folder; what the SQL states is what the tables put into them.
"""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions import text as T
from folioflow.operators import combine as CO
from folioflow.operators import deflate as D
from folioflow.operators import inventory as I
from folioflow.operators import ledger as L
from folioflow.operators import planning as PL
from folioflow.operators.cost import RATE_FIELDS
from folioflow.operators.ordering import scan_in_order
from folioflow.plans import data as X
from folioflow.plans.oracles import ANSWERS, EXACT, GROUPS, HEAD_SQL, LIBRARY_DOCS, NL, RULE, WS, h16, oracle, strip
from folioflow.plans.queries import EXACT as EXACT_SCAN
from folioflow.plans.queries import _responses, _scan, query
from folioflow.plans.storage import materialise, scratch_path
from folioflow.sources import files as S
from folioflow.sources.document_sink import write_documents

MARKDOWN, LIGHT, CONSOLIDATED = K.MARKDOWN_DIR, K.LIGHTWEIGHT_DIR, K.CONSOLIDATED_DIR


def numbered(ordered: DataFrame) -> DataFrame:
    """The rows of a sorted table with their positions."""
    stored = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    return scan_in_order(stored, [F.col("_at")], "position").drop("_at")


# --- workspaces ---------------------------------------------------------------------------------------------
def _workspace(spark, sf) -> str:
    """A workspace with a transcript per document; some have lightweight copies, consolidations, indexes and PDFs."""
    root = scratch_path(spark, "workspace")
    d = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("none")).alias("s"), "text")
    name = F.col("id").cast("string")
    files = lambda where, text, *parts: d.filter(where).select(F.concat(*parts).alias("file"), text.alias("text"))
    folder = lambda f: (F.col("s"), F.lit(f"/{f}/"), name)
    pdf = F.when(F.col("id") % 2 == 0, name).otherwise(F.concat(F.lit("x"), name))
    tree = [files("true", F.col("text"), *folder(MARKDOWN), F.lit(".md")), files("id % 5 = 0", F.lit("light"), *folder(LIGHT), F.lit(".md")),
            files("id % 7 = 0", F.lit("all"), *folder(CONSOLIDATED), F.lit(".md")),
            files("id % 9 = 0", F.lit("index"), *folder(MARKDOWN), F.lit(f"{K.INDEX_SUFFIX}")),
            files("true", F.lit("%PDF"), F.col("s"), F.lit("/"), pdf, F.lit(".pdf")), files("id % 11 = 0", F.lit("%PDF"), name, F.lit(".pdf"))]
    for part in tree[1:]:
        tree[0] = tree[0].unionByName(part)
    write_documents(tree[0], root, F.col("file"), F.col("text"))
    return root


@query
def workspace_transcripts(spark, sf):
    found = S.as_corpus(S.corpus_transcripts(S.read_transcripts(spark, _workspace(spark, sf))))
    return found.select("entity", "name", T.text_hash("text").alias("text_hash"), T.octets("text").alias("size"))


@query
def workspace_catalogue(spark, sf):
    return numbered(I.order_catalogue(S.markdown_catalogue(spark, _workspace(spark, sf)))).select(
        "position", "folder", "name", "is_consolidated", "is_lightweight", F.col("size").cast("bigint").alias("size"))


@query
def workspace_candidates(spark, sf):
    found = I.deflate_candidates(S.markdown_catalogue(spark, _workspace(spark, sf)))
    return numbered(I.order_candidates(found)).select("position", "entity", "name", "size", "deflated_size")


@query
def workspace_pdfs(spark, sf):
    root = _workspace(spark, sf)
    base = os.path.abspath(urlparse(root).path) + "/"
    counts = X.table(spark, sf, "documents").filter("doc_id % 2 = 0").select(
        F.concat(F.lit(base), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
        (F.col("n_chars") % 50).alias("total_pages"))
    return numbered(I.order_inventory(S.pdf_inventory(spark, root, counts), "pages_desc")).select("position", "folder", "name", "is_converted", "total_pages")


@query
def lightweight_files(spark, sf):
    """Every document's lightweight text is one file; a dry run leaves none."""
    root = scratch_path(spark, "lightweight")
    d = X.table(spark, sf, "documents")
    doc = F.concat(F.coalesce("source", F.lit("none")), F.lit(f"/{MARKDOWN}/"), F.col("doc_id").cast("string"), F.lit(".md"))
    results = d.select(doc.alias("doc"), F.concat(F.lit("light "), F.col("text")).alias("content"))
    dry = S.write_lightweight(results, root + "-dry", "dry-run")
    S.write_lightweight(results, root)
    read = S.read_whole(spark, root, "*").select("path", T.text_hash("value").alias("text_hash"))  # the join moves no text
    parts = F.split("path", "/")
    stored = F.lit(S._exists(spark, root + "-dry"))
    return read.join(dry.filter("NOT written").select(F.concat(F.lit("/"), "output").alias("output")), F.col("path").endswith(F.col("output")) & (
        F.element_at(parts, -3) == F.split("output", "/")[1]) & (F.element_at(parts, -1) == F.element_at(F.split("output", "/"), -1))).select(
            F.expr("substring(output, 2)").alias("output"), "text_hash", stored.alias("dry_run_stored"))


@query
def consolidated_lines(spark, sf):
    """Lines of a combined document, written in parts and read again, with how often each occurs."""
    path = scratch_path(spark, "consolidated")
    S.write_consolidated(CO.combine(X.library_documents(spark, sf), title="All filings", sort_mode="alpha_asc", generated_at="2024-01-01 00:00"), path)
    lines = spark.read.text(path).select(T.strip("value").alias("line")).filter("line <> ''")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query
def report_tables(spark, sf):
    """A report inside the lightweight area: stored, and no transcript."""
    path = scratch_path(spark, "report")
    S.write_report({"languages": X.table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))}, path)
    stored = spark.read.parquet(f"{path}/{LIGHT}/_report/languages")
    return stored.withColumn("transcripts", F.lit(S.read_transcripts(spark, path).count()).cast("bigint"))


# --- page files, response lines, rate cards, plans -----------------------------------------------------------
@query
def page_files(spark, sf):
    """Two thirds of the pages lie stamped below their model, the others in the older layout."""
    root = scratch_path(spark, "page-files")
    pages = X.conversation_pages(spark, sf)
    place = F.concat(F.lit("F"), (F.col("doc") % 4).cast("string"), F.lit("/c"), F.col("doc").cast("string"), F.format_string("/page_%03d.md", "page_num"))
    new = F.col("page_num") % 3 != 0
    stamp = F.lit(f"<!-- {K.PROVENANCE_TAG}: model=m-1 converted=2024-01-02T03:04:05Z prompt=p -->\n")
    write_documents(pages, root, F.when(new, F.concat(F.lit("models/m-1/"), place)).otherwise(place), F.when(new, F.concat(stamp, "text")).otherwise(F.col("text")))
    return S.read_page_files(spark, root).select("model", "folder", "stem", "page_num", T.text_hash(T.strip("text")).alias("text_hash"), "prompt")


@query
def batch_response_lines(spark, sf):
    """Lines delivered twice, in two writes, the second with a broken line."""
    path = scratch_path(spark, "responses")
    pages, key = X.conversation_pages(spark, sf), F.format_string("doc%03d_p%03d", F.col("doc"), F.col("page_num"))
    text = F.when(F.col("role") == "assistant", F.col("text")).otherwise(" ")
    line = lambda value: F.to_json(F.struct(key.alias("key"), F.struct(F.array(F.struct(
        F.lit("STOP").alias("finishReason"), F.struct(F.array(F.struct(value.alias("text"))).alias("parts")).alias("content"))).alias("candidates")).alias("response")))
    pages.select(line(F.concat(F.lit("old "), text)).alias("line")).filter(F.col("role") == "assistant").select("line").write.mode("append").text(path)
    pages.select(line(text).alias("line")).unionByName(spark.createDataFrame([("{oops",)], "line string")).write.mode("append").text(path)
    return L.collect_results(S.read_batch_responses(spark, path), pages.select(key.alias("key"), "doc", "page_num")).select("doc", "page_num", "text")


@query
def rate_card_files(spark, sf):
    """A card per size of parts; those of odd sizes have the older form, without a time."""
    root = scratch_path(spark, "cards")
    part = X.table(spark, sf, "part")
    rates = F.struct(*[(F.col("p_retailprice") * (i + 1)).alias(f) for i, f in enumerate(RATE_FIELDS)])
    cards = part.select("p_size", F.struct(F.concat(F.lit("m"), F.col("p_partkey").cast("string")), rates).alias("e")).groupBy("p_size").agg(
        F.map_from_entries(F.collect_list("e")).alias("models"))
    new = F.to_json(F.struct(F.lit("2024-01-02T03:04:05+00:00").alias("synced_at"), "models"))
    write_documents(cards, root, F.concat(F.col("p_size").cast("string"), F.lit(".json")), F.when(F.col("p_size") % 2 == 0, new).otherwise(F.to_json("models")))
    return S.read_rate_card(spark, root).select("model_id", *RATE_FIELDS, (F.year("synced_at") == 2024).alias("dated"))


@query
def stored_plans(spark, sf):
    """A plan per customer, one file each, beside a file that is no plan."""
    path = scratch_path(spark, "plans")
    orders = X.table(spark, sf, "orders")
    group = F.struct(F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("state"),
                     (F.col("o_orderkey") % 90).alias("pages"))
    plans = orders.groupBy(F.concat(F.lit("plan_"), F.col("o_custkey").cast("string")).alias("id")).agg(F.sort_array(F.collect_list(group)).alias("groups"))
    S.write_plans(plans.select("id", F.lit(X.MODEL).alias("model"), "groups"), path)
    write_documents(spark.createDataFrame([("bad.json", "{oops")], "file string, text string"), path, F.col("file"), F.col("text"))
    groups = S.plan_groups(S.read_plans(spark, path))
    return groups.select("plan_id", "model", F.col("pos").cast("bigint").alias("pos"), "group", "state", "pages", F.col("retry_pass").cast("bigint").alias("retry_pass"))


# --- selection, classifier, ladder, unions, claims --------------------------------------------------------------
@query
def admission_only(spark, sf):
    groups = X.order_groups(spark, sf).select("plan_id", "group_no", "group", "state", "pages", "missing", "retry_pass")
    return PL.admit(groups, ["plan_id", "group_no"], budget=4_000_000, only="GROUP 1", max_new=20).select("plan_id", "group_no", "turn", "next_state")


def _judge(batch):
    """Fails on some passages, gives no valid answer on others."""
    if (batch["files"] % 5 == 0).any():
        raise RuntimeError("the service failed")
    return ["perhaps" if n % 7 == 0 else "strip" if n % 2 == 0 else "keep" for n in batch["files"]]


@query
def classified_candidates(spark, sf):
    scanned, threshold, _ = _scan(spark, sf, EXACT_SCAN)
    candidates = scanned.library.filter(D.is_boilerplate(threshold, 2))
    known = candidates.filter("fp < '4'").select("fp", F.lit("keep").alias("verdict"))
    return D.classify(candidates, _judge, known)


def _transcribe(batch, prompt):
    """Accepts a page from a pass on that depends on the page; some pages never."""
    number = [K.PRESET_PROMPT, *K.RETRY_PROMPTS].index(prompt)
    return [f"{prompt} {d} {p}" if (d + p) % 6 <= number else " " for d, p in zip(batch["doc"], batch["page_num"])]


@query
def conversion_passes(spark, sf):
    """The ladder stopped after two passes, then run again to its end."""
    path, pages = scratch_path(spark, "passes"), X.conversation_pages(spark, sf).select("doc", "page_num")
    transcribe = lambda batch, prompt: batch.assign(t=_transcribe(batch, prompt))["t"]
    L.convert_in_passes(pages, transcribe, X.MODEL, path, 2)
    converted, refused = L.convert_in_passes(pages, transcribe, X.MODEL, path)
    return converted.select("doc", "page_num", "prompt", F.col("retry_pass").cast("bigint").alias("retry_pass"), "text").unionByName(
        refused, allowMissingColumns=True)


@query
def prepared_corpus(spark, sf):
    """Targets that are no references join them; references that are no targets are read only."""
    docs = X.corpus(spark, sf)
    return D.prepare(docs.filter("doc % 3 <> 0"), docs.filter("doc % 2 = 0")).select("doc", "written")


@query
def orphan_claims(spark, sf):
    """Passages, one per source; no written document holds those of odd sources."""
    kept = F.struct(F.lit(-1).cast("bigint").alias("doc"), F.lit("kept").alias("name"))
    odd = F.col("source").rlike("[13579]$")
    d = X.table(spark, sf, "documents").filter("source is not null").select(
        F.col("source").alias("match_fp"), F.col("doc_id").alias("doc"), F.col("n_chars").alias("visit"), F.col("doc_id").alias("section_ord"),
        F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"), F.when(~odd, kept).alias("canonical"))
    return D.claim_orphans(d).select("doc", F.col("canonical.doc").alias("holder"), F.col("canonical.name").alias("name"))


SRC = "coalesce(source, 'none')"
TREE = f"""tree AS (SELECT doc_id AS id, {SRC} AS s, '{MARKDOWN}' AS kind, text FROM documents
  UNION ALL SELECT doc_id, {SRC}, '{LIGHT}', 'light' FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, {SRC}, '{CONSOLIDATED}', 'all' FROM documents WHERE doc_id % 7 = 0)"""
oracle(
    workspace_transcripts=f"SELECT {SRC} AS entity, doc_id || '.md' AS name, {h16('text')} AS text_hash, strlen(text)::BIGINT AS size FROM documents",
    workspace_catalogue=f"""WITH {TREE}, f AS (SELECT s || CASE WHEN kind = '{CONSOLIDATED}' THEN '/{CONSOLIDATED}' ELSE '' END AS folder, id || '.md' AS name, kind = '{CONSOLIDATED}' AS is_consolidated,
        kind = '{LIGHT}' AS is_lightweight, strlen(text)::BIGINT AS size, s || '/' || kind || '/' || id || '.md' AS path FROM tree)
      SELECT row_number() OVER (ORDER BY folder, is_consolidated::INT, name, path) AS position, folder, name, is_consolidated, is_lightweight, size FROM f""",
    workspace_candidates=f"""SELECT row_number() OVER (ORDER BY lower({SRC}), doc_id || '.md', {SRC}) AS position, {SRC} AS entity, doc_id || '.md' AS name, strlen(text)::BIGINT AS size,
        CASE WHEN doc_id % 5 = 0 THEN 5 END::BIGINT AS deflated_size FROM documents""",
    workspace_pdfs=f"""WITH p AS (SELECT {SRC} AS folder, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'x' END || doc_id || '.pdf' AS name, doc_id % 2 = 0 AS is_converted,
        CASE WHEN doc_id % 2 = 0 THEN n_chars % 50 END AS total_pages, {SRC} || '/' AS place FROM documents
        UNION ALL SELECT '{K.ROOT_FOLDER_LABEL}', doc_id || '.pdf', false, NULL, '' FROM documents WHERE doc_id % 11 = 0)
      SELECT row_number() OVER (ORDER BY coalesce(total_pages, 0) DESC, place || name) AS position, folder, name, is_converted, total_pages FROM p""",
    lightweight_files=f"SELECT {SRC} || '/{LIGHT}/' || doc_id || '.md' AS output, {h16(chr(39) + 'light ' + chr(39) + ' || text')} AS text_hash, false AS dry_run_stored FROM documents",
    consolidated_lines=f"""WITH {LIBRARY_DOCS}, {HEAD_SQL.format(order='lower(title), doc', title=chr(39) + 'All filings' + chr(39))},
        l AS (SELECT trim(unnest(string_split(text, {NL})), {WS}) AS line FROM parts) SELECT line, count(*) AS n FROM l WHERE line <> '' GROUP BY line""",
    report_tables="SELECT lang, count(*) AS documents, 0::BIGINT AS transcripts FROM documents GROUP BY lang",
    page_files=f"""SELECT CASE WHEN (turn + 1) % 3 <> 0 THEN 'm-1' END AS model, 'F' || conv_id % 4 AS folder, 'c' || conv_id AS stem, turn + 1 AS page_num, {h16(strip('text'))} AS text_hash,
        CASE WHEN (turn + 1) % 3 <> 0 THEN 'p' END AS prompt FROM conversations WHERE {strip('text')} <> ''""",
    batch_response_lines=f"WITH {ANSWERS} SELECT doc, page_num, text FROM fresh",
    rate_card_files="SELECT 'm' || p_partkey AS model_id, " + ", ".join(f"p_retailprice * {i + 1} AS {f}" for i, f in enumerate(RATE_FIELDS))
    + ", p_size % 2 = 0 AS dated FROM part",
    stored_plans=f"""SELECT 'plan_' || o_custkey AS plan_id, '{X.MODEL}' AS model, row_number() OVER (PARTITION BY o_custkey ORDER BY 'g' || o_orderkey) - 1 AS pos,
        'g' || o_orderkey AS "group", o_orderstatus AS state, o_orderkey % 90 AS pages, 0::BIGINT AS retry_pass FROM orders""",
    admission_only=f"""WITH {GROUPS}, p AS (SELECT *, pages * 1262 AS cost, CASE WHEN missing > 0 THEN pages * 1262 ELSE 0 END AS used, (missing > 0)::INT AS sends
        FROM grps WHERE state = 'pending' AND contains(lower(grp), 'group 1')),
        r AS (SELECT *, row_number() OVER w AS turn, sum(used) OVER w - used AS before, sum(sends) OVER w - sends AS sent FROM p WINDOW w AS (ORDER BY plan_id, group_no))
      SELECT plan_id, group_no, turn, CASE WHEN missing > 0 THEN 'submitted' WHEN retry_pass > 0 THEN 'collected' ELSE 'complete' END AS next_state
      FROM r WHERE turn < coalesce((SELECT min(turn) FROM r WHERE before + cost > 4000000 OR sent >= 20), turn + 1)""",
    classified_candidates=f"""WITH {EXACT} SELECT fp, CASE WHEN fp < '4' THEN 'keep' WHEN files % 5 = 0 OR files % 7 = 0 THEN NULL WHEN files % 2 = 0 THEN 'strip' ELSE 'keep' END AS verdict
      FROM lib WHERE {RULE}""",
    conversion_passes=f"""WITH p AS (SELECT conv_id AS doc, turn + 1 AS page_num, (conv_id + turn + 1) % 6 AS n FROM conversations),
        w AS (SELECT *, ['{K.PRESET_PROMPT}', '{"', '".join(K.RETRY_PROMPTS)}'][n + 1] AS asked FROM p)
      SELECT doc, page_num, CASE WHEN n > 0 THEN asked END AS prompt, CASE WHEN n < 5 THEN n END AS retry_pass, asked || ' ' || doc || ' ' || page_num AS text FROM w""",
    prepared_corpus="SELECT doc_id AS doc, doc_id % 2 = 0 AS written FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0",
    orphan_claims="""WITH d AS (SELECT *, regexp_matches(source, '[13579]$') AS odd FROM documents WHERE source IS NOT NULL),
        c AS (SELECT source, arg_min(doc_id, (n_chars, doc_id)) AS first FROM d GROUP BY source)
      SELECT doc_id AS doc, CASE WHEN odd THEN first ELSE -1 END AS holder, CASE WHEN odd THEN 'n' || first ELSE 'kept' END AS name FROM d JOIN c USING (source)""",
)
