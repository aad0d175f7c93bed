"""Registered queries: each operator run over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions import markdown as M
from folioflow.functions import text as T
from folioflow.operators import combine as CO
from folioflow.operators import compare as CM
from folioflow.operators import cost as C
from folioflow.operators import deflate as D
from folioflow.operators import inventory as I
from folioflow.operators import ledger as L
from folioflow.operators import ordering as O
from folioflow.operators import pages as P
from folioflow.operators import planning as PL
from folioflow.operators import reports as R
from folioflow.operators import search as S
from folioflow.operators.sections import split_sections
from folioflow.plans import data as X
from folioflow.plans.storage import materialise, scratch_path
from folioflow.sources.files import lightweight_path
from folioflow.streaming import jobs as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- search ---------------------------------------------------------------------------------------------
@query
def search_count(spark, sf):
    found = S.matching(X.library_documents(spark, sf), "tion")
    return found.select("doc", "folder", "name", "match_count")


@query
def search_ranked(spark, sf):
    page = S.search(X.library_documents(spark, sf), "tion", max_documents=100, max_matches=5)
    return page.select("doc", "folder", "name", "match_count", F.size("matches").cast("bigint").alias("shown"))


@query
def search_first_k(spark, sf):
    return S.first_k(X.library_documents(spark, sf).select("doc", "text"), "tion", 5)


@query
def search_whole_word(spark, sf):
    return S.matching(X.library_documents(spark, sf), "the", whole_word=True).select("doc", "match_count")


@query
def search_totals(spark, sf):
    return S.search_summary(X.library_documents(spark, sf), "Tion", match_case=True)


@query
def search_page_attribution(spark, sf):
    texts = P.document_text(P.assemble(X.conversation_documents(spark, sf), X.conversation_pages(spark, sf)))
    return S.first_k(texts, "en", 5).select("doc", "ordinal", "start", "page")


@query
def search_in_pages(spark, sf):
    pages = X.conversation_pages(spark, sf).select("doc", "page_num", "text")
    return S.search_pages(pages, "en").select("doc", "page_num", "ordinal")


INDEXED = ["nding", "Thand", "tion", "doubl", "sth En", "no such words"]


@query
def search_indexed(spark, sf):
    """Several queries, each over the documents that the trigram postings leave."""
    docs, index = X.library_documents(spark, sf).select("doc", "text"), scratch_path(spark, "trigrams")
    S.build_index(docs, index)
    found = [S.matching(S.narrowed(docs, index, q), q).select(F.lit(q).alias("query"), "doc", "match_count") for q in INDEXED]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


@query
def search_after(spark, sf):
    """The second page of a ranking, found by the last result of the first."""
    docs = X.library_documents(spark, sf)
    first = S.search(docs, "tion", max_documents=100).select("match_count", "folder", "name", "doc")
    last = first.orderBy("match_count", F.lower("folder").desc(), F.lower("name").desc(), F.desc("doc")).first()
    page = S.search(docs, "tion", max_documents=100, after=tuple(last))
    return page.select("doc", "folder", "name", "match_count", F.size("matches").cast("bigint").alias("shown"))


@query
def rank_quick_open(spark, sf):
    return S.quick_open(X.library_documents(spark, sf).select("doc", "folder", "name"), "src1 report 2001").select(
        "doc", "folder", "name", "score")


# --- text rules -----------------------------------------------------------------------------------------
@query
def text_metrics(spark, sf):
    return X.corpus(spark, sf).select(
        "doc", T.word_count("text").alias("words"), F.length("text").cast("bigint").alias("chars"),
        T.octets("text").alias("bytes"), T.estimated_tokens(T.octets("text")).alias("est_tokens"),
        F.size(T.tokens("text")).cast("bigint").alias("tokens"), T.text_hash("text").alias("text_hash"),
        T.exact_hash("text").alias("exact_hash"))


@query
def name_rules(spark, sf):
    d = X.library_documents(spark, sf).select("doc", "title", "folder", "name")
    return d.select(
        "doc", T.slug("title").alias("slug"), T.year_of("title").cast("bigint").alias("year"),
        T.distinguishing_name("name", "folder").alias("short_name"), T.peer_group("title").alias("peer_group"))


@query
def path_rules(spark, sf):
    path = F.concat(F.lit("/ws/"), "folder", F.lit("/Markdown/"), "file_name")
    d = X.library_documents(spark, sf).select("doc", path.alias("path"))
    return d.select(
        "doc", T.entity_of("path").alias("entity"), T.file_stem("path").alias("stem"), T.pdf_path_of("path").alias("pdf_path"),
        T.markdown_path_of(T.pdf_path_of("path")).alias("markdown_path"), lightweight_path("path").alias("light_path"),
        T.is_consolidated("path").alias("is_consolidated"), T.is_lightweight("path").alias("is_lightweight"))


@query
def markdown_to_prose(spark, sf):
    d = X.corpus(spark, sf).select("doc", M.markdown_to_prose("text").alias("prose"))
    return d.select("doc", T.text_hash("prose").alias("prose_hash"), F.length("prose").cast("bigint").alias("chars"))


@query
def unwrap_fences(spark, sf):
    fenced = F.concat(F.lit("```Markdown \n"), "text", F.lit("\n``` \n"))
    coded = F.concat(F.lit("```sql\n"), "text", F.lit("\n```"))
    wrapped = F.when(F.length("text") % 2 == 0, fenced).otherwise(coded)
    return X.corpus(spark, sf).select("doc", T.text_hash(M.unwrap_page_fence(wrapped)).alias("text_hash"))


@query
def strip_provenance(spark, sf):
    stamp = T.stamped("text", F.col("entity"), F.lit("2024-05-06 07:08:09").cast("timestamp"), F.lit("preset"))
    d = X.corpus(spark, sf).select("doc", stamp.alias("page"))
    fields = T.provenance("page")
    return d.select(
        "doc", T.text_hash(T.strip_provenance("page")).alias("text_hash"), fields["model"].alias("model"),
        fields["converted"].alias("converted"), fields["prompt"].alias("prompt"))


@query
def strip_document_header(spark, sf):
    headed = F.concat(F.lit("# Title\n\n> one\n> two\n\n---\n\n"), "text")
    return X.corpus(spark, sf).select("doc", T.text_hash(M.strip_document_header(headed)).alias("text_hash"))


@query
def strip_scaffolding(spark, sf):
    texts = P.document_text(P.assemble(X.conversation_documents(spark, sf), X.conversation_pages(spark, sf)))
    return texts.select("doc", T.strip_scaffolding("text").alias("text"))


# --- boilerplate ------------------------------------------------------------------------------------------
_scans: dict[tuple, D.Scan] = {}
EXACT, NEAR = None, K.DEFAULT_SIMILARITY


def _scan(spark, sf, similarity, written_labelled=False) -> tuple[D.Scan, int, DataFrame]:
    """One stored scan per session, setting and version of the tables, shared by the queries that read it."""
    docs = X.corpus(spark, sf)
    targets = docs.join(X.labelled(spark, sf), "doc", "left_semi") if written_labelled else None
    versions = tuple(_version(spark, f"{sf}/{t}.parquet") for t in ("documents", "labels", "customer"))
    key = (spark.sparkContext.applicationId, sf, similarity, written_labelled, versions)
    corpus = D.prepare(docs, targets, X.families(spark, sf))
    if key not in _scans:
        _scans[key] = D.scan(corpus, D.Options(unit="lines", similarity=similarity))
    return _scans[key], D.effective_threshold(corpus, K.DEFAULT_THRESHOLD), corpus


def _version(spark, path: str) -> tuple:
    """Time of the last change and size of a table's files: a table written anew is scanned anew."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return ()
    return files.getFileStatus(place).getModificationTime(), files.getContentSummary(place).getLength()


def forget_scans() -> None:
    _scans.clear()


@query
def sections_lines(spark, sf):
    stripped = X.corpus(spark, sf).select("doc", T.strip_scaffolding("text").alias("text"))
    rows = split_sections(stripped, unit="lines").withColumn("words", T.word_count("body"))
    return rows.filter(F.col("words") >= K.MIN_SECTION_WORDS).select("doc", "section_ord", "words", "has_table")


@query
def sections_headings(spark, sf):
    texts = P.document_text(P.assemble(X.conversation_documents(spark, sf), X.conversation_pages(spark, sf)))
    rows = split_sections(texts.withColumn("text", T.tidy("text")))
    return rows.select("doc", "section_ord", "heading", F.col("level").cast("bigint").alias("level"), T.text_hash("body").alias("body_hash"))


@query
def masking_hash(spark, sf):
    return _scan(spark, sf, EXACT)[0].sections.select("doc", "section_ord", "form", "exact", "word_count")


@query
def protected_flags(spark, sf):
    return _scan(spark, sf, EXACT)[0].sections.select("doc", "section_ord", "is_protected", "is_financial", "has_table")


@query
def money_tokens(spark, sf):
    rows = split_sections(X.corpus(spark, sf).select("doc", "text"), unit="lines")
    found = rows.select("doc", "section_ord", T.money_tokens("body", "$").alias("m")).filter(F.size("m") > 0)
    return found.select("doc", "section_ord", F.size("m").cast("bigint").alias("amounts"), F.array_join("m", "|").alias("money"))


def _library_columns(library):
    return library.select("fp", "entities", "peer_entities", "files", "is_protected", "word_count", "first_doc",
                          F.col("canonical")["doc"].alias("canonical_doc"))


@query
def boilerplate_exact(spark, sf):
    scanned, threshold, _ = _scan(spark, sf, EXACT)
    return _library_columns(scanned.library.filter(D.is_boilerplate(threshold, 2)))


@query
def boilerplate_peer(spark, sf):
    scanned, _, _ = _scan(spark, sf, EXACT)
    return _library_columns(scanned.library.filter(D.is_boilerplate(5, 2) & (F.col("entities") < 5)))


@query
def boilerplate_near(spark, sf):
    scanned, threshold, _ = _scan(spark, sf, NEAR)
    return _library_columns(scanned.library.filter(D.is_boilerplate(threshold, 2)))


@query
def fingerprint_library(spark, sf):
    return _library_columns(_scan(spark, sf, NEAR)[0].library)


@query
def leader_clusters(spark, sf):
    leaders = _scan(spark, sf, NEAR)[0].clusters.leaders
    return leaders.select("form", F.col("rank.visit").alias("doc"), F.col("rank.section_ord").alias("section_ord"),
                          F.col("n").cast("bigint").alias("n"))


@query
def near_duplicate_links(spark, sf):
    links = _scan(spark, sf, NEAR)[0].clusters.links
    return links.select("form", "leader", F.col("leader_n").cast("bigint").alias("leader_n"), T.rounded(F.col("similarity"), 6).alias("similarity"))


@query
def cluster_assignment(spark, sf):
    return _scan(spark, sf, NEAR)[0].sections.select("doc", "section_ord", "scan_fp", "match_fp")


def _removals(spark, sf, similarity, **kwargs):
    scanned, threshold, _ = _scan(spark, sf, similarity, **kwargs)
    return D.decide(scanned, threshold)


@query
def restatements(spark, sf):
    found = _removals(spark, sf, EXACT).filter("reason = 'restatement'")
    return found.select("doc", "section_ord", "fp", "canonical", "pointer")


@query
def restatement_report(spark, sf):
    return R.restated_passages(_removals(spark, sf, NEAR))


@query
def removals_near(spark, sf):
    return _removals(spark, sf, NEAR).select("doc", "section_ord", "heading", "reason", "canonical", "fp", "pointer")


@query
def canonical_reassign(spark, sf):
    """References are all documents, written are the labelled ones."""
    return _removals(spark, sf, NEAR, written_labelled=True).select("doc", "section_ord", "reason", "fp", "canonical")


def _results(spark, sf, similarity):
    return D.rewrite(X.corpus(spark, sf), _removals(spark, sf, similarity), "lines")


@query
def deflate_file_results(spark, sf):
    return _results(spark, sf, NEAR).select(
        "doc", "entity", "original_size", "lightweight_size", "reduction_pct", "sections_removed")


@query
def deflate_file_results_exact(spark, sf):
    return _results(spark, sf, EXACT).select(
        "doc", "entity", "original_size", "lightweight_size", "reduction_pct", "sections_removed")


@query
def deflate_text(spark, sf):
    return _results(spark, sf, NEAR).select("doc", T.text_hash("content").alias("content_hash"))


@query
def deflate_totals(spark, sf):
    return R.deflate_summary(_results(spark, sf, NEAR))


@query
def scan_counters(spark, sf):
    scanned, threshold, corpus = _scan(spark, sf, NEAR)
    return R.scan_summary(corpus, scanned, threshold)


@query
def patterns_topk(spark, sf):
    scanned, threshold, _ = _scan(spark, sf, NEAR)
    return R.boilerplate_patterns(scanned, threshold).select(
        "fp", "heading", "companies", "filings", "words", T.text_hash("example").alias("example_hash"), "pattern_count")


@query
def protected_report(spark, sf):
    return R.protected_sections(_scan(spark, sf, NEAR)[0].library)


def _verdicts(spark, sf, scanned):
    """Quality label of the passage's first document as the classifier's answer; none without a label."""
    labels = X.table(spark, sf, "labels").select(F.col("doc_id").alias("first_doc"), "quality")
    return scanned.library.join(labels, "first_doc").select(
        "fp", F.when(F.col("quality") == 1, "strip").otherwise("keep").alias("verdict"))


@query
def verdict_gate(spark, sf):
    scanned, threshold, _ = _scan(spark, sf, NEAR)
    safe = D.Scan(scanned.sections, scanned.library, scanned.clusters, D.Options(mode="safe", unit="lines"))
    return D.decide(safe, threshold, _verdicts(spark, sf, scanned)).select("doc", "section_ord", "reason", "fp")


@query
def verification_summary(spark, sf):
    scanned, threshold, _ = _scan(spark, sf, NEAR)
    candidates = scanned.library.filter(D.is_boilerplate(threshold, 2))
    return R.verification_summary(candidates, _verdicts(spark, sf, scanned))


# --- pages ------------------------------------------------------------------------------------------------
def _assembled(spark, sf):
    return P.assemble(X.conversation_documents(spark, sf), X.conversation_pages(spark, sf))


@query
def assemble(spark, sf):
    return _assembled(spark, sf)


@query
def count_pages(spark, sf):
    return P.document_text(_assembled(spark, sf)).select("doc", P.count_pages("text").alias("pages"))


@query
def split_pages(spark, sf):
    return P.split_pages(P.document_text(_assembled(spark, sf)))


@query
def parse_pages_preamble(spark, sf):
    return P.parse_pages(P.document_text(_assembled(spark, sf)))


@query
def split_sequential(spark, sf):
    return P.split_sequential(P.document_text(_assembled(spark, sf)))


# --- consolidation -------------------------------------------------------------------------------------------
@query
def combine_contents(spark, sf):
    docs = CO.with_pages(X.library_documents(spark, sf)).drop("text")
    return CO.contents(CO.order_documents(docs, "chronological_asc"))


@query
def combine_order_desc(spark, sf):
    docs = X.library_documents(spark, sf).drop("text")
    return CO.order_documents(docs, "chronological_desc").select("doc", "title", "position")


@query
def combine_text(spark, sf):
    parts = CO.combine(X.library_documents(spark, sf), title="All filings", sort_mode="alpha_asc", generated_at="2024-01-01 00:00")
    return parts.select(F.col("block").cast("bigint").alias("block"), "position", F.col("line").cast("bigint").alias("line"), "text")


@query
def combine_totals(spark, sf):
    docs = X.library_documents(spark, sf)
    return CO.combine_summary(CO.combine(docs, sort_mode="custom", generated_at="2024-01-01 00:00"), docs)


@query
def collection_label(spark, sf):
    return CO.collection_label(X.library_documents(spark, sf))


@query
def misplaced_consolidations(spark, sf):
    """Labelled documents of low quality carry the header of a combined document, those of high quality quote its banner."""
    labels = X.table(spark, sf, "labels").select(F.col("doc_id").alias("doc"), (F.col("quality") == 0).alias("low"))
    docs = X.library_documents(spark, sf).select("doc", "folder", "file_name", "text").join(labels, "doc", "left")
    path = F.concat(F.lit("/ws/"), "folder", F.lit("/Markdown/"), "file_name")
    quoting = f"# Title\nThe file says {K.CONSOLIDATED_BANNER} on top.\n---\n> {K.CONSOLIDATED_BANNER}: 2\n"
    head = F.when(F.col("low"), f"# Title\n> {K.CONSOLIDATED_BANNER}: 2\n").when(~F.col("low"), quoting).otherwise("")
    text = F.concat(head, F.col("text"))
    return CO.misplaced_consolidations(docs.select(path.alias("path"), text.alias("text")))


# --- comparison ----------------------------------------------------------------------------------------------
def _sides(spark, sf):
    pages = X.conversation_pages(spark, sf).withColumn("pair", F.floor(F.col("doc") / 2).cast("bigint"))
    a = pages.filter(F.col("doc") % 2 == 0).select("pair", "page_num", "text")
    b = pages.filter(F.col("doc") % 2 == 1).select("pair", "page_num", "text")
    return a, b


@query
def compare_pages(spark, sf):
    return CM.compare_pages(*_sides(spark, sf), ["pair"]).select("pair", "page_num", "status")


@query
def compare_summary(spark, sf):
    return CM.compare_summary(CM.compare_pages(*_sides(spark, sf), ["pair"], "prose"), ["pair"])


@query
def page_sets(spark, sf):
    return CM.page_sets(*_sides(spark, sf), ["pair"])


@query
def diff_words(spark, sf):
    diffs = CM.diff_pages(CM.compare_pages(*_sides(spark, sf), ["pair"]))
    side = lambda *ops: F.array_join(F.flatten(F.transform(
        F.filter("ops", lambda o: o["op"].isin(*ops)), lambda o: o["tokens"])), "")
    return diffs.select(
        "pair", "page_num", T.text_hash(side("=", "-")).alias("a_hash"), T.text_hash(side("=", "+")).alias("b_hash"),
        (F.col("inserted") + F.col("deleted")).alias("edits"))


@query
def diff_word_counts(spark, sf):
    return CM.diff_pages(CM.compare_pages(*_sides(spark, sf), ["pair"], "prose")).select(
        "pair", "page_num", "inserted", "deleted", (F.col("added") - F.col("removed")).alias("more_words"))


# --- ledger -----------------------------------------------------------------------------------------------------
def _plan(spark, sf):
    return X.order_documents(spark, sf).select("doc", "folder", "total_pages")


@query
def missing_pages(spark, sf):
    return L.missing_pages(_plan(spark, sf).drop("folder"), X.page_cache(spark, sf), "A").select("doc", "page_num")


@query
def legacy_only(spark, sf):
    return L.legacy_only(_plan(spark, sf).drop("folder"), X.page_cache(spark, sf), "A").select("doc", "page_num")


@query
def document_coverage(spark, sf):
    return L.document_coverage(_plan(spark, sf).drop("folder"), X.page_cache(spark, sf), "R")


@query
def group_coverage(spark, sf):
    members = _plan(spark, sf).withColumnRenamed("total_pages", "pages")
    return PL.group_coverage(members, X.page_cache(spark, sf), "A", ["folder"])


@query
def payload_estimate(spark, sf):
    return L.payload_estimate(_plan(spark, sf), ["folder"])


@query
def batch_requests(spark, sf):
    pages = X.order_pages(spark, sf).select("doc", "page_num").distinct().withColumn("doc_index", F.col("doc"))
    return L.batch_requests(pages, "Transcribe.").select("doc", "page_num", "key", "line")


def _responses(spark, sf):
    """Assistant turns as answers; user turns come back empty with a reason. Read from JSON lines."""
    pages = X.conversation_pages(spark, sf)
    key = F.format_string("doc%03d_p%03d", F.col("doc"), F.col("page_num"))
    spoke = F.col("role") == "assistant"
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.when(spoke, F.array(
        F.struct(F.substring(F.col("text"), F.lit(1), half).alias("text")),
        F.struct(F.substring(F.col("text"), half + 1, F.length("text")).alias("text")))).otherwise(
            F.array(F.struct(F.lit(" ").alias("text"))))
    reason = F.when(spoke, "STOP").when(F.length("text") % 2 == 0, "RECITATION")
    answer = F.struct(F.array(F.struct(reason.alias("finishReason"), F.struct(parts.alias("parts")).alias("content"))).alias("candidates"))
    lines = pages.select("doc", "page_num", "role", key.alias("key"), F.to_json(F.struct(key.alias("key"), answer.alias("response"))).alias("line"))
    # Every other assistant turn was answered once before, with another text.
    old = F.regexp_replace("line", '"text":"', '"text":"superseded ')
    earlier = lines.filter("role = 'assistant' and page_num % 2 = 0").select(old.alias("line"), F.lit(0).alias("seq"))
    delivered = lines.select("line", F.lit(1).alias("seq")).unionByName(earlier)
    parsed = delivered.select(F.from_json("line", L.RESPONSE_SCHEMA).alias("r"), "seq").select("r.*", "seq")
    return parsed, lines.select("key", "doc", "page_num")


@query
def collect_results(spark, sf):
    return L.collect_results(*_responses(spark, sf)).select("doc", "page_num", "text")


@query
def blocked_reasons(spark, sf):
    return L.blocked_reasons(L.blocked_pages(*_responses(spark, sf)))


@query
def collect_with_fallback(spark, sf):
    """Fresh answers, else the first user turn from the cache, else a notice."""
    pages = X.conversation_pages(spark, sf)
    cache = pages.filter("page_num = 1").select("doc", "page_num", "text", F.lit(X.MODEL).alias("model"))
    filled = L.fill_pages(X.conversation_documents(spark, sf), L.collect_results(*_responses(spark, sf)), cache, X.MODEL)
    return filled.select("doc", "page_num", "text", "origin")


@query
def recover_jobs(spark, sf):
    """Signups are lost jobs, purchases their user's remote batches; batches of value under 5 are claimed,
    and the mapping of a job exists where its value is at least 1."""
    e = X.table(spark, sf, "events")
    name = F.col("user_id").alias("display_name")
    signups, purchases = e.filter("event_type = 'signup'"), e.filter("event_type = 'purchase'")
    lost = signups.select(F.col("event_id").alias("job_id"), name, F.col("ts").alias("submitted_at"))
    remote = purchases.select(F.col("event_id").alias("name"), name, F.col("ts").alias("create_time"))
    claimed = purchases.filter("value < 5").select(F.col("event_id").alias("remote_name"))
    mappings = signups.filter("value >= 1").select(F.col("event_id").alias("job_id"))
    found = L.recover_jobs(lost, remote, claimed, mappings)
    return found.select(
        F.col("job_id").cast("bigint").alias("job_id"), "display_name", F.col("name").cast("bigint").alias("name"),
        F.unix_micros("create_time").alias("create_micros"))


@query
def job_state_latest(spark, sf):
    state = L.job_state(X.job_events(X.table(spark, sf, "events")))
    return state.select("job_id", "status", "is_completed", F.unix_micros("completed_at").alias("completed_micros"))


@query
def stream_job_status(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out, checkpoint = scratch_path(spark, "job-status"), scratch_path(spark, "job-status-progress")
    ST.write_job_status(X.job_events(X.with_zone(stream)), out, checkpoint).awaitTermination()
    state = ST.latest_job_status(spark, out)
    return state.select("job_id", "status", "is_completed", F.unix_micros("completed_at").alias("completed_micros"))


@query
def stream_collect_results(spark, sf):
    responses, mapping = _responses(spark, sf)
    mapping = materialise(mapping, "mapping")
    source = scratch_path(spark, "responses")
    responses.write.parquet(source)
    cache, refused = scratch_path(spark, "stream-cache"), scratch_path(spark, "stream-refused")
    stream = spark.readStream.schema(responses.schema).parquet(source)
    ST.collect_stream(stream, mapping, X.MODEL, cache, refused, scratch_path(spark, "collect-progress")).awaitTermination()
    return ST.collected_pages(spark, cache).select("model", "doc", "page_num", "text")


@query
def progress_latest(spark, sf):
    e = X.table(spark, sf, "events")
    page = F.get_json_object("props", "$.k").cast("bigint")
    now = e.agg(F.max("ts")).scalar()
    return L.progress(e.select(
        F.col("user_id").alias("file"), "ts", F.col("event_id").alias("seq"), page.alias("current_page"),
        F.lit(100).cast("bigint").alias("total_pages")), now)


@query
def progress_log(spark, sf):
    e = X.table(spark, sf, "events").withColumn("seq", F.col("event_id"))
    return L.recent_log(e).select("event_id", "user_id", "event_type")


# --- plans --------------------------------------------------------------------------------------------------------
def _inventory(spark, sf):
    return X.order_documents(spark, sf).select("folder", "doc", F.col("total_pages").alias("pages"))


@query
def chunk_folders(spark, sf):
    return PL.chunk_folders(_inventory(spark, sf), 500).select("folder", "doc", "pages", "part", "group")


@query
def plan_groups(spark, sf):
    _, groups, _ = PL.create_plan(_inventory(spark, sf), "plan_20240101_000000", max_pages=500)
    return groups.select("plan_id", "group", "folder", "part", "documents", "pages", "state")


@query
def admission(spark, sf):
    groups = X.order_groups(spark, sf).select("plan_id", "group_no", "group", "state", "pages", "missing", "retry_pass")
    return PL.admit(groups, ["plan_id", "group_no"], in_flight=500_000, budget=8_000_000).select(
        "plan_id", "group_no", "pages", "turn", "next_state", "prompt_id")


@query
def enqueued_tokens(spark, sf):
    return PL.enqueued_tokens(X.order_groups(spark, sf))


@query
def plan_summary(spark, sf):
    rates = C.base_rate_card(spark).filter(F.col("model_id") == K.DEFAULT_MODEL)
    return PL.plan_summary(X.order_groups(spark, sf), rates)


@query
def missing_split(spark, sf):
    return PL.missing_split(X.order_groups(spark, sf), keys=["plan_id"])


@query
def group_state_fold(spark, sf):
    folded = PL.fold_group_states(X.group_events(X.table(spark, sf, "events")), ["ts", "event_id"])
    return folded.select("group", "state", F.col("retry_pass").cast("bigint").alias("retry_pass"))


# --- workspace and cost ---------------------------------------------------------------------------------------------
def _workspace(spark, sf):
    d = X.order_documents(spark, sf)
    return d.select(
        F.concat(F.lit("/ws/"), "folder", F.lit("/"), F.col("doc").cast("string"), F.lit(".pdf")).alias("path"),
        F.concat(F.lit("Report "), F.col("doc").cast("string"), F.lit(".pdf")).alias("name"), "folder", "doc", "total_pages",
        (F.col("status") == "F").alias("is_converted"),
        F.when(F.col("status") == "P", F.lit("JOB_STATE_RUNNING")).alias("batch_status"))


@query
def workspace_rollup(spark, sf):
    return I.workspace_rollup(_workspace(spark, sf))


@query
def filter_inventory(spark, sf):
    return I.filter_inventory(_workspace(spark, sf), "ready", "report 1").select("path", "name", "folder", "total_pages")


@query
def batch_status(spark, sf):
    """Each order is a job over the parts it ships; the last listed active job of a part counts."""
    lines = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("pos"), F.array(F.col("l_partkey").cast("string")).alias("pdf_paths"))
    orders = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderstatus")
    status = F.when(F.col("o_orderstatus") == "P", "JOB_STATE_PENDING").when(
        F.col("o_orderstatus") == "O", "JOB_STATE_RUNNING").otherwise("JOB_STATE_SUCCEEDED")
    jobs = orders.join(lines, "pos").select(
        F.col("pos").alias("job_id"), status.alias("status"), (F.col("o_orderstatus") == "F").alias("is_completed"), "pdf_paths", "pos")
    parts = X.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"))
    return I.with_batch_status(parts, jobs).select("path", "batch_status", "batch_job_id")


@query
def deflate_candidates(spark, sf):
    """Every document has a transcript, labelled ones also a lightweight copy, toxic ones a consolidation."""
    d = X.table(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").alias("size"))
    labels = X.table(spark, sf, "labels")
    path = lambda folder: F.concat(F.lit("/ws/"), "source", F.lit(f"/{folder}/"), F.col("doc_id").cast("string"), F.lit(".md"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    light = d.join(labels, "doc_id").select(path("Lightweight").alias("path"), name.alias("name"), F.floor(F.col("size") / 2).cast("bigint").alias("size"))
    joined = d.join(labels.filter("toxic = 1"), "doc_id").select(path("Consolidated").alias("path"), name.alias("name"), "size")
    catalogue = d.select(path("Markdown").alias("path"), name.alias("name"), "size").unionByName(light).unionByName(joined)
    return I.deflate_candidates(catalogue)


@query
def projected_saving(spark, sf):
    return C.projected_saving(X.lightweight_sizes(spark, sf)).select(T.rounded(F.col("rate"), 9).alias("rate"))


@query
def budget_fit(spark, sf):
    return C.budget_fit(X.lightweight_sizes(spark, sf), 100_000)


@query
def cost_by_folder(spark, sf):
    docs = X.order_documents(spark, sf).select("folder", "priority", "total_pages")
    model = F.when(F.col("priority") == "1-URGENT", "gemini-2.5-pro").when(F.col("priority") == "2-HIGH", "gemini-3-flash-preview").otherwise("unlisted")
    out = C.aggregate_cost(docs.withColumn("model", model), C.base_rate_card(spark), ["folder"], pages="total_pages")
    return out.select("folder", "model", "pages", "input_tokens", "output_tokens", "total_tokens", "cost_standard_usd", "cost_batch_usd")


@query
def cost_by_document(spark, sf):
    docs = X.order_documents(spark, sf).select("doc", "total_pages", F.lit(K.DEFAULT_MODEL).alias("model"))
    out = C.cost_estimate(C.with_rates(docs, C.base_rate_card(spark)), "total_pages")
    return out.select("doc", "total_tokens", "cost_standard_usd", "cost_batch_usd")


@query
def rate_cards(spark, sf):
    """A pricing document per brand, written from its parts; batch rates only for even numbers of parts."""
    sums = X.table(spark, sf, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    num = lambda c: F.col(c).cast("string")
    table = lambda title, i, o: F.concat(
        F.lit(f"### {title}\n\n| Tier | Free | Paid |\n| --- | --- | --- |\n| Input price (text) | none | $"), i,
        F.lit(" |\n| Output price (all) | none | $"), o, F.lit(" |\n\n"))
    batch = F.when(F.col("n") % 2 == 0, table("Batch", F.concat(num("lo"), F.lit(".125")), num("hi"))).otherwise("")
    text = F.concat(
        F.lit("# Pricing\n\n## "), F.col("p_brand"), F.lit(" Model\n*`"), F.col("p_brand"), F.lit("`*\n\nMakes parts.\n\n"),
        table("Standard", F.concat(num("lo"), F.lit(".25")), F.concat(num("hi"), F.lit(".5"))), batch)
    return C.extract_rate_cards(sums.select(text.alias("text")))


@query
def rate_freshness(spark, sf):
    """Age of the last event of each user as seen at the last event of all."""
    e = X.table(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("synced_at")).withColumn("now", e.agg(F.max("ts")).scalar())
    fresh = last.select("user_id", C.rate_freshness(F.col("synced_at"), F.col("now")).alias("f"))
    return fresh.select("user_id", "f.synced", "f.stale")


@query
def newest_versions(spark, sf):
    e = X.table(spark, sf, "events")
    history = e.select(F.col("user_id").alias("path"), F.col("event_id").alias("version"), (F.col("event_id") % 97).alias("size"), F.col("ts").alias("mtime"))
    return I.newest_versions(history).select("path", "version", "size")


@query
def changed_files(spark, sf):
    """Line items against an earlier listing that knows only their discounted state as unchanged."""
    lines = X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("bigint").alias("size"), F.col("l_shipdate").alias("mtime"), "l_returnflag").distinct()
    current = lines.select("path", "size", "mtime").distinct()
    return I.ingest_changed(current, lines.filter("l_returnflag = 'R'")).select("path", "size", F.unix_micros("mtime").alias("mtime_micros"))


@query
def dedupe_keep_first(spark, sf):
    lines = X.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("pos"))
    return O.dedupe_keep_first(lines.groupBy("path", "pos").agg(F.count(F.lit(1)).alias("copies")), "path", "pos")
