import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.operators import cost as C
from folioflow.operators import ledger as L
from folioflow.operators import ordering as O
from folioflow.operators import planning as P

PLAN = [("d1", 4), ("d2", 2), ("d3", 0)]
CACHE = [("m", "d1", 1, "x"), ("m", "d1", 2, " "), (None, "d1", 3, "old"), (None, "d1", 1, "old"), ("m", "d1", 9, "out"), ("n", "d2", 1, "x")]


@pytest.fixture(scope="module")
def ledger(spark):
    return (spark.createDataFrame(PLAN, "doc string, total_pages int"),
            spark.createDataFrame(CACHE, "model string, doc string, page_num bigint, text string"))


def test_missing_and_coverage(ledger):
    plan, cache = ledger
    pairs = lambda df: sorted((r.doc, r.page_num) for r in df.collect())
    assert pairs(L.missing_pages(plan, cache, "m")) == [("d1", 2), ("d1", 3), ("d1", 4), ("d2", 1), ("d2", 2)]
    assert pairs(L.legacy_only(plan, cache, "m")) == [("d1", 3)]
    got = {r.doc: (r.cached_pages, r.legacy_pages) for r in L.document_coverage(plan, cache, "m").collect()}
    assert got == {"d1": (1, 1), "d2": (0, 0), "d3": (0, 0)}
    estimate = L.payload_estimate(plan).first()
    assert (estimate.pages, estimate.fits, estimate.max_pages_per_job) == (6, True, 4285)


def test_responses(spark, tmp_path):
    from folioflow.sources.files import read_batch_responses

    path = tmp_path / "r.jsonl"
    path.write_text(
        '{"key":"doc000_p001","response":{"candidates":[{"finishReason":"STOP","content":{"parts":[{"text":" a"},{"text":"b "}]}}]}}\n'
        "not json\n"
        '{"key":"doc000_p002","response":{"candidates":[{"finishReason":"RECITATION"}]}}\n'
        '{"key":"doc000_p003","response":{}}\n{"key":"nobody","response":{}}\n')
    mapping = spark.createDataFrame([(f"doc000_p{n:03d}", "d1", n) for n in range(1, 5)], "key string, doc string, page_num bigint")
    responses = read_batch_responses(spark, str(path))
    assert [(r.page_num, r.text) for r in L.collect_results(responses, mapping).collect()] == [(1, "ab")]
    blocked = L.blocked_pages(responses, mapping)
    assert sorted((r.page_num, r.reason) for r in blocked.collect()) == [(2, "RECITATION"), (3, "EMPTY_RESPONSE")]
    docs = spark.createDataFrame([("d1", 3), ("d2", 1)], "doc string, total_pages int")
    cache = spark.createDataFrame([("m", "d1", 1, "stale"), ("m", "d2", 1, "held")], "model string, doc string, page_num bigint, text string")
    filled = L.fill_pages(docs, L.collect_results(responses, mapping), cache, "m")
    assert sorted((r.doc, r.page_num, r.text) for r in filled.collect()) == [
        ("d1", 1, "ab"), ("d1", 2, "> **[Page 2 conversion missing]**"), ("d1", 3, "> **[Page 3 conversion missing]**"), ("d2", 1, "held")]


def test_requests(spark):
    pages = spark.createDataFrame([("d", 0, 7, bytearray(b"img"))], "doc string, doc_index int, page_num int, image binary")
    row = L.batch_requests(pages, 'say "x"').first()
    assert row.key == "doc000_p007"
    assert row.line == '{"key":"doc000_p007","request":{"contents":[{"parts":[{"inline_data":{"mime_type":"image/png","data":"aW1n"}},{"text":"say \\"x\\""}]}]}}'


def test_job_recovery(spark):
    t = datetime(2026, 8, 22, 13, 38, 38)
    lost = spark.createDataFrame([("batch_20260822_133838", "p — A"), ("odd", "p — B"), ("batch_20260822_133900", "p — C"), ("batch_20260822_133901", "p — A")],
                                 "job_id string, display_name string")
    remote = spark.createDataFrame([
        ("early", "p — A", t - timedelta(seconds=200)), ("near", "p — A", t - timedelta(seconds=60)), ("late", "p — A", t + timedelta(hours=1)),
        ("b1", "p — B", t), ("b0", "p — B", t - timedelta(days=1)), ("c", "p — C", None)], "name string, display_name string, create_time timestamp")
    jobs = spark.createDataFrame([("b0",), (None,)], "remote_name string")
    mappings = spark.createDataFrame([("batch_20260822_133838",), ("odd",), ("batch_20260822_133900",)], "job_id string")
    got = {r.job_id: r.name for r in L.recover_jobs(lost, remote, jobs, mappings).collect()}
    assert got == {"batch_20260822_133838": "near", "odd": "b1", "batch_20260822_133900": "c"}


def test_each_batch_recovers_one_job(spark):
    t = datetime(2026, 8, 22, 10, 0, 0)
    lost = spark.createDataFrame([(f"j{i}", "p", t + timedelta(minutes=i)) for i in range(5)] + [("k", "q", t)], "job_id string, display_name string, submitted_at timestamp")
    remote = spark.createDataFrame(
        [("b0", "p", t + timedelta(seconds=10)), ("b1", "p", t + timedelta(seconds=70)), ("b2", "p", t + timedelta(hours=1)), ("x", "q", t - timedelta(hours=1))],
        "name string, display_name string, create_time timestamp")
    none = spark.createDataFrame([], "remote_name string")
    got = {r.job_id: r.name for r in L.recover_jobs(lost, remote, none, lost.select("job_id")).collect()}
    assert got == {"j0": "b0", "j1": "b1", "j2": "b2"}


def test_last_delivery_of_a_page_counts(spark):
    schema = "key string, response struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>,finishReason:string>>>, seq int"
    rows = [("k", ([(([(t,)],), "STOP")],), n) for n, t in enumerate(("old", "new", ""))]
    responses = spark.createDataFrame(rows, schema)
    mapping = spark.createDataFrame([("k", "d", 1)], "key string, doc string, page_num bigint")
    assert [r.text for r in L.collect_results(responses, mapping).collect()] == ["new"]
    cache = spark.createDataFrame([("m", "d", 1, "a", 1), ("m", "d", 1, "b", 2)], "model string, doc string, page_num bigint, text string, converted int")
    docs = spark.createDataFrame([("d", 1)], "doc string, total_pages int")
    assert [r.text for r in L.fill_pages(docs, L.collect_results(responses, mapping).limit(0), cache, "m").collect()] == ["b"]


def test_scans_in_order(spark):
    rng = random.Random(1)
    values = [(i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(values, "k int, v int").repartition(7)
    got = O.scan_in_order(df, [F.col("k")], "pos", {"run": F.col("v")}).orderBy("k").collect()
    total = 0
    for i, (row, (_, v)) in enumerate(zip(got, values), 1):
        total += v
        assert (row.pos, row.run) == (i, total)
    nxt = O.next_in_order(df, [F.col("k")], F.col("v") == 9, F.col("k")).orderBy("k").collect()
    for row, (k, _) in zip(nxt, values):
        assert row.next == next((j for j, v in values[k:] if v == 9), None)


@pytest.mark.parametrize("limit", [15, 7])
def test_chunks_equal_the_sequential_rule(spark, monkeypatch, limit):
    """Small blocks and a narrow tree, so that summaries are composed over several levels."""
    monkeypatch.setattr(P, "BLOCK_PAGES", 40)
    monkeypatch.setattr(P, "FAN", 2 if limit == 7 else 64)
    rng = random.Random(limit)
    rows = [(f"F{i % 3 if i % 5 else 0}", f"d{i:04d}", rng.choice([0, 1, 2, 3, 5, 9, 20])) for i in range(300)]
    got = P.chunk_folders(spark.createDataFrame(rows, "folder string, doc string, pages int"), limit).collect()
    want = {}
    for folder in {r[0] for r in rows}:
        part, running, open_job = 1, 0, False
        for _, doc, pages in sorted(r for r in rows if r[0] == folder):
            if open_job and running + pages > limit:
                part, running = part + 1, 0
            running, open_job = running + pages, True
            want[doc] = part
    assert {r.doc: r.part for r in got} == want
    held = {f: sum(r[2] for r in rows if r[0] == f) for f in {r[0] for r in rows}}
    assert all(r.group == r.folder + (f" (part {r.part})" if held[r.folder] > limit else "") for r in got)
    assert {r.group for r in got if r.part == 2} <= {f"F{i} (part 2)" for i in range(3)}


def test_plan_of_companies(spark):
    rows = [(c, f"{c}{i}", 10) for c in ("Acme", "Beta", "Crux") for i in (1, 2)]
    inventory = spark.createDataFrame(rows, "folder string, doc string, pages int")
    _, groups, _ = P.create_plan(inventory, "p")
    assert sorted((r.group, r.pages, r.documents) for r in groups.collect()) == [("Acme", 20, 2), ("Beta", 20, 2), ("Crux", 20, 2)]
    _, split, _ = P.create_plan(inventory, "p", max_pages=15, files=spark.createDataFrame([("Acme1",), ("Acme2",), ("Beta1",)], "doc string"))
    assert sorted(r.group for r in split.collect()) == ["Acme (part 1)", "Acme (part 2)", "Beta"]


def test_admission(spark):
    token = K.INPUT_TOKENS_PER_PAGE
    rows = [(1, "a", "pending", 10, 5, 0), (2, "b", "submitted", 10, 5, 0), (3, "c", "pending", 30, 0, 1), (4, "d", "pending", 25, 3, 0), (5, "e", "pending", 1, 1, 0)]
    groups = spark.createDataFrame(rows, "pos int, group string, state string, pages int, missing int, retry_pass int")
    run = lambda **k: [(r.group, r.next_state) for r in P.admit(groups, ["pos"], **k).orderBy("turn").collect()]
    assert run(budget=45 * token) == [("a", "submitted"), ("c", "collected"), ("d", "submitted"), ("e", "submitted")]
    assert run(budget=39 * token) == [("a", "submitted")]  # c sends nothing, yet must fit
    assert run(budget=45 * token, in_flight=10 * token) == [("a", "submitted")]
    assert run(budget=45 * token, max_new=1) == [("a", "submitted")]
    assert run(budget=45 * token, only="D") == [("d", "submitted")]


def test_group_states_equal_the_sequential_fold(spark, monkeypatch):
    monkeypatch.setattr(P, "FOLD_BLOCK", 4)
    rng = random.Random(3)
    rows = [(f"g{rng.choice([0, 0, 0, 1, 2])}", rng.choice(P.GROUP_EVENTS), i) for i in range(120)]
    got = {r.group: (r.state, r.retry_pass) for r in P.fold_group_states(spark.createDataFrame(rows, "group string, event string, at int"), ["at"]).collect()}
    want = {}
    for group, event, _ in rows:
        want[group] = P.next_state(*want.get(group, ("pending", 0, 0)), event)
    assert got == {g: s[:2] for g, s in want.items()}


def test_transitions():
    assert P.next_state("submitted", 3, 0, "refused") == ("pending", 4, 0)
    assert P.next_state("submitted", 4, 0, "refused") == ("collected", 4, 0)
    assert P.next_state("pending", 1, 0, "nothing_to_send")[0] == "collected"
    assert P.next_state("submitted", 0, 2, "lost")[0] == "failed"
    assert all(P.decode_state(P.encode_state(*P.decode_state(c))) == P.decode_state(c) for c in range(P._STATE_COUNT))


def test_costs(spark):
    card = C.base_rate_card(spark)
    df = spark.createDataFrame([("gemini-2.5-pro", 100), ("unknown", 100)], "model string, pages int")
    got = {r.model: (r.total_tokens, r.cost_standard_usd, r.cost_batch_usd) for r in C.cost_estimate(C.with_rates(df, card)).collect()}
    assert got == {"gemini-2.5-pro": (191200, 0.80775, 0.403875), "unknown": (191200, 0.12905, 0.064525)}


def test_rate_documents(spark):
    text = (
        "# Pricing\n\n## Model One\n*`one-id` and `one-alias`*\n\n[Try it]\nGood model.\n\n### Standard\n| | Free | Paid |\n| --- | --- | --- |\n"
        "| Input price | Free | $1.50 (text) |\n| Output price (incl.) | Free | $9.00 |\n| Context caching price | no | $0.15 |\n\n"
        "### Batch\n| Input price | no | $0.75 |\n| Output price | no | $4.50 |\n\n## Model Two\n*`two-id`*\n\n### Standard\n| Input price | no | 0.30 |\n"
        "| Output price | no | $2.5 |\n\n## Not a model\ntext\n")
    got = {r.model_id: tuple(r)[1:] for r in C.extract_rate_cards(spark.createDataFrame([(text,)], "text string")).collect()}
    assert got == {"one-id": ("Model One", 1.5, 9.0, 0.75, 4.5, 0.15, "Good model."), "two-id": ("Model Two", 0.3, 2.5, 0.15, 1.25, 0.03, "")}
    updates = spark.createDataFrame([("gemini-2.5-pro", 9.0, 9.0, 9.0, 9.0, 9.0), ("new", 1.0, 1.0, 1.0, 1.0, 1.0)], C.RATE_SCHEMA)
    merged = {r.model_id: r.input_batch for r in C.merge_rates(C.base_rate_card(spark), updates).collect()}
    assert merged["gemini-2.5-pro"] == 9.0 and "new" not in merged and merged["gemini-2.5-flash"] == 0.15


def test_freshness(one):
    now = F.lit("2024-03-31 00:00:00").cast("timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    got = [tuple(one(C.rate_freshness(at(s), now))) for s in (None, "2024-03-30 23:59:30", "2024-03-30 23:59:00", "2024-03-30 21:00:00", "2024-03-01 00:00:00")]
    assert got == [("never", True), ("just now", False), ("1 minute ago", False), ("3 hours ago", False), ("30 days ago", True)]


def test_conversion_with_retry(spark):
    pages = spark.createDataFrame([("d", 1), ("d", 2)], "doc string, page_num bigint")

    def transcribe(batch, prompt):
        return batch["page_num"].map(lambda n: "" if n == 2 and prompt == "preset" else f"{prompt} {n}")

    converted, refused = L.convert_missing(pages, transcribe, "m")
    assert [tuple(r) for r in converted.collect()] == [("d", 1, "preset 1", "m", None)]
    again, none = L.convert_missing(refused, transcribe, "m", 1)
    assert [(r.page_num, r.prompt) for r in again.collect()] == [(2, "verbatim-public-record")] and none.count() == 0
