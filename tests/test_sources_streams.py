import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import deflate as D
from folioflow.operators import inventory as I
from folioflow.operators import ledger as L
from folioflow.sources import files as S
from folioflow.sources.document_sink import DocumentWriter, Staged, write_documents
from folioflow.streaming import jobs as J
from folioflow.streaming.tables import StreamTable


def workspace(root):
    for name, text in {
        "Acme Ltd/Markdown/Acme +1 2024.md": "# A\ntext é", "Acme Ltd/Lightweight/Acme +1 2024.md": "# A", "Acme Ltd/Consolidated/All.md": "all",
        "Acme Ltd/Markdown/x_Index.md": "index", "notes.md": "loose", "Lightweight/_deflate_report.md": "r",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    for name in ("top.pdf", "Acme Ltd/Acme +1 2024.pdf", "Acme Ltd/open.pdf", "Acme Ltd/deep/in.pdf", "Markdown/no.pdf"):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"%PDF")
    return str(root)


def names(df):
    return sorted(r.name for r in df.collect())


def test_workspace_readers(spark, tmp_path):
    root = workspace(tmp_path / "w s")
    df = S.read_transcripts(spark, root)
    assert names(df) == ["Acme +1 2024.md", "notes.md", "x_Index.md"] and names(S.corpus_transcripts(df)) == ["Acme +1 2024.md"]
    assert S.as_corpus(S.corpus_transcripts(df)).first()["entity"] == "Acme Ltd"
    assert len(names(S.read_transcripts(spark, root, include_consolidated=True))) == 4
    assert S.read_transcripts(spark, str(tmp_path / "none")).count() == 0
    catalogue = S.markdown_catalogue(spark, root)
    got = {(r.folder, r.name, r.is_lightweight, r.is_consolidated) for r in catalogue.collect()}
    assert got == {("Acme Ltd", "Acme +1 2024.md", False, False), ("Acme Ltd", "Acme +1 2024.md", True, False),
                   ("Acme Ltd/Consolidated", "All.md", False, True), ("General / Root", "notes.md", False, False)}
    candidate = I.deflate_candidates(catalogue).first()
    assert (candidate["name"], candidate.size, candidate.deflated_size) == ("Acme +1 2024.md", 11, 3)
    pdfs = {(r.folder, r.name, r.is_converted) for r in S.pdf_inventory(spark, root).collect()}
    assert pdfs == {("General / Root", "top.pdf", False), ("Acme Ltd", "Acme +1 2024.pdf", True), ("Acme Ltd", "open.pdf", False)}
    assert S.pdf_inventory(spark, root, nested=True).count() == 4


def test_page_cache(spark, tmp_path):
    stamp = "<!-- folioflow: model=m-1 converted=2024-01-02T03:04:05Z prompt=p -->\n"
    for path, text in {"models/m-1/Acme/r/page_001.md": stamp + "one", "models/m-1/Acme/r/page_002.md": stamp, "Acme/r/page_003.md": "old"}.items():
        p = tmp_path / "c" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    rows = sorted((tuple(r) for r in S.read_page_files(spark, str(tmp_path / "c")).select("model", "folder", "stem", "page_num", "text", "prompt").collect()), key=repr)
    assert rows == [("m-1", "Acme", "r", 1, "one", "p"), (None, "Acme", "r", 3, "old", None)]
    out = str(tmp_path / "store")
    S.write_page_cache(spark.createDataFrame([("m", "d", 1, stamp + "x"), ("m", "d", 2, " "), ("n", "d", 1, None)], "model string, doc string, page_num int, text string"), out)
    assert [(r.model, r.text) for r in S.read_page_cache(spark, out).collect()] == [("m", "x")]


def test_rate_cards_and_plans(spark, tmp_path):
    rate = {"name": "n", "input_standard": 1.0, "output_standard": 2.0, "input_batch": 0.5, "output_batch": 1.0, "context_cache": 0.1}
    new, old = tmp_path / "new.json", tmp_path / "old.json"
    new.write_text(json.dumps({"synced_at": "2024-01-02T03:04:05+00:00", "models": {"a": rate}}, indent=2))
    old.write_text(json.dumps({"b": rate, "note": "x"}))
    a, b = S.read_rate_card(spark, str(new)).first(), S.read_rate_card(spark, str(old)).collect()
    assert (a.model_id, a.output_standard, a.synced_at.year) == ("a", 2.0, 2024)
    assert [r.model_id for r in b] == ["b"] and b[0].synced_at.year > 2024
    plans = tmp_path / "plans"
    plans.mkdir()
    for i in (1, 2):
        (plans / f"plan_{i}.json").write_text(json.dumps({"id": f"plan_{i}", "model": "m", "groups": [{"name": "A", "pages": 3, "state": "pending"}]}, indent=2))
    (plans / "bad.json").write_text("{oops")
    df = S.read_plans(spark, str(plans))
    assert [r.id for r in df.collect()] == ["plan_2", "plan_1"] and S.latest_plan_id(df).first()[0] == "plan_2"
    assert [(r.group, r.pages, r.retry_pass) for r in S.plan_groups(df).collect()] == [("A", 3, 0)] * 2


def test_inventory(spark):
    rows = [("/w/A/r 2020.pdf", "r 2020.pdf", "A", True, 3), ("/w/A/r 2021.pdf", "r 2021.pdf", "A", False, 4), ("/w/B/x.pdf", "x.pdf", "B", False, 5)]
    df = spark.createDataFrame(rows, "path string, name string, folder string, is_converted boolean, total_pages int")
    jobs = spark.createDataFrame([
        ("j1", "JOB_STATE_PENDING", False, ["/w/B/x.pdf", "/w/A/r 2021.pdf"], 1), ("j2", "JOB_STATE_RUNNING", False, ["/w/B/x.pdf"], 2),
        ("j3", "JOB_STATE_RUNNING", True, ["/w/A/r 2021.pdf"], 3)], "job_id string, status string, is_completed boolean, pdf_paths array<string>, pos int")
    full = I.with_batch_status(df, jobs)
    assert {r.name: r.batch_job_id for r in full.collect()} == {"r 2020.pdf": None, "r 2021.pdf": "j1", "x.pdf": "j2"}
    assert names(I.filter_inventory(full, "batch", "R 2")) == ["r 2021.pdf"] and names(I.filter_inventory(full, "ready")) == []
    assert [r.name for r in I.order_inventory(full).collect()] == ["r 2021.pdf", "r 2020.pdf", "x.pdf"]
    rolled = {r.folder: (r.documents, r.converted, r.ready, r.in_batch, r.pages) for r in I.workspace_rollup(full).collect()}
    assert rolled == {"A": (2, 1, 0, 1, 7), "B": (1, 0, 0, 1, 5), "ALL": (3, 1, 0, 2, 12)}


def test_job_status_stream_equals_batch(spark, tmp_path):
    rows = [("a", "JOB_STATE_PENDING", 1), ("a", "JOB_STATE_SUCCEEDED", 3), ("a", "JOB_STATE_RUNNING", 4), ("b", "JOB_STATE_RUNNING", 2),
            ("b", "JOB_STATE_PENDING", 1), ("c", "JOB_STATE_FAILED", 5)]
    events = spark.createDataFrame(rows, "job_id string, status string, seq int").withColumn("ts", F.timestamp_seconds("seq"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (0, 1):  # two deliveries, the second out of order
        events.filter(F.col("seq") % 2 == part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        J.write_job_status(stream, out, str(tmp_path / "ck")).awaitTermination()
    pick = lambda df: sorted((r.job_id, r.status, r.is_completed, r.completed_at) for r in df.collect())
    batch = pick(L.job_state(events))
    assert pick(J.latest_job_status(spark, out)) == batch
    assert [b[:3] for b in batch] == [("a", "JOB_STATE_SUCCEEDED", True), ("b", "JOB_STATE_RUNNING", False), ("c", "JOB_STATE_FAILED", True)]


def test_collect_stream_is_idempotent(spark, tmp_path):
    mapping = spark.createDataFrame([("k1", "d", 1), ("k2", "d", 2)], "key string, doc string, page_num bigint")
    line = lambda key, text: json.dumps({"key": key, "response": {"candidates": [{"content": {"parts": [{"text": text}]}}]}})
    source = tmp_path / "in"
    source.mkdir()
    for i in range(2):
        (source / f"{i}.jsonl").write_text("\n".join([line("k1", "one"), line("k2", " "), line("zz", "?")]))
        stream = spark.readStream.schema(L.RESPONSE_SCHEMA).json(str(source))
        J.collect_stream(stream, mapping, "m", str(tmp_path / "cache"), str(tmp_path / "no"), str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in J.collected_pages(spark, str(tmp_path / "cache")).collect()] == [("m", "d", 1, "one")]
    assert {r.page_num for r in StreamTable(str(tmp_path / "no"), ["doc", "page_num"], ["batch_id"]).read(spark).collect()} == {2}


def test_ended_jobs_leave_the_state_and_late_events_do_not_bring_them_back(spark, tmp_path):
    day, source, out = 86_400, str(tmp_path / "in"), str(tmp_path / "out")
    schema, sizes = "job_id string, status string, ts timestamp, seq bigint", []
    for n in range(4):  # two jobs a batch end ten days apart, one job stays open; the last batch repeats old events
        rows = [("open", "JOB_STATE_RUNNING", n * 10 * day, n), (f"j{n}", "JOB_STATE_RUNNING", n * 10 * day, n), (f"j{n}", "JOB_STATE_SUCCEEDED", n * 10 * day + 5, n)]
        rows += [("j0", "JOB_STATE_RUNNING", 1, 0)] if n == 3 else []
        df = spark.createDataFrame(rows, "job_id string, status string, s long, seq long").select("job_id", "status", F.timestamp_seconds("s").alias("ts"), "seq")
        df.coalesce(1).write.mode("append").parquet(source)
        query = J.write_job_status(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "ck"))
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {r.job_id: (r.status, r.is_completed) for r in J.latest_job_status(spark, out).collect()}
    assert got == {"open": ("JOB_STATE_RUNNING", False)} | {f"j{n}": ("JOB_STATE_SUCCEEDED", True) for n in range(4)}
    assert sizes[-1] <= sizes[0] + 2, sizes


def test_stream_table_keeps_two_generations_and_the_newest_rows(spark, tmp_path):
    import random

    rng, want, table = random.Random(1), {}, StreamTable(str(tmp_path / "t"), ["k"], ["v"])
    for n in range(9):
        rows = [(rng.randrange(40), 100 * n + i, f"x{i}") for i in range(1 + 30 * (n % 4 == 0))]
        df = spark.createDataFrame(rows, "k long, v long, text string").coalesce(1)
        for _ in range(1 + (n == 5)):  # one batch is run again
            table.merge(df, n)
        for k, v, t in sorted(rows, key=lambda r: r[1]):
            want[k] = (v, t)
    assert {r.k: (r.v, r.text) for r in table.read(spark).collect()} == want
    folders = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert len(table.generations(spark)) <= 2 and len(folders) <= 5 and len(list((tmp_path / "t" / "manifests").glob("0*"))) == 2


def test_ingest_reads_changes_only(spark):
    previous = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "path string, size int, mtime int")
    current = spark.createDataFrame([("a", 1, 10, "x"), ("b", 2, 11, "y"), ("c", 1, 1, "z")], "path string, size int, mtime int, text string")
    assert sorted(r.path for r in I.ingest_changed(current, previous).collect()) == ["b", "c"]
    history = current.unionByName(current.withColumns({"mtime": F.lit(99), "text": F.lit("new")}).filter("path = 'b'"))
    assert {r.path: r.text for r in I.newest_versions(history).collect()} == {"a": "x", "b": "new", "c": "z"}


def test_document_files_appear_whole_or_not_at_all(spark, tmp_path):
    root = tmp_path / "out"
    df = spark.createDataFrame([(f"a/{i}.md", f"text {i}") for i in range(20)] + [("b.md", None)], "file string, text string").repartition(3)
    write_documents(df, str(root), F.col("file"), F.col("text"))
    files = lambda: {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}
    want = {f"a/{i}.md": f"text {i}" for i in range(20)} | {"b.md": ""}
    assert files() == want and sorted(p.name for p in root.iterdir()) == ["a", "b.md"]
    for bad in ("../out.md", "/etc/x", None, ""):
        broken = df.withColumn("file", F.when(F.col("file") == "a/7.md", F.lit(bad).cast("string")).otherwise(F.concat(F.lit("new/"), "file")))
        with pytest.raises(Exception, match="no file name below the root"):
            write_documents(broken, str(root), F.col("file"), F.col("text"))
    assert files() == want and sorted(p.name for p in root.iterdir()) == ["a", "b.md"]
    write_documents(df.limit(0), str(root), F.col("file"), F.col("text"))
    write_documents(df.filter("file = 'b.md'"), str(root), F.col("file"), F.lit("newer"))
    assert files() == want | {"b.md": "newer"}


def test_the_driver_lists_and_moves_no_files(spark, tmp_path):
    root = str(tmp_path / "w")
    rows = [("A/Markdown/x.md", "old"), ("A/Markdown/.hid.md", "h"), ("A/_d/y.md", "u"), ("A/Markdown/x.md", "new")]
    write_documents(spark.createDataFrame(rows, "file string, text string").coalesce(1), root, F.col("file"), F.col("text"))
    assert {str(p.relative_to(root)): p.read_text() for p in (tmp_path / "w").rglob("*") if p.is_file()} == dict(rows)
    for found in (S.read_transcripts(spark, root), S.markdown_catalogue(spark, root), S.pdf_inventory(spark, root), S.read_page_files(spark, root)):
        assert not [f for f in found.inputFiles() if f.endswith((".md", ".pdf"))]
    assert [(r.path, r.text, r["size"]) for r in S.read_transcripts(spark, root).collect()] == [(f"{root}/A/Markdown/x.md", "new", 3)]
    staging = str(tmp_path / "staged")
    writer = DocumentWriter(staging)
    (tmp_path / "staged/0-a").mkdir()
    (tmp_path / "staged/0-a/f.md").write_text("f")
    writer.commit([Staged("0-a"), None])
    assert sorted(p.name for p in (tmp_path / "staged").rglob("*")) == ["0-a", "_committed", "f.md"]


def test_lightweight_and_plan_files(spark, tmp_path):
    root = str(tmp_path)
    results = spark.createDataFrame([(f"{root}/A/Markdown/x.md", "light"), ("B/y.md", "also")], "doc string, content string")
    assert {r.output for r in S.write_lightweight(results, root, "dry-run").collect()} == {f"{root}/A/Lightweight/x.md", "B/Lightweight/y.md"}
    assert not (tmp_path / "A").exists()
    S.write_lightweight(results, root)
    assert (tmp_path / "A/Lightweight/x.md").read_text() == "light" and (tmp_path / "B/Lightweight/y.md").read_text() == "also"
    S.write_plans(spark.createDataFrame([("plan_1", "m"), ("plan_2", None)], "id string, model string"), str(tmp_path / "plans"))
    assert sorted(r.id for r in S.read_plans(spark, str(tmp_path / "plans")).collect()) == ["plan_1", "plan_2"]


def test_classifier_failures_keep_and_known_verdicts_are_not_asked_again(spark):
    rows = [(f"f{i}", "h", "x" * 900, i) for i in range(12)] + [("f3", "h", "x", 3)]
    candidates = spark.createDataFrame(rows, "fp string, heading string, example string, files long")

    def judge(batch):
        assert not set(batch["fp"]) & {"f1", "f2"} and batch["example"].str.len().max() <= 500
        if (batch["files"] == 5).any():
            raise ValueError("refused")
        return ["strip" if n % 2 else "odd" if n == 8 else "keep" for n in batch["files"]]

    known = spark.createDataFrame([("f1", "keep"), ("f2", "strip"), ("f9", None), ("zz", "strip")], "fp string, verdict string")
    got = {r.fp: r.verdict for r in D.classify(candidates, judge, known).collect()}
    assert got == {f"f{i}": "strip" if i % 2 else "keep" for i in range(12)} | {"f1": "keep", "f2": "strip", "f5": None, "f8": None}


def test_file_contents_are_not_broadcast(spark, tmp_path):
    docs = spark.createDataFrame([(f"F{i % 3}/{i}.md", "text " * i) for i in range(30)], "file string, text string")
    write_documents(docs, str(tmp_path / "w"), F.col("file"), F.col("text"))
    found = S.read_whole(spark, str(tmp_path / "w"), "*.md").select(F.regexp_extract("path", r"(\w+/\w+\.md)$", 1).alias("file"), "value")
    joined = found.filter("value <> ''").join(docs, "file")
    joined.collect()
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.filter("value = text").count() == 29
