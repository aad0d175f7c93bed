import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import deflate as D
from folioflow.operators import reports as R

DUTY = "# Duty of care\n" + " ".join(
    f"The company shall keep proper books and observe rule {w} at all times without delay." for w in
    "alpha beta gamma delta epsilon zeta".split()) + "\n"
OTHER = "# Outlook\n" + " ".join(f"unique{{0}}word{i}" for i in range(45)) + "\n"


def corpus(spark, docs):
    """Documents given as (path, text)."""
    return spark.createDataFrame(docs, "doc string, text string").select(
        "doc", T.path_parts("doc").alias("visit"), T.entity_of("doc").alias("entity"), T.file_name("doc").alias("name"), "text")


def path(company, year):
    return f"/ws/{company}/Markdown/{company} {year}.md"


def run(spark, docs, references=None, verdicts=None, **options):
    options.setdefault("similarity", None)  # identical masked texts; near copies have their own test
    results, removals, scan = D.deflate(
        corpus(spark, docs), None if references is None else corpus(spark, references), D.Options(**options), verdicts=verdicts)
    return ({r.doc: r for r in results.collect()}, sorted((tuple(r) for r in removals.select("doc", "reason", "canonical").collect())), scan)


def test_lone_document_is_left_whole(spark):
    text = DUTY + OTHER.format(1)
    results, removals, _ = run(spark, [(path("Acme", 2023), text)])
    assert removals == [] and results[path("Acme", 2023)].content == text


def test_three_companies_share_a_passage(spark):
    docs = [(path(c, 2023), DUTY + OTHER.format(i)) for i, c in enumerate(["Acme Ltd", "Beta plc", "Crux SARL"])]
    results, removals, _ = run(spark, docs)
    assert removals == [(path(c, 2023), "boilerplate", "Acme Ltd 2023.md") for c in ("Beta plc", "Crux SARL")]
    assert "> [DEFLATED — Duty of care: standard statutory text shared by 3 companies, 3 filings. Full text kept in `Acme Ltd 2023.md`.]" in results[
        path("Beta plc", 2023)].content
    assert results[path("Acme Ltd", 2023)].content == docs[0][1] and "unique1word0" in results[path("Beta plc", 2023)].content


def test_companies_count_not_filings(spark):
    docs = [(path("Acme", y), DUTY.replace("rule", f"rule {y}") + OTHER.format(y)) for y in (2021, 2022, 2023)]
    _, removals, _ = run(spark, docs)
    assert removals == []  # masked alike, but not word for word


def test_restatement_points_at_the_first_filing(spark):
    docs = [(path("Acme", y), DUTY + OTHER.format(y)) for y in (2021, 2022, 2023)]
    results, removals, _ = run(spark, docs)
    assert removals == [(path("Acme", y), "restatement", "Acme 2021.md") for y in (2022, 2023)]
    assert "repeated verbatim from an earlier filing by this company (3 filings carry it)" in results[path("Acme", 2023)].content


def test_peer_family_has_a_lower_bar(spark):
    docs = [(path(c, 2023), DUTY + OTHER.format(i)) for i, c in enumerate(("Pinion Holdings", "Pinion Trading"))]
    _, removals, scan = run(spark, docs, threshold=5, peer_threshold=2)
    assert [r[1] for r in removals] == ["boilerplate"]
    apart = [(path(c, 2023), DUTY + OTHER.format(i)) for i, c in enumerate(("Pinion", "Rowan", "Sable", "Teal"))]
    _, none, _ = run(spark, apart, threshold=5, peer_threshold=2)
    assert [r[1] for r in none] == ["boilerplate"] * 3  # the threshold is clamped to the four companies


def test_novel_figure_stays(spark):
    base = DUTY + "It was £1,000 in all.\n"
    docs = [(path("Acme", 1), base), (path("Beta", 1), base), (path("Crux", 1), base.replace("£1,000", "£41,300,000"))]
    _, removals, _ = run(spark, docs)
    assert [r[0] for r in removals] == [path("Beta", 1)]


def test_safe_mode_needs_an_explicit_verdict(spark):
    docs = [(path(c, 2023), DUTY + OTHER.format(i)) for i, c in enumerate(("Acme", "Beta", "Crux"))]
    _, removals, scan = run(spark, docs, mode="safe")
    assert removals == []
    fp = scan.library.filter("entities = 3").first()["fp"]
    for verdict, gone in (("strip", 2), ("keep", 0)):
        table = spark.createDataFrame([(fp, verdict)], "fp string, verdict string")
        _, removals, _ = run(spark, docs, mode="safe", verdicts=table)
        assert len(removals) == gone
    same = [(path("Acme", y), DUTY + OTHER.format(y)) for y in (2021, 2022)]
    assert len(run(spark, same, mode="safe")[1]) == 1  # restatements are not gated


def test_pointers_stay_in_the_written_set(spark):
    docs = [(path(c, 2023), DUTY + OTHER.format(i)) for i, c in enumerate(("Acme", "Beta", "Crux"))]
    _, removals, _ = run(spark, docs[1:], references=docs)
    assert removals == [(path("Crux", 2023), "boilerplate", "Beta 2023.md")]


def test_orphaned_passage_is_claimed_once(spark):
    """A passage whose library entry lies in no written document is kept by the first that could drop it."""
    rows = [("b", 2, "fp", "b.md"), ("c", 3, "fp", "c.md"), ("d", 4, "other", "d.md")]
    candidates = spark.createDataFrame(rows, "doc string, visit int, match_fp string, name string").withColumn(
        "section_ord", F.lit(0)).withColumn("canonical", F.when(
            F.col("match_fp") == "other", F.struct(F.lit("a").alias("doc"), F.lit("a.md").alias("name"))))
    got = {r.doc: r.canonical.doc for r in D.claim_orphans(candidates).collect()}
    assert got == {"b": "b", "c": "b", "d": "a"}


@pytest.mark.parametrize("extra", ["going concern", "\n| a | b |\n"])
def test_guards_keep_sections(spark, extra):
    docs = [(path(c, 2023), DUTY + extra + "\n") for c in ("Acme", "Beta", "Crux")]
    assert run(spark, docs)[1] == []


def test_near_copies_match(spark):
    docs = [(path("Acme", 1), DUTY), (path("Beta", 1), DUTY.replace("without delay", "without further delay")), (path("Crux", 1), DUTY)]
    assert len(run(spark, docs, similarity=0.85)[1]) == 2
    assert len(run(spark, docs)[1]) == 0  # two companies only once the variant is apart; threshold three


def test_reports(spark):
    docs = [(path(c, 2023), DUTY + OTHER.format(i)) for i, c in enumerate(["Acme", "Beta", "Crux"])]
    targets = corpus(spark, docs)
    results, removals, scan = D.deflate(targets, options=D.Options(similarity=None))
    total = R.deflate_summary(results).first()
    sizes = sum(len(t.encode()) for _, t in docs)
    assert total.total_original_bytes == sizes and total.files_deflated == 3
    assert total.est_tokens_saved == (sizes - total.total_lightweight_bytes) // 4
    pattern = R.boilerplate_patterns(scan, 3).first()
    assert (pattern.heading, pattern.companies, pattern.pattern_count) == ("Duty of care", 3, 1)
    summary = R.scan_summary(D.prepare(targets), scan, 3).first()
    assert (summary.files_scanned, summary.entities_scanned, summary.total_sections, summary.candidate_sections) == (3, 3, 6, 1)
    assert R.verification_summary(scan.library, None).first().available is False
    assert [r.sections_removed for r in R.file_report(results).collect()] == [1, 1, 0]


def test_company_names_three_ways(spark):
    docs = spark.createDataFrame([
        (1, "Acme Trading Limited and Acme"), (2, "nothing"), (3, "xAcme Tradingx Bo"), (4, "")], "doc int, text string")
    names = D.company_names(spark.createDataFrame(
        [("Acme Trading Limited",), ("Acme",), ("Bo",), ("documents",), ("Zed plc",)], "entity string"))
    assert {r.name for r in names.collect()} == {"Acme Trading Limited", "Acme Trading", "Acme", "Bo", "Zed plc", "Zed"}
    masked = []
    for kwargs in ({}, {"inline": 1}, {"inline": 1, "shared_bytes": 0}):
        out = D.with_names(docs, names, **kwargs).select("doc", T.replace_names("text", F.col("_names")).alias("t"))
        masked.append({r.doc: r.t for r in out.collect()})
    assert masked[0] == masked[1] == masked[2]
    inside = spark.createDataFrame([("Acme",), ("COMP",), ("Acme Holdings",)], "name string")
    given = spark.createDataFrame([(1, "Acme pays. Acme Holdings pays.")], "doc int, text string")
    for kwargs in ({}, {"inline": 1}, {"inline": 1, "shared_bytes": 0}):
        out = D.with_names(given, inside, **kwargs).select(T.replace_names("text", F.col("_names")).alias("t")).first()
        assert out.t == "{COMPANY} pays. {COMPANY} pays."
    assert masked[0][1] == "{COMPANY} and {COMPANY}" and masked[0][3] == "x{COMPANY}x {COMPANY}"


def test_marking_targets_moves_no_text(spark):
    def docs(ids):
        rows = [(i, i, f"Co {(i or 0) % 3} Ltd", f"n{i}", f"text {i}") for i in ids]
        return spark.createDataFrame(rows, "doc long, visit long, entity string, name string, text string")

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for targets in (range(2, 9), range(4)):
            corpus = D.prepare(docs(range(1, 7)), docs([*targets, None]) if 8 in targets else docs(targets))
            got = sorted(((r.doc, r.written, r.text) for r in corpus.collect()), key=str)
            want = {i: i in targets for i in range(1, 7)} | {i: True for i in targets} | ({None: True} if 8 in targets else {})
            assert got == sorted(((i, w, f"text {i}") for i, w in want.items()), key=str)
            assert "SortMergeJoin" not in corpus._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
