"""Boilerplate removal over a corpus.

``scan`` builds a library of repeated passages, ``decide`` says which sections of the target
documents are replaced, ``rewrite`` produces the lightweight texts. Documents are rows
``doc, visit, entity, name, text``: ``visit`` orders the documents, ``name`` is what pointers cite.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions import text as T
from folioflow.operators.joins import lookup
from folioflow.operators.sections import explode_units, with_units
from folioflow.operators.similarity import Clusters, assign, leader_clusters
from folioflow.plans.storage import materialise, materialise_by, temporary

try:
    import ahocorasick
except ImportError:  # larger name lists are then joined
    ahocorasick = None

NAMES_INLINE = 32
NAMES_SHARED_BYTES = 32_000_000
IDS_SHARED_BYTES = 64_000_000
GRAM = 12


@dataclass(frozen=True)
class Options:
    mode: str = "algorithmic"
    threshold: int = K.DEFAULT_THRESHOLD
    similarity: float | None = K.DEFAULT_SIMILARITY  # None: only identical masked texts match
    peer_threshold: int = K.DEFAULT_PEER_THRESHOLD
    unit: str = "headings"
    currency: str = K.CURRENCY


@dataclass
class Scan:
    sections: DataFrame
    library: DataFrame
    clusters: Clusters | None
    options: Options = field(default_factory=Options)


# --- company names ----------------------------------------------------------------------------------
def company_names(entities: DataFrame, entity: str = "entity") -> DataFrame:
    """Distinct folder names and the same without their legal suffix; generic folders excluded."""
    names = entities.select(F.col(entity).alias("name")).distinct().filter(~F.col("name").isin(K.GENERIC_FOLDERS))
    suffix = "|".join(K.COMPANY_SUFFIXES)
    both = F.array(F.col("name"), F.regexp_replace("name", f"(?:{suffix})$", ""))
    return names.select(F.explode(both).alias("name")).filter(F.col("name") != "").distinct()


def with_names(docs: DataFrame, names: DataFrame, inline: int = NAMES_INLINE, shared_bytes: int = NAMES_SHARED_BYTES) -> DataFrame:
    """Add ``_names``: the names that occur in each document's text, longest first.

    The rule is the same for any number of names: a name is masked where the text as given holds it. Names
    that only arise by masking others do not count. A handful of names is tested one by one, up to
    ``shared_bytes`` of names are looked up by one automaton per task, and more are joined by their first characters.
    """
    few = [r["name"] for r in names.limit(inline + 1).collect()]
    if len(few) <= inline:
        ordered = sorted(few, key=lambda n: (-len(n), n))
        constant = F.array(*[F.lit(n) for n in ordered]) if ordered else F.array().cast("array<string>")
        return docs.withColumn("_names", F.filter(constant, lambda n: F.coalesce(F.col("text").contains(n), F.lit(False))))
    size = names.agg(F.sum(F.octet_length("name") + 16)).first()[0]
    if size <= shared_bytes and ahocorasick is not None:
        return docs.withColumn("_names", T.longest_first(names_in_text(names)(F.col("text"))))
    keyed = names.select("name", F.substring("name", 1, GRAM).alias("gram"))
    widths = sorted(r[0] for r in keyed.select(F.length("gram")).distinct().collect())  # at most GRAM numbers

    @F.pandas_udf("array<string>")
    def beginnings(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({t[i : i + w] for w in widths for i in range(len(t) - w + 1)}) if t else [])

    # The grams go alone; a candidate meets the text again only to be tested.
    found = docs.select("doc", F.explode(beginnings("text")).alias("gram")).join(keyed, "gram").select("doc", "name").distinct()
    held = found.join(docs.select("doc", "text"), "doc").filter(F.col("text").contains(F.col("name")))
    per_doc = held.groupBy("doc").agg(T.longest_first(F.collect_list("name")).alias("_names"))
    return docs.join(per_doc, "doc", "left").withColumn(
        "_names", F.coalesce("_names", F.array().cast("array<string>")))


def names_in_text(names: DataFrame):
    """Arrow UDF listing the distinct names that occur in each text; the list's size is checked before."""
    shared = names.sparkSession.sparkContext.broadcast([r["name"] for r in names.collect()])
    built: list = []

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        if not built:
            automaton = ahocorasick.Automaton()
            for name in shared.value:
                automaton.add_word(name, name)
            automaton.make_automaton()
            built.append(automaton)
        return texts.map(lambda text: sorted({name for _, name in built[0].iter(text or "")}))

    return find


def with_peer_group(docs: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Add ``grp``: the mapped family of the entity, else its first word in capitals."""
    default = T.peer_group("entity")
    if mapping is None:
        return docs.withColumn("grp", default)
    table = materialise(mapping.select("entity", F.col("grp").alias("_grp")), "peer-groups")
    size = table.agg(F.sum(F.octet_length("entity") + F.coalesce(F.octet_length("_grp"), F.lit(0)) + 32)).first()[0] or 0
    table = F.broadcast(table) if size <= NAMES_SHARED_BYTES else table  # a shuffle would move every text
    return docs.join(table, "entity", "left").withColumn("grp", F.coalesce("_grp", default)).drop("_grp")


# --- scan -------------------------------------------------------------------------------------------
def fingerprint_sections(docs: DataFrame, options: Options, names: DataFrame | None = None) -> DataFrame:
    """Sections of at least forty words with their masks, hashes, figures and flags."""
    clean = docs.withColumn("text", T.strip_scaffolding("text"))
    named = clean.withColumn("_names", F.array().cast("array<string>")) if names is None else with_names(clean, names)
    units = with_units(named, options.unit)
    keys = [c for c in named.columns if c != "text"]
    rows = explode_units(units, keys).withColumn("word_count", T.word_count("body"))
    rows = rows.filter(F.col("word_count") >= K.MIN_SECTION_WORDS)
    rows = rows.withColumn("norm", T.normalise("body", F.col("_names"), options.currency))
    return rows.select(
        "doc", "visit", "entity", "grp", "name", "written", "section_ord",
        F.struct("visit", "section_ord").alias("rank"), "heading", "has_table", "word_count", "norm",
        T.text_hash("norm").alias("form"), T.exact_hash("body").alias("exact"),
        T.money_tokens("body", options.currency).alias("money"),
        T.is_protected("heading", "body").alias("is_protected"), T.is_financial("heading").alias("is_financial"),
        F.substring("body", 1, K.EXAMPLE_CHARS).alias("example"))


def distinct_forms(sections: DataFrame) -> DataFrame:
    """Distinct masked texts with their first rank and word set."""
    forms = sections.groupBy("form").agg(F.min("rank").alias("rank"), F.max("norm").alias("norm"))
    return forms.select("form", "rank", T.word_set("norm").alias("words"))


def fingerprint_library(assigned: DataFrame) -> DataFrame:
    """One row per repeated passage, counted bottom-up: filings, then companies, then families.

    Each level groups by fewer keys than the one below, so a passage found in a large share of all
    documents is reduced before it meets in one place.
    """
    by_doc = assigned.groupBy("scan_fp", "grp", "entity", "doc").agg(
        F.min("exact").alias("lo"), F.max("exact").alias("hi"), F.max("written").alias("written"),
        F.max("name").alias("name"))
    local = F.struct("doc", "name")
    by_entity = by_doc.groupBy("scan_fp", "grp", "entity").agg(
        F.count(F.lit(1)).alias("files"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min(F.when(F.col("written"), local)).alias("local"))
    by_group = by_entity.groupBy("scan_fp", "grp").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("files").alias("files"), F.min("lo").alias("lo"),
        F.max("hi").alias("hi"), F.min("local").alias("local"))
    counted = by_group.groupBy("scan_fp").agg(
        F.sum("entities").alias("entities"), F.max("entities").alias("peer_entities"), F.sum("files").alias("files"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("local").alias("local"))
    founder = F.struct(
        "doc", "name", "written", "heading", "example", "money", "is_protected", "is_financial", "word_count")
    founders = assigned.filter(F.col("form") == F.col("scan_fp")).groupBy("scan_fp").agg(
        F.min_by(founder, "rank").alias("f"))
    own = F.when(F.col("f.written"), F.struct(F.col("f.doc").alias("doc"), F.col("f.name").alias("name")))
    return counted.join(founders, "scan_fp").select(
        F.col("scan_fp").alias("fp"), "entities", "peer_entities", "files",
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("only_exact"), F.col("f.heading").alias("heading"),
        F.col("f.example").alias("example"), F.col("f.money").alias("canonical_money"),
        F.col("f.is_protected").alias("is_protected"), F.col("f.is_financial").alias("is_financial"),
        F.col("f.word_count").alias("word_count"), F.col("f.doc").alias("first_doc"),
        F.coalesce(own, F.col("local")).alias("canonical"))


def effective_threshold(docs: DataFrame, threshold: int) -> int:
    """The threshold cannot exceed the number of companies, nor fall below two."""
    entities = docs.select("entity").distinct().count()
    return max(K.MIN_THRESHOLD, min(threshold, entities))


def is_boilerplate(threshold, peer_threshold: int) -> Column:
    repeated = (F.col("entities") >= F.lit(threshold)) | (F.col("peer_entities") >= F.lit(peer_threshold))
    return ~F.col("is_protected") & ~F.col("is_financial") & repeated


def prepare(references: DataFrame, targets: DataFrame | None = None, peer_groups: DataFrame | None = None) -> DataFrame:
    """The corpus to read: references and every target, each flagged with whether it is written."""
    if targets is None:
        corpus = references.withColumn("written", F.lit(True))
    else:
        # Only ids are shuffled: texts stay where they are read unless very many documents are targets.
        ids = materialise(targets.select("doc"), "targets")
        marked = references.join(_shared(ids.withColumn("written", F.lit(True))), "doc", "left").withColumn(
            "written", F.coalesce("written", F.lit(False)))
        corpus = marked.unionByName(union_references(targets, references).withColumn("written", F.lit(True)))
    return with_peer_group(corpus, peer_groups)


def union_references(targets: DataFrame, references: DataFrame) -> DataFrame:
    """The targets that are not among the references yet; they are found by ids alone."""
    others = materialise(targets.select("doc").join(references.select("doc"), "doc", "left_anti"), "targets")
    if others.isEmpty():
        return targets.limit(0)
    return targets.join(_shared(others).withColumnRenamed("doc", "_doc"), F.col("doc").eqNullSafe(F.col("_doc")), "left_semi")


def _shared(table: DataFrame) -> DataFrame:
    """A stored table of ids, broadcast if it is not too large."""
    size = table.agg(F.sum(F.octet_length(F.col("doc").cast("string")) + 32)).first()[0] or 0
    return F.broadcast(table) if size <= IDS_SHARED_BYTES else table


def scan(corpus: DataFrame, options: Options = Options(), names: DataFrame | None = None) -> Scan:
    """Build the library of repeated passages of a prepared corpus."""
    names = company_names(corpus) if names is None else names
    found = fingerprint_sections(corpus, options, names)
    clusters = None
    if options.similarity is None:
        sections = materialise(found.drop("norm"), "sections")
        assigned = sections.withColumn("scan_fp", F.col("form")).withColumn("match_fp", F.col("form"))
    else:
        with temporary(corpus.sparkSession) as kept:
            sections = materialise(found, "sections")
            forms = materialise_by(distinct_forms(sections), "form", "forms")
            clusters = leader_clusters(forms, options.similarity)
            assigned = materialise(assign(sections.drop("norm"), clusters), "assigned")
            kept += [clusters.leaders, clusters.links, assigned]
    library = materialise(fingerprint_library(assigned), "library")
    return Scan(assigned, library, clusters, options)


# --- decide -----------------------------------------------------------------------------------------
def removable(scanned: Scan, threshold: int) -> DataFrame:
    """Target sections that pass the guards, with the reason their passage could be dropped."""
    gates = F.col("written") & ~F.col("is_financial") & ~F.col("is_protected") & ~F.col("has_table")
    rule = is_boilerplate(threshold, scanned.options.peer_threshold)
    library = scanned.library.select(
        F.col("fp").alias("match_fp"), "entities", "files", "only_exact", "canonical_money", "canonical",
        rule.alias("boilerplate"))
    candidates = scanned.sections.filter(gates).drop("example", "is_protected", "is_financial", "has_table")
    repeated = library.filter(F.col("boilerplate") | ((F.col("entities") == 1) & (F.col("files") >= 2)))
    matched = lookup(candidates, repeated, "match_fp")
    restated = (
        (F.col("entities") == 1) & (F.col("files") >= 2) & (F.col("exact") == F.col("only_exact")))
    reason = F.when(F.col("boilerplate"), F.lit("boilerplate")).when(restated, F.lit("restatement"))
    return matched.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def claim_orphans(candidates: DataFrame) -> DataFrame:
    """Where no written document holds the kept copy, the first that could drop it keeps it."""
    orphans = candidates.filter(F.col("canonical").isNull())
    if orphans.isEmpty():
        return candidates
    claims = orphans.groupBy("match_fp").agg(
        F.min_by(F.struct("doc", "name"), F.struct("visit", "section_ord")).alias("_claim"))
    claimed = lookup(candidates, claims, "match_fp", "left")
    return claimed.withColumn("canonical", F.coalesce("canonical", "_claim")).drop("_claim")


def decide(scanned: Scan, threshold: int, verdicts: DataFrame | None = None) -> DataFrame:
    """The sections to replace: ``doc, section_ord, heading, reason, canonical, fp, pointer``.

    In safe mode boilerplate goes only where ``verdicts`` (``fp, verdict``) say 'strip'.
    """
    located = claim_orphans(materialise(removable(scanned, threshold), "removable"))
    away = located.filter(F.col("doc") != F.col("canonical")["doc"])
    if scanned.options.mode == "safe":
        away = apply_verdicts(away, verdicts)
    away = away.filter(~T.novel_money("money", "canonical_money"))
    label = F.coalesce(F.nullif("heading", F.lit("")), F.lit("(untitled)"))
    cited = F.coalesce(F.nullif(F.col("canonical")["name"], F.lit("")), F.lit("another filing"))
    return away.select(
        "doc", "section_ord", label.alias("heading"), "reason", cited.alias("canonical"),
        F.col("match_fp").alias("fp"),
        pointer_text(label, F.col("reason"), F.col("entities"), F.col("files"), cited).alias("pointer"))


def apply_verdicts(decisions: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """Boilerplate without an explicit 'strip' verdict stays; restatements are not gated."""
    if verdicts is None:
        return decisions.filter(F.col("reason") != "boilerplate")
    table = verdicts.select(F.col("fp").alias("match_fp"), "verdict")
    gated = lookup(decisions, table, "match_fp", "left")
    return gated.filter((F.col("reason") != "boilerplate") | (F.coalesce("verdict", F.lit("keep")) == "strip")).drop("verdict")


def classify(candidates: DataFrame, judge: Callable[[pd.DataFrame], pd.Series], known: DataFrame | None = None) -> DataFrame:
    """A caller's classifier over the distinct candidates: ``fp, verdict``, NULL where it failed (which keeps the text).

    ``judge`` gets Arrow batches of ``fp, heading, example, files``, the example cut to the reference's length, and returns
    'strip' or 'keep' per row. A batch that fails is asked row by row, so one bad passage costs no other its verdict, and other
    answers are failures. Verdicts in ``known``, from earlier runs, are taken over by fingerprint and not asked for again.
    """
    rows = candidates.select("fp", "heading", F.substring("example", 1, K.EXAMPLE_CHARS).alias("example"), "files").dropDuplicates(["fp"])
    held = None
    if known is not None:
        held = known.filter(F.col("verdict").isNotNull()).groupBy("fp").agg(F.max("verdict").alias("verdict"))
        rows, held = rows.join(held, "fp", "left_anti"), held.join(rows.select("fp"), "fp", "left_semi")

    def ask(batch: pd.DataFrame) -> list:
        try:
            given = list(judge(batch))
            if len(given) != len(batch):
                raise ValueError("one verdict per row")
            return [v if v in ("strip", "keep") else None for v in given]
        except Exception:  # the caller's code may fail in any way
            return [None] if len(batch) == 1 else [v for i in range(len(batch)) for v in ask(batch.iloc[[i]])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"fp": batch["fp"], "verdict": ask(batch)})

    asked = rows.mapInPandas(run, "fp string, verdict string")
    return asked if held is None else asked.unionByName(held)


def pointer_text(label: Column, reason: Column, entities: Column, files: Column, canonical: Column) -> Column:
    shared = F.format_string("standard statutory text shared by %d companies, %d filings", entities, files)
    repeated = F.format_string(
        "repeated verbatim from an earlier filing by this company (%d filings carry it)", files)
    note = F.when(reason == "boilerplate", shared).otherwise(repeated)
    return F.concat(F.lit("\n> [DEFLATED — "), label, F.lit(": "), note, F.lit(". Full text kept in `"),
                    canonical, F.lit("`.]\n"))


# --- rewrite ----------------------------------------------------------------------------------------
def rewrite(targets: DataFrame, removals: DataFrame, unit: str = "headings") -> DataFrame:
    """Lightweight texts with sizes. The pointers of a document fit in its row, as its text does."""
    pointers = removals.groupBy("doc").agg(
        F.array_sort(F.collect_list(F.struct("section_ord", "pointer"))).alias("_p"))
    rows = targets.join(pointers, "doc", "left").withColumn("_light", T.strip_scaffolding("text"))
    units = with_units(rows, unit, "_light").withColumn("_b", F.col("_u.body"))
    body = F.when(F.col("_p").isNull(), F.array_join("_b", "")).otherwise(
        splice(F.col("_b"), F.col("_p")))
    sized = units.select(
        "doc", "entity", "name", T.tidy(body).alias("content"), T.octets("text").alias("original_size"),
        F.coalesce(F.size("_p"), F.lit(0)).cast("bigint").alias("sections_removed"))
    return sized.withColumn("lightweight_size", T.octets("content")).withColumn(
        "reduction_pct", reduction_pct(F.col("lightweight_size"), F.col("original_size")))


def splice(bodies: Column, pointers: Column) -> Column:
    """Bodies in order with some replaced; ``pointers`` is ``[{section_ord, pointer}]`` in order.

    Each pointer takes the bodies since the one before it, so a text is put together in one pass.
    """
    after = F.coalesce(F.element_at(pointers, -1)["section_ord"], F.lit(-1)).cast("int")

    def stretch(p: Column, k: Column) -> Column:
        since = F.coalesce(F.get(pointers, k - 1)["section_ord"], F.lit(-1)).cast("int")
        here = p["section_ord"].cast("int")
        return F.concat(F.array_join(F.slice(bodies, since + 2, here - since - 1), ""), p["pointer"])

    rest = F.slice(bodies, after + 2, F.greatest(F.size(bodies) - after - 1, F.lit(0)))
    return F.concat(F.array_join(F.transform(pointers, stretch), ""), F.array_join(rest, ""))


def reduction_pct(light: Column, original: Column) -> Column:
    return F.when(original > 0, T.rounded((F.lit(1.0) - light / original) * 100, 1)).otherwise(F.lit(0.0))


def deflate(
    targets: DataFrame, references: DataFrame | None = None, options: Options = Options(),
    peer_groups: DataFrame | None = None, verdicts: DataFrame | None = None, names: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, Scan]:
    """The whole run: ``(file results with content, removals, scan)``."""
    corpus = prepare(targets if references is None else references, None if references is None else targets, peer_groups)
    threshold = effective_threshold(corpus, options.threshold)
    scanned = scan(corpus, options, names)
    removals = materialise(decide(scanned, threshold, verdicts), "removals")
    return rewrite(targets, removals, options.unit), removals, scanned
