"""Line deduplication by winnowing, in native expressions only.

A run of lines counts if it has ``run`` lines, or fewer that hold ``words`` words together. Every such run selects the minimum of
its line hashes (the rightmost of equals) as its fingerprint, so two documents that share a run share a fingerprint at the same
place of it. Only selected lines travel, each with its position and the hashes of the lines around it. Fingerprints found at one
position only are dropped. At the others a match is extended from the fingerprint to both sides, line by line, over every run that
selected it, and each position is joined with the earliest one of the same run, in the order of (doc_id, text hash, line number).
Matches that overlap or touch make the maximal runs; the later ones are deleted. Runs are judged on the input.

First positions are minima, combined before the shuffle and stored before they are joined, so a line
found in a third of all documents is split like any other. Texts move once, to meet their removals.

Edge cases: a null text stays null with no lines; an empty text is one empty line; blank lines are lines like any other;
texts with fewer lines than ``run`` keep them unless they hold ``words`` words; rows with equal doc_id and text are one document and
stay alike; rows with a null doc_id are neither sources nor cleaned; a text whose lines all go becomes empty, its row stays; an empty
table gives no rows; extra columns of any name are kept, n_lines and n_removed are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Store, free_name

RUN, WORDS = 3, 50


def selecting(h: Column, counts: Column, p: Column, run: int, words: int) -> Column:
    """The runs that select line ``p``, as numbers: lines before it * ``run`` + lines after it."""
    own, found = F.get(h, p), []
    for before in range(run):
        for after in range(run - before):
            tests = [own <= F.get(h, p - k) for k in range(1, before + 1)] + [own < F.get(h, p + k) for k in range(1, after + 1)]
            if before + after + 1 < run:
                tests.append(sum((F.get(counts, p + k) for k in range(-before + 1, after + 1)), F.get(counts, p - before)) >= words)
            found.append(F.when(reduce(lambda x, y: x & y, tests, F.lit(True)), F.lit(before * run + after)))
    return F.array_compact(F.array(*found))


def fingerprints(docs: DataFrame, run: int, words: int) -> DataFrame:
    """(doc_id, mark, fp, p, around, runs): selected lines, the hashes of the lines around them, the runs that select them."""
    lines = docs.filter("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("mark"), F.split("text", "\n").alias("lines"))
    lines = lines.select("doc_id", "mark", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"),
                         F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))).alias("counts"))
    places = lines.select("doc_id", "mark", "h", "counts", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("p"))
    h, p = F.col("h"), F.col("p")
    around = F.array(*[F.get(h, p + k) for k in range(1 - run, run)])
    found = places.select("doc_id", "mark", F.get(h, p).alias("fp"), "p", around.alias("around"), selecting(h, F.col("counts"), p, run, words).alias("runs"))
    return found.filter(F.size("runs") > 0)


def matches(docs: DataFrame, store: Store, run: int, words: int) -> DataFrame:
    """(doc_id, mark, i, n, source): later runs of ``n`` lines from line ``i``, and the earliest position of the same lines."""
    found = store.save(fingerprints(docs, run, words), "fingerprints")
    place = F.struct("doc_id", "mark", "p")
    repeated = found.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("fp")
    met = found.join(store.save(repeated, "repeated"), "fp").withColumn("r", F.explode("runs"))
    before, after = F.floor(F.col("r") / run).cast("int"), F.col("r") % run
    met = met.select("doc_id", "mark", (F.col("p") - before).alias("i"), (before + after + 1).alias("n"),
                     F.slice("around", F.lit(run) - before, before + after + 1).alias("same"))
    # Equal lines are told by two hashes of the whole run, one from either end.
    met = met.select("doc_id", "mark", "i", "n", F.xxhash64("n", "same").alias("k1"), F.xxhash64(F.reverse("same"), "n").alias("k2"))
    met = store.save(met, "positions")
    here = F.struct("doc_id", "mark", "i")
    first = met.groupBy("k1", "k2").agg(F.min(here).alias("source"), F.max(here).alias("last")).filter("source <> last")
    first = store.save(first.select("k1", "k2", "source"), "sources")
    return met.join(first, ["k1", "k2"]).filter(here > F.col("source")).select("doc_id", "mark", "i", "n", "source")


def removals(docs: DataFrame, store: Store, run: int, words: int) -> DataFrame:
    """(doc_id, mark, gone): sorted numbers of the lines to delete."""
    later = matches(docs, store, run, words).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("i", "n")).alias("s"))
    spread = F.flatten(F.transform("s", lambda m: F.sequence(m["i"], m["i"] + m["n"] - 1)))
    return later.select("doc_id", "mark", F.array_sort(F.array_distinct(spread)).alias("gone"))


def dedup_lines(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """``docs`` with its lines cleaned, and n_lines, n_removed (names of the input that clash are replaced)."""
    store, own = Store(docs.sparkSession, "lines"), free_name(docs, "_line")
    gone = removals(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), store, run, words)
    gone = store.save(gone, "removals")
    store.keep(gone)
    cut, bounds, split = f"{own}_gone", f"{own}_bounds", f"{own}_split"
    gone = gone.select(F.col("doc_id").alias(f"{own}_doc"), F.col("mark").alias(f"{own}_mark"), F.col("gone").alias(cut))
    # The same join at every size: removals are broadcast nowhere.
    with_gone = docs.join(gone.hint("merge"), (F.col("doc_id") == F.col(f"{own}_doc")) & (F.xxhash64("text") == F.col(f"{own}_mark")), "left")
    lines = F.split("text", "\n")
    # Bounds of the kept stretches: before, between and after the deleted lines.
    ends = F.concat(F.array(F.lit(-1)), F.col(cut), F.array(F.size(split)))
    kept = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(cut)),
        lambda k: F.slice(split, F.get(bounds, k) + 2, F.get(bounds, k + 1) - F.get(bounds, k) - 1)))
    out = with_gone.withColumn(split, F.when(F.col(cut).isNotNull(), lines)).withColumn(bounds, ends)
    return (out.withColumn("n_lines", F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"))
            .withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
            .withColumn("n_removed", F.when(F.col(cut).isNull(), F.lit(0)).otherwise(F.size(cut)).cast("long"))
            .drop(f"{own}_doc", f"{own}_mark", cut, split, bounds))
