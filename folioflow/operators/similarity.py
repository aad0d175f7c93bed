"""Near-duplicate texts: exact set-similarity matching and order-dependent leader clustering.

Texts are compared as word sets under Jaccard similarity. A text becomes a *leader* unless a leader
seen before it is similar enough; every other text is *linked* to all leaders it is similar to.

Candidates come from prefix filtering: with words ordered from rare to common, two sets of
similarity t or more share a word among their first ``n - ceil(t n) + 1``, and share their two
smallest common words among the first ``n - ceil(t n) + 2``. A prefix word found in few texts yields
its pairs directly. A prefix word found in many is refined to word pairs. Word pairs that are still
shared by many texts never yield all pairs: in each round only the first undecided texts of such a
group are compared with each other, those that turn out leaders then with the rest of the group. The
first rounds take few texts of a group, since in a group of near copies one leader settles all others;
groups that stay are of dissimilar texts, and take more and more of them at a time.

Any order of the words is right as long as it is one for all texts. The most common words are known exactly; how often the
others occur is read from a sketch of bounded size, so no word travels to its frequency. Words stand for their hashes: equal
hashes of different words only make more candidates, which the words themselves decide.

Every text carries a parity bitmap: bit h is set if an odd number of its words hash to it. Two bitmaps
differ in no more places than their texts differ in words, so nearly all pairs that merely share
common words are ruled out before a word list moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.operators.joins import lookup
from folioflow.plans.storage import materialise, materialise_by, temporary

PAIR_GROUP = 512                    # so a text is compared with as many others of a group at most; the pairs never leave their task
COMMON_WORDS = 20_000
SKETCH_CELLS = 1 << 24              # 64 cells of four bits are one row of the sketch
FRONT_GROWTH, FRONT_MOST = 8, 1024  # texts of a crowded group compared with each other in one round
SOLVED_AT_ONCE = 200_000            # links few enough to be walked in order by one task
LANES = 4


@dataclass
class Clusters:
    leaders: DataFrame  # form, rank, n
    links: DataFrame    # form, leader, leader_rank, leader_n, similarity


def required_overlap(n: Column, threshold: float) -> Column:
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")


def size_compatible(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) / F.greatest(a, b) >= F.lit(threshold)


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def bitmap() -> list[Column]:
    """Aggregates over the hashes ``word`` of the distinct words of a text: its parity bitmap, in lanes of 64 bits."""
    h = F.col("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 2).bitwiseAND(F.lit(63)).cast("int"))
    return [F.bit_xor(F.when(h.bitwiseAND(F.lit(LANES - 1)) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"bits{i}") for i in range(LANES)]


def may_reach(a_n: Column, b_n: Column, a_bits: Column, b_bits: Column, threshold: float) -> Column:
    """False only where sizes or bitmaps prove the similarity to be below the threshold."""
    apart = sum(F.bit_count(a_bits[f"bits{i}"].bitwiseXOR(b_bits[f"bits{i}"])) for i in range(LANES))
    most = (a_n + b_n) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-9)
    return size_compatible(a_n, b_n, threshold) & (apart <= most)


def frequency_sketch(rest: DataFrame, words: int) -> DataFrame:
    """``block`` and 64 cells of four bits in four numbers: the logarithm of the highest frequency in a cell, rounded up.

    Zero, also where a block is missing, means that every word of the cell is found in one text only.
    """
    cells = min(SKETCH_CELLS, 1 << max(10, (4 * words).bit_length()))
    found = rest.filter("df > 1").groupBy(F.col("word").bitwiseAND(F.lit(cells - 1)).alias("cell")).agg(F.max("df").alias("df"))
    level = F.least(F.ceil(F.log2("df")), F.lit(15)).cast("long")
    put = F.call_function("shiftleft", level, (F.col("cell") % 16 * 4).cast("int"))
    lane = F.shiftright("cell", 4) % 4
    return found.groupBy(F.shiftright("cell", 6).alias("block")).agg(
        F.array(*[F.bit_or(F.when(lane == i, put).otherwise(F.lit(0).cast("long"))) for i in range(4)]).alias("cells"),
        F.lit(cells - 1).cast("long").alias("mask"))


def rare_first(forms: DataFrame, threshold: float) -> DataFrame:
    """``form, rank, n, bits, keep, head``: the first ``keep + 1`` words of each text from rare to common, as hashes.

    Words found in one text only come first and are left out of ``keep`` and ``head``. Words carrying more than
    1/COMMON_WORDS of all entries are fewer than COMMON_WORDS, so their frequencies are broadcast; the others are
    ordered by a sketch of their frequencies, of SKETCH_CELLS cells at most. So the words stay with their text.
    """
    entries = forms.select("form", F.explode("words").alias("word")).select("form", F.xxhash64("word").alias("word"))
    frequency = materialise(entries.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word-frequency")
    held = frequency.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("words")).first()
    common = F.broadcast(frequency.filter(F.col("df") * COMMON_WORDS > F.lit(held["t"])))
    sketch = materialise(frequency_sketch(frequency.filter(F.col("df") * COMMON_WORDS <= F.lit(held["t"])), held["words"]), "sketch")
    mask = (sketch.first() or {"mask": 0})["mask"]
    cell = F.col("word").bitwiseAND(F.lit(mask))
    nibble = F.call_function("shiftright", F.get("cells", (F.shiftright(cell, 4) % 4).cast("int")), (cell % 16 * 4).cast("int"))
    level = F.coalesce(nibble.bitwiseAND(F.lit(15)), F.lit(0).cast("long"))
    known = entries.join(common, "word", "left").withColumn("block", F.shiftright(cell, 6)).join(F.broadcast(sketch.drop("mask")), "block", "left")
    at = F.coalesce(F.col("df") + 15, level)  # common words come last, in the order of their frequencies
    ordered = known.groupBy("form").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "word"))).alias("_o"), *bitmap())
    sized = forms.select("form", "rank", F.size("words").alias("n"))
    keep = F.col("n") - required_overlap(F.col("n"), threshold) + 1
    lone = F.size(F.filter("_o", lambda w: w["at"] == 0))
    return ordered.withColumn("_lone", lone).join(sized, "form").select(
        "form", "rank", "n", F.struct(*[f"bits{i}" for i in range(LANES)]).alias("bits"), F.greatest(keep - F.col("_lone"), F.lit(0)).alias("keep"),
        F.transform(F.slice("_o", F.col("_lone") + 1, F.greatest(keep + 1 - F.col("_lone"), F.lit(0))), lambda w: w["word"]).alias("head"))


def _by_signature(entries: DataFrame, label: str) -> DataFrame:
    """Entries whose signature occurs more than once, with the number of its members, stored so that joins on it move nothing."""
    stored = materialise_by(entries.repartition("sig"), "sig", label)
    sizes = stored.groupBy("sig").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > 1)
    return stored.join(sizes, "sig")


def _pairs_within(entries: DataFrame, threshold: float) -> DataFrame:
    """The pairs inside small groups that sizes and bitmaps leave open, each once."""
    a, b = (entries.select("sig", *[F.col(c).alias(f"{x}_{c}") for c in ("form", "n", "bits")]) for x in "ab")
    near = (F.col("a_form") < F.col("b_form")) & may_reach(*[F.col(c) for c in ("a_n", "b_n", "a_bits", "b_bits")], threshold)
    return a.join(b, "sig").filter(near).select(F.col("a_form").alias("a"), F.col("b_form").alias("b")).distinct()


def _earlier_first(edges: DataFrame) -> DataFrame:
    """Verified pairs with the earlier text as ``a``."""
    swap = F.col("a_rank") > F.col("b_rank")
    pick = lambda x, y, c: F.when(swap, F.col(y + c)).otherwise(F.col(x + c)).alias(x + c)
    return edges.select(*[pick(x, y, c) for c in ("", "_rank", "_n") for x, y in ("ab", "ba")], "similarity")


def verify(pairs: DataFrame, forms: DataFrame, threshold: float) -> DataFrame:
    """Keep the pairs ``(a, b)`` whose word sets reach the threshold; adds ranks and sizes.

    A text found in very many pairs is split over tasks by the adaptive skew join, on either side.
    """
    side = lambda x: forms.select(
        F.col("form").alias(x), F.col("rank").alias(f"{x}_rank"), F.size("words").alias(f"{x}_n"),
        F.col("words").alias(f"{x}_words"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    scored = both.withColumn("similarity", jaccard(F.col("a_words"), F.col("b_words")))
    return scored.filter(F.col("similarity") >= threshold).drop("a_words", "b_words")


def leader_clusters(forms: DataFrame, threshold: float = K.DEFAULT_SIMILARITY) -> Clusters:
    """Cluster distinct texts ``(form, rank, words)`` by leaders in rank order.

    The result equals visiting the texts one by one in rank order. ``forms`` must be stored, it is
    read several times.
    """
    with temporary(forms.sparkSession) as kept:
        forms = forms.filter(F.size("words") > 0)
        heads = materialise_by(rare_first(forms, threshold), "form", "heads")
        grouped = _by_signature(heads.select("form", "n", "bits", F.explode(F.slice("head", 1, F.col("keep"))).alias("sig")), "prefixes")
        small = _pairs_within(grouped.filter(F.col("members") <= PAIR_GROUP), threshold)
        large = materialise(grouped.filter(F.col("members") > PAIR_GROUP).select("form", "sig"), "large")

        crowded = None
        if not large.isEmpty():
            double = _by_signature(_word_pairs(large, heads, threshold), "prefix-pairs")
            small = small.unionByName(_pairs_within(double.filter(F.col("members") <= PAIR_GROUP), threshold)).distinct()
            crowded = materialise(double.filter(F.col("members") > PAIR_GROUP).drop("members"), "crowded")
            crowded = None if crowded.isEmpty() else crowded
        edges = materialise(_earlier_first(verify(small, forms, threshold)), "edges")
        clusters = _elect(forms, edges, crowded, threshold)
        kept += [clusters.leaders, clusters.links]
    return clusters


def _word_pairs(large: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """Entries of crowded prefix words, refined by each later word of the longer prefix."""
    at = F.array_position("head", F.col("first")).cast("int")
    rows = large.withColumnRenamed("sig", "first").join(heads, "form")
    seconds = F.slice("head", at + 1, F.greatest(F.size("head") - at, F.lit(0)))
    alone = F.when(required_overlap(F.col("n"), threshold) <= 1, F.array(F.xxhash64("first"))).otherwise(F.array().cast("array<bigint>"))
    return rows.select("form", "rank", "n", "bits", F.explode(F.concat(
        F.transform(seconds, lambda second: F.xxhash64(F.col("first"), second)), alone)).alias("sig"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _elect(forms: DataFrame, edges: DataFrame, crowded: DataFrame | None, threshold: float) -> Clusters:
    """Decide leaders.

    A text is a leader once no earlier undecided text can be similar to it, and merged once a similar
    earlier leader exists. Links alone decide as soon as no crowded group holds undecided texts.
    """
    merged_parts: list[DataFrame] = []
    link_parts: list[DataFrame] = []
    known = [edges]
    undecided = None
    if crowded is not None:
        touched = _union([edges.select(F.col(x).alias("form"), F.col(f"{x}_rank").alias("rank")) for x in "ab"] + [crowded.select("form", "rank")])
        undecided = materialise(touched.distinct(), "undecided")
    front = 1
    while undecided is not None and not undecided.isEmpty():
        open_forms = undecided.select("form")
        entries = materialise(crowded.join(open_forms, "form", "left_semi"), "open-entries")
        if entries.isEmpty():
            break
        behind, near = _fronts(entries, front, threshold)
        found = materialise(_earlier_first(verify(near, forms, threshold)), "front-edges")
        known.append(found)
        live = _open_edges(_union(known), open_forms)
        waiting = live.select(F.col("b").alias("form")).unionByName(behind)
        elected = materialise(undecided.join(waiting.distinct(), "form", "left_anti"), "elected")
        merged = live.join(elected.select(F.col("form").alias("a")), "a", "left_semi").select(F.col("b").alias("form"))
        links = materialise(_compare_with(elected, crowded, forms, threshold), "crowded-links")
        link_parts.append(links)
        merged = merged.unionByName(links.filter(F.col("leader_rank") < F.col("rank")).select("form").join(open_forms, "form", "left_semi"))
        merged = materialise(merged.distinct(), "merged")
        merged_parts.append(merged)
        undecided = materialise(
            undecided.join(elected.select("form"), "form", "left_anti").join(merged, "form", "left_anti"), "undecided")
        front = min(front * FRONT_GROWTH, FRONT_MOST)

    edges = edges if len(known) == 1 else materialise(_union(known).distinct(), "edges")
    merged_parts.append(_decide(edges if undecided is None else _open_edges(edges, undecided.select("form"))))

    sized = forms.select("form", "rank", F.size("words").alias("n"))
    leaders = materialise(sized.join(_union(merged_parts), "form", "left_anti"), "leaders")
    led = leaders.select(F.col("form").alias("leader"))

    def directed(leader: str, form: str) -> DataFrame:
        return edges.select(
            F.col(form).alias("form"), F.col(leader).alias("leader"), F.col(f"{leader}_rank").alias("leader_rank"),
            F.col(f"{leader}_n").alias("leader_n"), "similarity").join(led, "leader", "left_semi")

    links = directed("a", "b").unionByName(directed("b", "a"))
    if link_parts:
        links = links.unionByName(_union(link_parts).drop("rank"))
    return Clusters(leaders, materialise(links.distinct(), "links"))


def _open_edges(edges: DataFrame, open_forms: DataFrame) -> DataFrame:
    """Edges between undecided texts."""
    for x in "ab":
        edges = edges.join(open_forms.withColumnRenamed("form", x), x, "left_semi")
    return edges


def _fronts(entries: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The texts behind the first ``size`` of some group, and the open pairs among the first of each group."""
    order = Window.partitionBy("sig").orderBy("rank")
    first = materialise(entries.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size), "fronts")
    ends = first.groupBy("sig").agg(F.max("rank").alias("last"), F.count(F.lit(1)).alias("held")).filter(F.col("held") == size)
    behind = entries.join(ends, "sig").filter(F.col("rank") > F.col("last")).select("form")
    return behind, _pairs_within(first, threshold)


def _decide(edges: DataFrame) -> DataFrame:
    """Texts merged by ``edges`` alone: those with an earlier neighbour that is not merged itself.

    Texts without an earlier undecided neighbour are decided in rounds, until the links left are few enough for one task
    to walk them in rank order.
    """
    merged: list[DataFrame] = []
    while edges.count() > SOLVED_AT_ONCE:
        later = edges.select(F.col("b").alias("form")).distinct()
        heads = edges.join(later.withColumnRenamed("form", "a"), "a", "left_anti")
        gone = materialise(heads.select(F.col("b").alias("form")).distinct(), "merged")
        merged.append(gone)
        decided = heads.select(F.col("a").alias("form")).unionByName(gone).distinct()
        edges = materialise(edges.join(decided.withColumnRenamed("form", "a"), "a", "left_anti").join(
            decided.withColumnRenamed("form", "b"), "b", "left_anti"), "edges")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: set[str] = set()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                if a not in gone:
                    gone.add(b)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(gone), pa.string())], names=["form"])

    ordered = edges.select("a", "b", "a_rank", "b_rank").coalesce(1).sortWithinPartitions("b_rank", "a_rank").select("a", "b")
    merged.append(ordered.mapInArrow(walk, "form string"))
    return _union(merged)


def _compare_with(elected: DataFrame, crowded: DataFrame, forms: DataFrame, threshold: float) -> DataFrame:
    """Links between newly elected leaders and every text sharing a crowded group with them.

    A group elects at most its front in a round; nearly all pairs end at their bitmaps.
    """
    fronts = crowded.join(elected.select("form"), "form", "left_semi").select(
        "sig", F.col("form").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"))
    near = crowded.join(fronts, "sig").filter(
        (F.col("form") != F.col("a")) & may_reach(F.col("a_n"), F.col("n"), F.col("a_bits"), F.col("bits"), threshold))
    pairs = near.select("a", F.col("form").alias("b")).distinct()
    return verify(pairs, forms, threshold).select(
        F.col("b").alias("form"), F.col("b_rank").alias("rank"), F.col("a").alias("leader"),
        F.col("a_rank").alias("leader_rank"), F.col("a_n").alias("leader_n"), "similarity")


def adjacent_leaders(links: DataFrame) -> DataFrame:
    """Per linked text its leaders, in the order they are tried: by size, then by rank."""
    return links.groupBy("form").agg(F.array_sort(F.collect_list(
        F.struct("leader_n", "leader_rank", "leader"))).alias("tried"))


def assign(sections: DataFrame, clusters: Clusters) -> DataFrame:
    """Add to each occurrence ``scan_fp``, the leader it met when it was visited, and ``match_fp``,
    the leader it matches in the complete library."""
    tried = lookup(sections, adjacent_leaders(clusters.links), "form", "left")
    seen = F.filter("tried", lambda t: t["leader_rank"] < F.col("rank"))
    return tried.select(
        *sections.columns, F.coalesce(F.get(seen, F.lit(0))["leader"], F.col("form")).alias("scan_fp"),
        F.coalesce(F.get(F.col("tried"), F.lit(0))["leader"], F.col("form")).alias("match_fp"))
