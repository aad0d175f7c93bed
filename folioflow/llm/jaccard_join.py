"""Similarity join on word shingles by adaptive multi-match prefixes.

Shingle sets are ordered by one global order: shingles that occur in many documents last, the most
frequent behind the others, all else by their hash. Two sets of at least the wanted Jaccard similarity share at least ``l`` shingles of their
``l``-prefixes, where the ``l``-prefix of a set of ``n`` is its first ``n - ceil(t*n) + l`` shingles.
Every document chooses its ``l`` by the estimated cost of its candidates: longer prefixes cost more
list entries but ask for more shared ones. Of a pair, the larger set probes with its own ``l``.

Equal sets are one node from the start. Lists of at most ``crowded`` sets are compared pair by pair. A set with
fewer than ``l`` shingles of longer lists in its ``l``-prefix shares one of a short list with every partner, whichever of
the two is larger, and needs no long list. Long lists hold only the other sets, the needy ones: members of large groups.
Such a list elects its most central set as leader, and every member is compared with the leader
only. Members linked to it form one component. Any other pair x, y of the list has a member, say x, not linked to the
leader: |x ^ leader| is larger than linked sets of their sizes may differ by, and |x ^ y| = |(x ^ leader) ^ (y ^ leader)| is
not. So y shares at least about half its difference from the leader with x, and x all of its own but what linked sets may
differ by. The differences are joined by prefixes of their own, under keys of leader and shingle, and long lists of
these go on in the same way. A group of copies costs work in proportion to its size, is never expanded into all
pairs, and no link between different components is lost.

Edge cases: a null or wordless text has an empty set and links with nothing; a text with fewer words
than a shingle is one shingle; rows that repeat a doc_id are one document, whose set is the smallest by
(size, hash) of its rows, and each row is returned; a null doc_id links with nothing; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import LEAN, Store, WordHashes, chunks, components, mixed

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SIX_BYTES = np.uint64((1 << 48) - 1)
STEP, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


@dataclass(frozen=True)
class JoinOptions:
    """``percent``: link if 100 * intersection >= percent * union. ``most_shared``: largest ``l``.

    The rest shapes the plan, never the result: lists longer than ``crowded`` go through leaders, for at
    most ``leader_rounds`` rounds, after which they are compared pair by pair; ``common_share`` is the share of documents from which a
    shingle is surely ordered last, of which at most ``common_bound`` are sent to the executors (16 bytes each). If more than
    ``needy_share`` of the documents need long lists, the shingles of these are ordered last too, and prefixes are made anew. Up to ``cheap`` pairs a row of the long lists are compared without leaders.
    Needy sets get an order of their own if all their shingles are at most ``own_share`` of the rows of the first lists.
    """

    words: int = 3
    percent: int = 90
    most_shared: int = 4
    crowded: int = 100
    leader_rounds: int = 6
    common_share: float = 1 / 2000
    common_bound: int = 400_000
    needy_share: float = 1 / 50
    own_share: float = 1 / 10
    cheap: int = 10


def needed(n, percent: int):
    """Smallest overlap of a linked pair that contains a set of ``n``."""
    return (percent * n + 99) // 100


class Shingler:
    """Sets of shingle hashes of texts, sorted ascending."""

    def __init__(self, words: int):
        self.words, self.hashes = words, WordHashes()

    def sets(self, texts) -> list[np.ndarray]:
        k, sizes, flat = self.words, [], []
        for t in texts:
            words = t.encode("utf-8", "surrogatepass").translate(LOWER).split() if isinstance(t, str) else []
            sizes.append(len(words))
            flat.extend(map(self.hashes.__getitem__, words))
        flat = np.array(flat, dtype=np.uint64)
        whole = np.zeros(max(len(flat) - k + 1, 0), dtype=np.uint64)
        for j in range(k):
            whole = mixed(whole + np.uint64((STEP * (j + 1)) & MASK) + flat[j : j + len(whole)])
        out, at = [], 0
        for n in sizes:
            if n >= k:
                out.append(np.unique(whole[at : at + n - k + 1]))
            else:
                h = np.zeros(min(n, 1), dtype=np.uint64)
                for j in range(n):
                    h = mixed(h + np.uint64((STEP * (j + 1)) & MASK) + flat[at + j])
                out.append(mixed(h + np.uint64(n)) if n else h)
            at += n
        return out


def signature(s: np.ndarray) -> int:
    return int(np.add.reduce(mixed(s + np.uint64(len(s))), dtype=np.uint64).view(np.int64))


def describe(texts: DataFrame, o: JoinOptions) -> DataFrame:
    """One row per document (size, signature and parities of its set) and rows of shingles common in a batch.

    The parities of 512 classes of hashes rule out most pairs below the threshold without their sets: two
    sets differ by at least as many members as their parities differ.

    A shingle in more than ``common_share`` of all documents is in more than that share of some batch;
    counts below three, or half that share of a batch, are left out, so the sums are low by as much at most.
    """

    def run(frames):
        shingler = Shingler(o.words)
        for frame in chunks(frames, 4000):
            sets = shingler.sets(frame["text"])
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "n": [len(s) for s in sets],
                "sig": [signature(s) if len(s) else 0 for s in sets], "bits": [parities(s) for s in sets], "token": None, "seen": None,
            }).astype({"token": "Int64", "seen": "Int64"})
            values, seen = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            keep = seen >= max(3, len(sets) * o.common_share / 2)
            yield pd.DataFrame({
                "doc_id": None, "n": None, "sig": None, "bits": None, "token": values[keep].view(np.int64), "seen": seen[keep],
            }).astype({"doc_id": "str", "n": "Int64", "sig": "Int64"})

    # Ids go as text: pandas would make floats of numbers with nulls among them.
    out = texts.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        run, "doc_id string, n long, sig long, bits array<long>, token long, seen long")
    return out.withColumn("doc_id", F.expr("try_cast(doc_id as bigint)"))


def prefixes(texts: DataFrame, common: np.ndarray, rank: np.ndarray, o: JoinOptions) -> DataFrame:
    """Prefix shingles (token, n, sig, level): level ``l`` is the shortest prefix that holds the shingle.

    ``common`` shingles, sorted by value, stand last, by their ``rank``.
    """

    def run(frames):
        shingler, done = Shingler(o.words), set()
        for frame in chunks(frames, 2000):
            parts = []
            for s in shingler.sets(frame["text"]):
                if not len(s):
                    continue
                sig = signature(s)
                if (len(s), sig) in done:  # copies within a task are sent once
                    continue
                done.add((len(s), sig))
                base = len(s) - needed(len(s), o.percent) + 1
                size = min(len(s), base + min(o.most_shared, needed(len(s), o.percent)) - 1)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    last = common[at] == s
                    s = np.concatenate([s[~last], s[last][np.argsort(rank[at[last]])]])
                parts.append((s[:size].view(np.int64), sig, np.maximum(np.arange(size) - base + 2, 1)))
                parts[-1] += (np.full(size, len(s)),)
            if len(done) > 500_000:
                done.clear()
            if parts:
                yield pd.DataFrame({
                    "token": np.concatenate([p[0] for p in parts]),
                    "n": np.concatenate([p[3] for p in parts]).astype(np.int32),
                    "sig": np.repeat([p[1] for p in parts], [len(p[0]) for p in parts]),
                    "level": np.concatenate([p[2] for p in parts]).astype(np.int32)})

    return texts.mapInPandas(run, "token long, n int, sig long, level int")


def repeated_only(listed: DataFrame) -> DataFrame:
    """Rows of shingles with at least two different sets; ``listed`` is dealt and sorted by shingle.

    The rows of the last shingle of a batch wait for the next batch, unless it is known to repeat.
    """

    def run(frames):
        wait, known = None, None
        for frame in frames:
            if wait is not None and len(wait):
                frame = pd.concat([wait, frame], ignore_index=True)
            token, sig = frame["token"].to_numpy(), frame["sig"].to_numpy()
            if not len(token):
                continue
            cut = np.nonzero(np.concatenate([[True], token[1:] != token[:-1]]))[0]
            several = np.minimum.reduceat(sig, cut) < np.maximum.reduceat(sig, cut)
            several |= token[cut] == known if known is not None else False
            last = token[-1]
            keep = np.repeat(several, np.diff(np.append(cut, len(token))))
            known = last if several[-1] else None
            wait = frame.iloc[cut[-1] :] if not several[-1] else None
            yield frame[keep]

    return listed.mapInPandas(run, "token long, n int, sig long, level int")


def stored_sets(texts: DataFrame, wanted: DataFrame, o: JoinOptions) -> DataFrame:
    """(id, grams): the sorted hashes, six bytes each, of the whole sets of ``wanted`` (id, sig).

    A repeated doc_id has several texts: those of another signature are left out.
    """

    def run(frames):
        shingler = Shingler(o.words)
        for frame in chunks(frames, 2000):
            sets = shingler.sets(frame["text"])
            own = np.array([len(s) > 0 and signature(s) == sig for s, sig in zip(sets, frame["sig"])], dtype=bool)
            yield pd.DataFrame({"id": frame["doc_id"][own], "grams": [packed(s) for s, k in zip(sets, own) if k]})

    rows = texts.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id")
    return rows.select("doc_id", "text", "sig").mapInPandas(run, "id long, grams binary")


def parities(s: np.ndarray) -> list[int]:
    odd = (np.bincount((s & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def packed(s: np.ndarray) -> bytes:
    return np.sort(s & SIX_BYTES).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(grams: bytes) -> np.ndarray:
    wide = np.zeros((len(grams) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(grams, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def overlap(a: bytes, b: bytes) -> int:
    both = np.sort(np.concatenate([unpacked(a), unpacked(b)]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def plausible(pairs: DataFrame, bits: DataFrame, o: JoinOptions) -> DataFrame:
    """Pairs (a, b) whose parities differ by no more than linked sets of their sizes may."""
    x = bits.select(F.col("id").alias("a"), F.col("n").alias("nx"), F.col("bits").alias("x"))
    y = bits.select(F.col("id").alias("b"), F.col("n").alias("ny"), F.col("bits").alias("y"))
    apart = sum(F.bit_count(F.get("x", F.lit(k)).bitwiseXOR(F.get("y", F.lit(k)))) for k in range(8))
    most = (F.col("nx") + F.col("ny")) * (100 - o.percent)  # |x ^ y| * (100 + p) <= (|x| + |y|) * (100 - p)
    return pairs.join(x, "a").join(y, "b").filter(apart * (100 + o.percent) <= most).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, o: JoinOptions) -> DataFrame:
    """The pairs (a, b) that are linked, tested on whole sets."""

    def run(frames):
        for frame in frames:
            keep = []
            for x, y in zip(frame["x"], frame["y"]):
                i = overlap(x, y)
                keep.append(100 * i >= o.percent * (len(x) // 6 + len(y) // 6 - i))
            yield frame.loc[keep, ["a", "b"]]

    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def against_leaders(pairs: DataFrame, sets: DataFrame, common: np.ndarray, o: JoinOptions) -> DataFrame:
    """Members ``a`` against leaders ``b``: links (linked, key 0) and prefixes of the differences (key, at, d).

    ``at`` is a shingle's place in the order of its difference, counted from 0, ``d`` the size of the whole difference.

    The order of a difference depends on shingle and leader only: first the shingles that the leader has not,
    common ones behind the others, then the leader's, common ones first. Members unlike the leader lack most of its
    shingles alike; placed first, these would gather them all in new crowded lists.

    Two members linked to the leader are of one component, so a pair to be found has one, x, that is not. With
    t = (100 - p) / (100 + p), linked sets differ by t * (sum of their sizes) at most, so that of y's difference d they share
    (|x ^ leader| + d - |x ^ y|) / 2 > (d + t * (|leader| - |y|)) / 2: what a linked y asks for. An unlinked x asks for all
    but the |x| * (100 - p) / p shingles by which it may differ from any set.
    """

    common = np.sort(common & SIX_BYTES)

    def run(frames):
        for frame in chunks(frames, 2000):
            a, b, linked, key, place, size = [], [], [], [], [], []
            for i, lead, x, y in zip(frame["a"], frame["b"], frame["x"], frame["y"]):
                joint = np.concatenate([unpacked(x), unpacked(y)])
                order = np.argsort(joint, kind="stable")
                both = joint[order]
                once = np.ones(len(both), bool)
                same = both[1:] == both[:-1]
                once[1:] &= ~same
                once[:-1] &= ~same
                nx, ny, shared = len(x) // 6, len(y) // 6, int(same.sum())
                apart, leads, often = both[once], order[once] >= nx, np.zeros(int(once.sum()), bool)
                if 100 * shared >= o.percent * (nx + ny - shared):
                    a.append(i), b.append(lead), linked.append(True), key.append(0), place.append(0), size.append(0)
                    ask = (len(apart) * (100 + o.percent) + (ny - nx) * (100 - o.percent)) // (2 * (100 + o.percent)) + 1
                else:
                    ask = max(1, len(apart) - nx * (100 - o.percent) // o.percent)
                if len(common) and len(apart):
                    at = np.minimum(np.searchsorted(common, apart), len(common) - 1)
                    often = common[at] == apart
                late = np.where(leads, 3 - often.astype(int), often.astype(int))
                tokens = apart[np.argsort(late, kind="stable")[: max(len(apart) - ask + 1, 0)]]
                keys = mixed(tokens + np.uint64((int(lead) * STEP) & MASK)).view(np.int64)
                a += [i] * len(keys)
                b += [lead] * len(keys)
                linked += [False] * len(keys)
                key += keys.tolist()
                place += range(len(keys))
                size += [len(apart)] * len(keys)
            yield pd.DataFrame({"a": a, "b": b, "linked": linked, "key": key, "at": place, "d": size}).astype(
                {"a": "int64", "b": "int64", "linked": "bool", "key": "int64", "at": "int64", "d": "int64"})

    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(
        run, "a long, b long, linked boolean, key long, at long, d long")


def choose_shared(postings: DataFrame, o: JoinOptions) -> DataFrame:
    """(id, n, l, central, crowds, needy): the prefix with the least estimated cost, and where the set stands.

    ``l``-prefixes of list entries E have at most E / l partners with l shared shingles (Markov); a
    list entry costs one unit, verifying a partner its share of the set. ``central`` is the mean number
    of partners of a prefix shingle, ``crowds`` the number of shingles of the chosen prefix in crowded lists. A set is
    ``needy``, with ``l`` 1, if these may be all that it shares, whatever ``l``.
    """
    levels = range(1, o.most_shared + 1)
    sums = postings.groupBy("id").agg(
        F.first("n").alias("n"), F.sum(F.col("df") - 1).alias("partners"),
        *[F.sum(F.when((F.col("level") <= l) & (F.col("df") <= o.crowded), F.col("df") - 1)).alias(f"e{l}") for l in levels],
        *[F.count(F.when((F.col("level") <= l) & (F.col("df") > o.crowded), 1)).alias(f"c{l}") for l in levels])
    ask = F.floor((F.col("n") * o.percent + 99) / 100)
    cost = [F.struct((F.col(f"c{l}") >= l).alias("needy"),
                     (F.coalesce(F.col(f"e{l}"), F.lit(0)) * (1 + (F.col("n") / 8 + 4) / F.greatest(l - F.col(f"c{l}"), F.lit(1)))).alias("cost"),
                     F.lit(l).alias("l"), F.col(f"c{l}").alias("crowds")) for l in levels]
    allowed = F.filter(F.array(*cost), lambda c: (c["l"] == 1) | ((c["l"] <= ask) & ~c["needy"]))
    best = sums.withColumn("best", F.array_min(allowed))
    return best.select("id", "n", (F.col("partners") / F.col("n")).alias("central"), "best.l", "best.crowds", "best.needy")


def own_lists(sets: DataFrame, o: JoinOptions) -> DataFrame:
    """Lists (key, id, at, d) that join the sets (id, grams) with each other: shingles of their prefixes.

    Shingles are ordered by the number of these sets that hold them, rare ones first. A shingle that many documents hold may
    be rare among the few sets that need long lists.
    """

    def run(frames):
        for frame in chunks(frames, 2000):
            sizes = np.array([len(g) // 6 for g in frame["grams"]], dtype=np.int64)
            keys = [unpacked(g).view(np.int64) for g in frame["grams"]]
            yield pd.DataFrame({"id": np.repeat(frame["id"].to_numpy(), sizes), "n": np.repeat(sizes, sizes),
                                "key": np.concatenate([np.zeros(0, np.int64), *keys])})

    grams = sets.mapInPandas(run, "id long, n long, key long")
    held = grams.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    # Shingles of one set alone stand first, so of the others the prefix holds as many as exceed the wanted overlap, and one.
    shared = grams.join(held, "key").groupBy("id").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("held", "key"))).alias("own"))
    size = F.greatest(F.size("own") - F.floor((F.col("n") * o.percent + 99) / 100).cast("int") + 1, F.lit(0))
    placed = shared.select("id", "n", (F.col("n") - F.size("own")).alias("alone"), F.posexplode(F.slice("own", F.lit(1), size)).alias("i", "own"))
    return placed.select("own.key", "id", (F.col("alone") + F.col("i")).alias("at"), F.col("n").alias("d"))


def cross_pairs(lists: DataFrame, o: JoinOptions) -> DataFrame:
    """Pairs (a, b) of different components and fitting sizes that share a list; ``main`` is a component of the list.

    At least one of such a pair is outside ``main``, so only these rows meet the whole list.

    With D the most by which linked sets of their sizes may differ, the two differences d share (d_x + d_y - D) / 2 shingles at
    least. The first they share is so far in front that as many can follow: 2 * at_x <= d_x - d_y + D, and the same for y.
    Of a pair, the smaller difference holds it within D / 2 places: one of the two is ``first``.
    """
    x, y = (lists.select("key", "main", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "component", "at", "d", "first")]) for s in "xy")
    most = (F.col("n_x") + F.col("n_y")) * (100 - o.percent)
    more = F.col("d_x") - F.col("d_y")
    met = x.filter("component_x <> main").drop("main").join(y.drop("main"), "key").filter(
        (F.col("component_x") != F.col("component_y")) & (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * o.percent)
        & (F.col("first_x") | F.col("first_y"))
        & ((2 * F.col("at_x") - more) * (100 + o.percent) <= most) & ((2 * F.col("at_y") + more) * (100 + o.percent) <= most))
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def list_sizes(entries: DataFrame) -> DataFrame:
    """(key, g, firsts, lead, main) of the lists that hold more than one component; only those with ``firsts`` can link."""
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.count_if("first").alias("firsts"),
                                       F.min("component").alias("lo"), F.max("component").alias("hi"),
                                       F.max(F.struct("central", "id", "component")).alias("lead"))
    return sizes.filter("lo < hi").select("key", "g", "firsts", F.col("lead.id").alias("lead"), F.col("lead.component").alias("main"))


def through_leaders(lists: DataFrame, about: DataFrame, sets: DataFrame, common: np.ndarray, store: Store, o: JoinOptions):
    """Lists (key, id, at, d): links found with leaders, labels of their components, pairs still to verify.

    Members of the leader's component need not meet in a list; the others meet all of it. Where that makes no more
    pairs than ``cheap`` times the first lists had rows, no further round is needed, nor where the differences from the leaders
    would make more pairs than the lists they come from. Lists that are not crowded wait for the components of the last round.
    """
    links, labels, seen, rounds, waiting, crowds, most = None, None, None, 0, [], None, None
    columns, first = ("key", "id", "at", "d"), 2 * F.col("at") * o.percent <= F.col("n") * (100 - o.percent)
    rows = lists.count()
    if not rows:
        return links, labels, None
    few_pairs = rows * o.cheap
    while True:
        entries = store.save(with_label(lists.join(about, "id"), labels).withColumn("first", first), "entries")
        store.drop(seen)
        sizes = store.save(list_sizes(entries), "sizes")
        big = sizes.filter(F.col("g") > o.crowded)
        outside = entries.join(big, "key").filter("component <> main")
        pairs = F.when(F.col("first"), F.col("g")).otherwise(F.col("firsts"))
        wide, left = outside.agg(F.coalesce(F.sum("g"), F.lit(0)), F.coalesce(F.sum(pairs), F.lit(0))).first()
        worse = most is not None and wide > most[0]
        last = worse or rounds == o.leader_rounds or left <= few_pairs
        if worse and left > most[1]:
            waiting.append(crowds)
            store.drop(entries)
        else:
            rest = sizes if last else sizes.filter(F.col("g") <= o.crowded)
            waiting.append(entries.join(rest.filter("firsts > 0").select("key"), "key").select(*columns))
        if last:
            break
        big = big.filter("firsts > 0")
        rounds += 1
        crowds, most = entries.join(big.select("key"), "key").select(*columns), (wide, left)
        met = entries.join(big.select("key", "lead"), "key").filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
        seen = store.save(against_leaders(met, sets, common, o), "seen")
        found = store.save(seen.filter("linked").select("a", "b"), "found")
        links = found if links is None else links.union(found)
        labels = store.save(components(links, store), "labels")
        keys = seen.filter("not linked").select("key", F.col("a").alias("id"), "at", "d")
        several = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
        lists = keys.join(several, "key")
    known = with_label(about, labels)
    # Lists of one leader in two rounds are one list.
    entries = store.save(reduce(DataFrame.union, waiting).distinct().join(known, "id").withColumn("first", first), "entries")
    return links, labels, store.save(cross_pairs(entries.join(list_sizes(entries).filter("firsts > 0").select("key", "main"), "key"), o), "pairs")


def listed_prefixes(texts: DataFrame, classes: DataFrame, often: dict[int, int], store: Store, o: JoinOptions):
    """Prefix shingles of at least two sets with their number, what each set asks for, and the shingles ordered last."""
    common = np.sort(np.array(list(often), dtype=np.int64).view(np.uint64))
    seen = np.array([often[t] for t in common.view(np.int64).tolist()], dtype=np.int64)
    rank = np.empty(len(common), np.int64)
    rank[np.argsort(seen, kind="stable")] = np.arange(len(common))
    width = max(int(store.spark.conf.get("spark.sql.shuffle.partitions")), 8)
    listed = repeated_only(prefixes(texts, common, rank, o).repartition(width, "token").sortWithinPartitions("token"))
    hits = listed.groupBy("token", "n", "sig").agg(F.min("level").alias("level"))
    found = store.save(hits.withColumn("n", F.col("n").cast("long")), "hits")
    hits = store.save(found.join(classes, ["n", "sig"]).select("token", "id", "n", "level"), "hits")
    store.drop(found)
    df = store.save(hits.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "df")
    postings = store.save(hits.join(df, "token"), "postings")
    store.drop(hits, df)
    return postings, store.save(choose_shared(postings, o), "about"), common


def jaccard_components(docs: DataFrame, options: JoinOptions | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, n_links_found.

    ``n_links_found`` counts the verified links that joined the document's class to others; links
    inside components that were already joined are not searched.
    """
    o, store = options or JoinOptions(), Store(docs.sparkSession, "jaccard", LEAN)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    facts = store.save(describe(texts, o), "facts")
    rows = facts.filter("n is not null").select("doc_id", "n", "sig")
    total = rows.count()
    hot = (facts.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
           .orderBy(F.desc("seen"), "token").limit(o.common_bound).toPandas())
    often = dict(zip(hot["token"].tolist(), hot["seen"].tolist()))
    chosen = (rows.filter("n > 0 and doc_id is not null").groupBy("doc_id")
              .agg(F.min(F.struct("n", "sig")).alias("s")).select("doc_id", "s.n", "s.sig"))
    classes = store.save(chosen.groupBy("n", "sig").agg(F.min("doc_id").alias("id")), "classes")

    postings, about, common = listed_prefixes(texts, classes, often, store, o)
    needy = about.filter("needy").count()
    if needy > total * o.needy_share:
        long = (postings.filter(F.col("df") > o.crowded).groupBy("token").agg(F.first("df").alias("df"))
                .orderBy(F.desc("df"), "token").limit(o.common_bound).toPandas())
        more = {t: df for t, df in zip(long["token"].tolist(), long["df"].tolist()) if t not in often}
        if more:
            store.drop(postings, about)
            often = dict(sorted((often | more).items(), key=lambda x: (-x[1], x[0]))[: o.common_bound])
            postings, about, common = listed_prefixes(texts, classes, often, store, o)
    own = facts.filter("n > 0").select(F.col("doc_id").alias("id"), "sig", "bits")
    bits = store.save(own.join(about.select("id", "n").join(classes.select("id", "sig"), "id"), ["id", "sig"]).dropDuplicates(["id"]), "bits")

    # Whole sets are made for texts that need them: members of crowded lists, and plausible pairs. A partner of a needy set
    # that is not needy is met in a short list, so needy sets are joined with each other, in an order of their own if that
    # costs little.
    wanted = about.filter("needy").select("id", "n")
    sets = store.save(stored_sets(texts, wanted.select("id").join(bits.select("id", "sig"), "id"), o), "sets")
    own = (wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) <= postings.count() * o.own_share
    if own:
        crowds = own_lists(sets.dropDuplicates(["id"]), o)
    else:
        crowds = postings.filter((F.col("df") > o.crowded) & (F.col("level") == 1)).join(wanted.select("id"), "id").select(
            F.col("token").alias("key"), "id", F.lit(0).cast("long").alias("at"), F.col("n").alias("d"))  # places are not known: 0 excludes nothing
    crowds = store.save(crowds, "crowds")
    links, labels, pairs = through_leaders(crowds, about.select("id", "n", "central"), sets, common, store, o)
    store.drop(crowds, sets)

    # Lists that are not crowded: shared shingles of the prober's prefix, less what crowded lists may add.
    # The larger set probes, or the one that is not needy.
    known = store.save(with_label(about, labels), "about")
    entries = postings.filter(F.col("df") <= o.crowded).drop("n").join(known, "id")
    x, y = (entries.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "level", "component", "l", "crowds", "needy")]) for s in "xy")
    larger = (F.col("n_x") > F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") > F.col("id_y")))
    probes = F.when(F.col("needy_x") == F.col("needy_y"), larger).otherwise(~F.col("needy_x"))
    if own:
        probes = probes & ~(F.col("needy_x") & F.col("needy_y"))
    met = x.join(y, "token").filter(
        probes & (F.col("component_x") != F.col("component_y"))
        & (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * o.percent)
        & (F.col("level_x") <= F.col("l_x")) & (F.col("level_y") <= F.col("l_x")))
    few = met.groupBy("id_x", "id_y").agg(F.count(F.lit(1)).alias("c"), F.first("l_x").alias("l"), F.first("crowds_x").alias("k"))
    few = few.filter(F.col("c") >= F.greatest(F.lit(1), F.col("l") - F.col("k"))).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))
    pairs = few if pairs is None else few.union(pairs).distinct()
    met = store.save(pairs, "pairs")
    store.drop(postings)
    pairs = store.save(plausible(met, bits, o), "plausible")
    store.drop(met)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = store.save(stored_sets(texts, ids.join(bits.select("id", "sig"), "id"), o), "sets")
    found = store.save(verified(pairs, sets, o), "links")
    store.drop(pairs, sets, bits)
    links = found if links is None else links.union(found)
    links = links.distinct()  # a repeated row has its set twice
    joined = store.save(components(links, store), "labels")
    degree = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    by_class = (classes.join(joined.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left")
                .select("n", "sig", F.coalesce("component", "id").alias("component_id"), F.coalesce("k", F.lit(0)).alias("k")))
    by_class = store.save(by_class, "classes")
    by_doc = store.save(chosen.join(by_class, ["n", "sig"]), "members")
    out = rows.select("doc_id", F.col("n").alias("own")).join(by_doc, "doc_id", "left").select(
        "doc_id", F.coalesce("n", "own").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("k", F.lit(0)).alias("n_links_found"))
    out = store.save(out, "result")
    store.keep(out)
    return out


def with_label(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return entries.withColumn("component", F.col("id"))
    return (entries.join(labels.withColumnRenamed("node", "id"), "id", "left")
            .withColumn("component", F.coalesce("component", "id")))
