"""Substring deduplication with an FM-index (not compressed) per shard.

A window is ``window`` consecutive words. Each window selects its minimal word n-gram as anchor, so equal windows of
any documents have equal anchors. Anchors of one document only end here. The windows of an anchor
form a segment; equal segments are kept once, with the smallest document. Segments are dealt to shards by
their anchor, which brings equal windows together without streaming every document through every
shard. A shard builds a suffix array, the BWT in a wavelet matrix and searches backwards through it, all segments abreast: after
each word the interval is widened to the last ``window - 1`` words, so every position has its matching
statistic cut at ``window``, and the interval of a whole window tells the smallest document that holds it.

An anchor with more than ``hot`` different segments (a passage in very many documents, cut differently by its
surroundings) is dealt by whole windows instead, of which only those of two documents go on. A window found in
very many segments is dealt in parts, each beside a copy of the piece of its smallest document. So shards
hold about ``shard_segments`` segments of at most two windows' length each, whatever the input.

Edge cases: null and short texts lose nothing; windows repeated within a document only stay; rows with
one doc_id are one document, each cleaned by its own words; a null doc_id is neither source nor cleaned; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Store, WordHashes, chunks, mixed

BASE, MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1


@dataclass(frozen=True)
class SubstringOptions:
    window: int = 50
    gram: int = 16
    hot: int = 2000
    shard_segments: int = 8000


class Rolling:
    """Hashes of word n-grams of one word sequence, from prefix sums modulo 2^64."""

    def __init__(self, words: np.ndarray, powers: Powers):
        self.powers = powers
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers.up(len(words)), dtype=np.uint64)])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * self.powers.down(n) + np.uint64(k)) if n > 0 else np.zeros(0, np.uint64)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64)
        return mixed((self.sums[end] - self.sums[start]) * self.powers.down(int(start.max(initial=0)) + 1)[start] + size)


class Powers:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self):
        self.tables = {b: np.ones(1, np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))}

    def first(self, base: int, n: int) -> np.ndarray:
        table = self.tables[base]
        while len(table) < n:
            table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
        self.tables[base] = table
        return table[:n]

    def up(self, n: int) -> np.ndarray:
        return self.first(BASE, n)

    def down(self, n: int) -> np.ndarray:
        return self.first(pow(BASE, -1, 1 << 64), n)


class Reader:
    def __init__(self):
        self.hashes, self.powers = WordHashes(), Powers()

    def words(self, text) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []

    def hashed(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))


def window_anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest gram of every ``width`` grams (the first of equals)."""
    at = np.arange(len(grams))
    size = 1
    while size < width:  # minima of runs of `size`, doubled; the last step overlaps
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at = np.where(grams[right] < grams[left], right, left)
        size += step
    return at


def anchor_runs(docs: DataFrame, o: SubstringOptions) -> DataFrame:
    """(a, seg, doc, s, e): windows s..e of a document have anchor ``a``; ``seg`` is the hash of their words."""

    def run(frames):
        reader = Reader()
        for frame in chunks(frames, 500):
            parts = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                words = reader.words(text)
                if len(words) < o.window:
                    continue
                rolling = Rolling(reader.hashed(words), reader.powers)
                grams = rolling.grams(o.gram)
                at = window_anchors(grams, o.window - o.gram + 1)
                s = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
                e = np.append(s[1:], len(at)) - 1
                parts.append((grams[at[s]].view(np.int64), rolling.slices(s, e + o.window).view(np.int64), np.full(len(s), doc), s, e))
            if parts:
                a, seg, doc, s, e = (np.concatenate(c) for c in zip(*parts))
                yield pd.DataFrame({"a": a, "seg": seg, "doc": doc, "s": s.astype(np.int32), "e": e.astype(np.int32)})

    return docs.filter("doc_id is not null").mapInPandas(run, "a long, seg long, doc long, s int, e int")


def whole_windows(docs: DataFrame, o: SubstringOptions) -> DataFrame:
    """(key, seg, doc, s, at): every window of hot segments, its hash as key; ``at`` its number in the segment."""

    def run(frames):
        reader = Reader()
        for frame in chunks(frames, 500):
            parts = []
            for doc, text, segs, ss, es in zip(*(frame[c] for c in ("doc_id", "text", "seg", "s", "e"))):
                words = reader.words(text)
                if len(words) < o.window:
                    continue
                rolling = Rolling(reader.hashed(words), reader.powers)
                held = own(rolling, ss, es, segs, o)
                for seg, s, e in zip(segs[held], ss[held], es[held]):
                    i = np.arange(s, e + 1)
                    parts.append((rolling.slices(i, i + o.window).view(np.int64), np.full(len(i), seg), np.full(len(i), doc), i, i - s))
            if parts:
                key, seg, doc, s, at = (np.concatenate(c) for c in zip(*parts))
                yield pd.DataFrame({"key": key, "seg": seg, "doc": doc, "s": s.astype(np.int32), "at": at.astype(np.int32)})

    return docs.mapInPandas(run, "key long, seg long, doc long, s int, at int")


def own(rolling: Rolling, s: np.ndarray, e: np.ndarray, seg: np.ndarray, o: SubstringOptions) -> np.ndarray:
    """Which runs found in documents of this id lie in this text."""
    end = np.minimum(e + o.window, len(rolling.sums) - 1)
    start = np.minimum(s, end)
    return (rolling.slices(start, end).view(np.int64) == seg) & (end == e + o.window)


def segment_words(docs: DataFrame, o: SubstringOptions) -> DataFrame:
    """(key, seg, at, doc, part, words): the hashed words of segments, six bytes each."""

    def run(frames):
        reader = Reader()
        for frame in chunks(frames, 500):
            rows = []
            for doc, text, keys, segs, ats, ss, es, parts in zip(*(frame[c] for c in ("doc_id", "text", "key", "seg", "at", "s", "e", "part"))):
                words = reader.hashed(reader.words(text))
                if len(words) < o.window:
                    continue
                packed = np.ascontiguousarray((words & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6])
                held = ((ats >= 0) & (es + o.window <= len(words))) | own(Rolling(words, reader.powers), ss, es, segs, o)
                for key, seg, at, s, e, part in zip(*(c[held].tolist() for c in (keys, segs, ats, ss, es, parts))):
                    rows.append((key, seg, at, doc, part, packed[s : e + o.window].tobytes()))
            yield pd.DataFrame(rows, columns=["key", "seg", "at", "doc", "part", "words"]).astype({"key": "int64", "seg": "int64", "at": "int32", "doc": "int64", "part": "int32"})

    return docs.mapInPandas(run, "key long, seg long, at int, doc long, part int, words binary")


class FMIndex:
    """Suffix array order, BWT in a wavelet matrix, and groups of suffixes that agree for a window."""

    def __init__(self, text: np.ndarray, n_ends: int, window: int):
        """``text``: symbols; the ``n_ends`` smallest are ends of segments, each found once."""
        n = len(text)
        rank, size, ranks = text.astype(np.int64), 1, {1: text.astype(np.int64)}
        while True:
            after = np.full(n, -1, np.int64)
            after[:-size] = rank[size:]
            key = rank * (n + 2) + after + 1
            order = np.argsort(key)  # equal keys share a rank
            step = np.concatenate([[0], key[order][1:] != key[order][:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            size *= 2
            ranks[size] = rank
            if size >= window and rank.max() == n - 1:
                break
        self.order = order
        self.group, self.first, self.last = {}, {}, {}
        for length in (window - 1, window):
            half = max(s for s in ranks if s <= length)
            r, shift = ranks[half], length - half
            second = np.full(n, -1, np.int64)
            second[: n - shift] = r[shift:]
            x, y = r[order], second[order]
            cut = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            starts = np.nonzero(cut)[0]
            self.group[length] = np.cumsum(cut) - 1
            self.first[length], self.last[length] = starts, np.append(starts[1:], n)
        bwt = np.maximum(text[order - 1] - n_ends + 1, 0)  # all ends are symbol 0
        self.before = np.concatenate([[0], np.cumsum(np.bincount(np.maximum(text - n_ends + 1, 0)))])
        self.levels, self.zeros = [], []
        for bit in reversed(range(max(int(bwt.max()).bit_length(), 1))):
            b = (bwt >> bit) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(b)]).astype(np.int32))
            self.zeros.append(n - int(b.sum()))
            bwt = np.concatenate([bwt[b == 0], bwt[b == 1]])
        symbols, at = np.unique(bwt, return_index=True)  # the last level holds equal symbols together
        self.symbol_start = np.zeros(int(symbols.max()) + 1, np.int64)
        self.symbol_start[symbols] = at

    def occurrences(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first ``i`` places of the BWT."""
        n_bits = len(self.levels)
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = (symbol >> (n_bits - 1 - level)) & 1
            r = ones[i]
            i = np.where(bit == 1, zeros + r, i - r)
        return i - self.symbol_start[symbol]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        start = self.before[symbol]
        return start + self.occurrences(symbol, lo), start + self.occurrences(symbol, hi)


def smallest_documents(segments: list[np.ndarray], docs: np.ndarray, window: int) -> list[np.ndarray]:
    """For every window of every segment, the smallest document of a segment that holds it."""
    sizes = np.array([len(s) for s in segments])
    flat = np.concatenate(segments)
    _, ids = np.unique(flat, return_inverse=True)
    n_ends = len(segments)
    ends = np.cumsum(sizes + 1) - 1
    text = np.empty(len(flat) + n_ends, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside], text[ends] = ids + n_ends, np.arange(n_ends)
    index = FMIndex(text, n_ends, window)
    owner = np.repeat(docs, sizes + 1)
    least = np.minimum.reduceat(owner[index.order], index.first[window])
    order = np.argsort(-sizes, kind="stable")
    last = ends[order] - 1
    lo, hi = np.zeros(n_ends, np.int64), np.full(n_ends, len(text), np.int64)
    out = [np.empty(0, np.int64)] * n_ends
    found = np.zeros((n_ends, int(sizes.max())), np.int64)
    active = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), side="right")
    for step, n in enumerate(active):  # the word `step` places before the last of every segment long enough
        symbol = text[last[:n] - step] - n_ends + 1
        if step >= window:  # widen to the window less its last word
            g = index.group[window - 1][lo[:n]]
            lo[:n], hi[:n] = index.first[window - 1][g], index.last[window - 1][g]
        lo[:n], hi[:n] = index.extend(symbol, lo[:n], hi[:n])
        if step >= window - 1:
            found[:n, step] = least[index.group[window][lo[:n]]]
    for place, k in enumerate(order):
        out[k] = found[place, window - 1 : sizes[k]][::-1]
    return out


def search_shard(o: SubstringOptions):
    def run(key, frame):
        frame = frame.drop_duplicates(["seg", "at"])
        segments = [words48(w) for w in frame["words"]]
        docs = frame["doc"].to_numpy()
        masks = []
        for least, doc, at in zip(smallest_documents(segments, docs, o.window), docs, frame["at"]):
            bits = np.nonzero(least < doc)[0]
            shift = bits + max(int(at), 0)
            masks.append(int(np.bitwise_or.reduce(np.left_shift(np.uint64(1), shift.astype(np.uint64)), initial=np.uint64(0)).view(np.int64)))
        return pd.DataFrame({"seg": frame["seg"], "mask": masks})

    return run


def words48(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def cut_repeats(docs: DataFrame, options: SubstringOptions | None = None) -> DataFrame:
    """Per row: doc_id, text (the kept words, one blank between), n_words, n_removed, spans removed [start, end)."""
    o, store = options or SubstringOptions(), Store(docs.sparkSession, "substrings")
    if o.window - o.gram + 1 > 63:
        raise ValueError("a segment has at most 63 windows")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = store.save(anchor_runs(docs, o), "runs")
    whole = runs.groupBy("a", "seg").agg(F.min(F.struct("doc", "s", "e")).alias("m"), F.max("doc").alias("hi"))
    whole = store.save(whole.select("a", "seg", "m.doc", "m.s", "m.e", "hi"), "segments")
    about = whole.groupBy("a").agg(F.min("doc").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("segments")).filter("lo < hi")
    about = store.save(about.select("a", "segments"), "anchors")
    known = store.save(whole.join(about, "a").select("a", "seg", "doc", "s", "e", "segments"), "known")
    cold = known.filter(F.col("segments") <= o.hot).select(F.col("a").alias("key"), "seg", "doc", "s", "e", F.lit(-1).alias("at"), F.lit(0).alias("part"))
    hot = known.filter(F.col("segments") > o.hot)
    if not hot.isEmpty():
        lists = hot.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("seg", "s", "e")).alias("r")).select("doc_id", "r.seg", "r.s", "r.e")
        pieces = store.save(whole_windows(docs.join(lists.hint("merge"), "doc_id"), o), "windows")
        piece = F.struct("doc", "seg", "at")
        twice = pieces.groupBy("key").agg(F.min(piece).alias("least"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n")).filter("least.doc < hi")
        twice = store.save(twice.select("key", "least", F.ceil(F.col("n") / max(1, o.shard_segments // 8)).cast("int").alias("parts")), "windows")
        # The smallest document's piece goes to every part of its window: a negative part is the number of copies.
        part = F.when(piece == F.col("least"), -F.col("parts")).otherwise(F.pmod(F.xxhash64("seg", "at"), "parts")).cast("int")
        cold = cold.unionByName(pieces.join(twice, "key").select("key", "seg", "doc", "s", F.col("s").alias("e"), "at", part.alias("part")))
    lists = cold.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("key", "seg", "at", "s", "e", "part")).alias("r"))
    lists = store.save(lists.select("doc_id", "r.key", "r.seg", "r.at", "r.s", "r.e", "r.part"), "lists")
    n = lists.agg(F.coalesce(F.sum(F.size("seg")), F.lit(0))).first()[0]
    shards = max(1, -(-n // o.shard_segments))
    contents = segment_words(docs.join(lists.hint("merge"), "doc_id"), o)
    copies = F.when(F.col("part") < 0, F.sequence(F.lit(0), -F.col("part") - 1)).otherwise(F.array("part"))
    contents = contents.withColumn("part", F.explode(copies))
    masks = contents.groupBy(F.pmod(F.xxhash64("key", "part"), F.lit(shards)).alias("shard")).applyInPandas(search_shard(o), "seg long, mask long")
    masks = store.save(masks.groupBy("seg").agg(F.bit_or("mask").alias("mask")), "masks")
    least = known.select("a", "seg", F.col("doc").alias("least")).join(masks, "seg", "left").select("a", "seg", "least", F.coalesce("mask", F.lit(0)).alias("mask"))
    least = store.save(least, "least")
    hit = runs.join(least, ["a", "seg"]).withColumn("mask", F.when(F.col("doc") > F.col("least"), F.lit(-1)).otherwise(F.col("mask")))
    gone = hit.filter("mask <> 0").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("seg", "s", "e", "mask")).alias("r"))
    gone = store.save(gone.select("doc_id", "r.seg", "r.s", "r.e", "r.mask"), "gone")
    store.keep(gone)

    def run(frames):
        reader = Reader()
        for frame in chunks(frames, 500):
            kept, sizes, removed, spans = [], [], [], []
            for text, segs, ss, es, masks in zip(*(frame[c] for c in ("text", "seg", "s", "e", "mask"))):
                words = reader.words(text)
                sizes.append(len(words))
                held = own(Rolling(reader.hashed(words), reader.powers), ss, es, segs, o) if segs is not None and len(words) >= o.window else ()
                if not np.any(held):
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                    removed.append(0)
                    spans.append([])
                    continue
                ss, es, masks = ss[held], es[held], masks[held]
                bits = np.arange(64)
                i = (ss[:, None] + bits)[((masks[:, None] >> bits) & 1 == 1) & (bits <= (es - ss)[:, None])]
                edge = np.bincount(i, minlength=len(words) + 1) - np.bincount(i + o.window, minlength=len(words) + 1)
                out = np.cumsum(edge)[:-1] > 0
                change = np.nonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))[0].reshape(-1, 2)
                kept.append(b" ".join(compress(words, (~out).tolist())).decode("utf-8", "surrogatepass"))
                removed.append(int(out.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in change])
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(dtype=object), "text": kept, "n_words": sizes, "n_removed": removed, "spans": spans})

    # Ids go as text: pandas would make floats of numbers with nulls among them.
    met = docs.join(gone.hint("merge"), "doc_id", "left").withColumn("doc_id", F.col("doc_id").cast("string"))
    out = met.mapInPandas(run, "doc_id string, text string, n_words long, n_removed long, spans array<struct<start:int,end:int>>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
