"""Language identification of mixed-language texts.

The script of a word (from the character database) narrows the languages it can belong to. Each word
has a score per language from letter n-grams and whole words; Viterbi over the words, with a penalty for switching,
labels spans. A document's language is the one whose spans hold most letters, its score their share.

The models are counts over at most ``train_rows`` documents with a language, those with the smallest
hash of the id outside the held-out fold.

Edge cases: null texts and texts without a letter are ``und`` with score 0; ties go to the
alphabetically first language; without any training row everything is ``und``; repeated doc_ids give
one row each; a null doc_id is not held out and never learned from; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Store, chunks, crc_mod

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageOptions:
    train_rows: int = 4000
    most_features: int = 200_000
    grams: tuple[int, ...] = (1, 2, 3, 4)
    switch: float = 12.0
    word_bound: float = 8.0
    script_share: float = 0.01
    folds: int = 4
    held_out: int = 2


def script(word: str) -> str:
    """The script of the first letter, as its character name begins."""
    return unicodedata.name(word[0], "?").split()[0].split("-")[0]


def parts(word: str, o: LanguageOptions) -> list[str]:
    """Letter n-grams of the word between blanks, and the word itself. No letter is ``=`` or ``#``."""
    w = f" {word} "
    return [w[i : i + n] for n in o.grams for i in range(len(w) - n + 1)] + ["=" + word]


class Model:
    """Log probabilities of features per language."""

    def __init__(self, languages: list[str], counts: dict[str, np.ndarray], o: LanguageOptions):
        self.languages, self.o = languages, o
        k = len(languages)
        scripts = {p[1:]: c for p, c in counts.items() if p[0] == "#"}
        seen = sum(scripts.values(), np.zeros(k))
        self.allowed = {s: c >= o.script_share * np.maximum(seen, 1) for s, c in scripts.items()}
        kinds: dict[int, np.ndarray] = {}
        for p, c in counts.items():
            if p[0] != "#":
                kinds[self.kind(p)] = kinds.get(self.kind(p), np.zeros(k)) + c
        names = [p for p in counts if p[0] != "#"]
        logs = np.array([np.log((counts[p] + 0.5) / (kinds[self.kind(p)] + 1)) for p in names]).reshape(-1, k)
        self.row = {p: i + 1 for i, p in enumerate(names)}
        self.logs = np.vstack([np.zeros(k), logs - logs.mean(axis=1, keepdims=True)])

    @staticmethod
    def kind(p: str) -> int:
        return 0 if p[0] == "=" else len(p)

    def scores(self, words: list[str]) -> np.ndarray:
        """Centred log odds of words, bounded, with the languages of other scripts ruled out."""
        rows, starts = [], []
        for word in words:
            starts.append(len(rows))
            rows.extend(self.row.get(p, 0) for p in parts(word, self.o))
        total = np.add.reduceat(self.logs[rows], starts, axis=0)
        total = np.maximum(total - total.max(axis=1, keepdims=True), -self.o.word_bound)
        every = np.ones(len(self.languages), bool)
        allowed = np.array([self.allowed.get(script(w), every) for w in words])
        allowed |= ~allowed.any(axis=1, keepdims=True)
        return np.where(allowed, total, -2 * self.o.word_bound)


class WordScores:
    """Scores of words seen before; forgets all when it holds ``bound`` words."""

    def __init__(self, model: Model, bound: int = 300_000):
        self.model, self.bound = model, bound
        self.at, self.table = {}, np.zeros((0, len(model.languages)))

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.at) > self.bound:
            self.at, self.table = {}, self.table[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if new:
            self.at.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.vstack([self.table, self.model.scores(new)])
        return self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word; documents advance together, the longest first.

    All switches cost the same, so a word keeps its language or comes from the best of the word before.
    """
    labels = np.zeros(len(scores), np.int16)
    stay = np.ones(scores.shape, bool)
    best_before = np.zeros(len(scores), np.int16)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes.max(initial=0) + 1), side="right")
    v = np.zeros((len(starts), scores.shape[1]))
    for t, n in enumerate(active):
        at = starts[:n] + t
        if t:
            top = v[:n].argmax(axis=1)
            leap = v[np.arange(n), top][:, None] - switch
            stay[at] = v[:n] >= leap
            best_before[at] = top
            v[:n] = np.maximum(v[:n], leap)
        v[:n] += scores[at]
        v[:n] -= v[:n].max(axis=1, keepdims=True)
        done = np.nonzero(sizes[:n] == t + 1)[0]
        labels[at[done]] = v[done].argmax(axis=1)
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        here = labels[at]
        labels[at - 1] = np.where(stay[at, here], here, best_before[at])
    return labels


def learn(docs: DataFrame, store: Store, o: LanguageOptions) -> Model | None:
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", o.folds) != o.held_out))
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(o.train_rows)
    rows = usable.join(F.broadcast(chosen), "doc_id").select("text", "lang").filter("text is not null")

    def run(frames):
        seen: dict[str, Counter] = {}
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"]):
                counts = seen.setdefault(lang, Counter())
                for w, n in Counter(WORD.findall(text.lower())).items():
                    for p in parts(w, o):
                        counts[p] += n
                    counts["#" + script(w)] += n
        for lang, counts in seen.items():
            yield pd.DataFrame({"part": list(counts.keys()), "lang": lang, "n": list(counts.values())})

    sums = store.save(rows.mapInPandas(run, "part string, lang string, n long").groupBy("part", "lang").agg(F.sum("n").alias("n")), "counts")
    kept = sums.orderBy(F.expr("case when part like '#%' then 0 else 1 end"), F.desc("n"), "part", "lang").limit(o.most_features).collect()
    store.keep()
    if not kept:
        return None
    languages = sorted({r["lang"] for r in kept})
    counts: dict[str, np.ndarray] = {}
    for r in kept:
        counts.setdefault(r["part"], np.zeros(len(languages)))[languages.index(r["lang"])] = r["n"]
    return Model(languages, counts, o)


def identify(docs: DataFrame, options: LanguageOptions | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, spans (lang, first word, words, letters)."""
    o, store = options or LanguageOptions(), Store(docs.sparkSession, "language")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    model = learn(docs, store, o)
    schema = "doc_id string, lang_pred string, score double, spans array<struct<lang:string,first:int,words:int,letters:int>>"

    def run(frames):
        known = WordScores(model) if model else None
        for frame in chunks(frames, 2000):
            texts = [WORD.findall(t.lower()) if isinstance(t, str) and model else [] for t in frame["text"]]
            sizes = np.array([len(w) for w in texts], dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
            flat = [w for words in texts for w in words]
            letters = np.fromiter(map(len, flat), np.int64, len(flat))
            k = len(model.languages) if model else 1
            labels = np.zeros(0, np.int16)
            if flat:
                labels = viterbi(known(flat), starts, sizes, o.switch)
            doc = np.repeat(np.arange(len(texts)), sizes)
            share = np.bincount(doc * k + labels, weights=letters, minlength=len(texts) * k).reshape(len(texts), k)
            total = share.sum(axis=1)
            cut = np.nonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])]))[0] if flat else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(flat))
            sums = np.concatenate([[0], np.cumsum(letters)])
            spans: list[list[dict]] = [[] for _ in texts]
            for a, b in zip(cut, ends):
                spans[doc[a]].append({"lang": model.languages[labels[a]], "first": int(a - starts[doc[a]]), "words": int(b - a), "letters": int(sums[b] - sums[a])})
            best = share.argmax(axis=1)
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].to_numpy(dtype=object), "lang_pred": [model.languages[b] if n else UNKNOWN for b, n in zip(best, total)],
                "score": np.where(total > 0, share[np.arange(len(texts)), best] / np.maximum(total, 1), 0.0), "spans": spans})

    # Ids go as text: pandas would make floats of numbers with nulls among them.
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", F.coalesce(crc_mod("doc_id", o.folds) == o.held_out, F.lit(False)))
