"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reported speech, clause end or other. Five small
weighted transducers read the symbols of a clause: the insult and the threat transducer mark hits, the
target transducer remembers for a few words that a person was addressed, the negation transducer that
a negator was read, the reported-speech transducer that the clause quotes somebody. Their composition
is one deterministic transducer, built once; its arcs carry which of the patterns fired, with the weights learned
for them. A document is scored by its matched clauses, not by isolated words.

Word lists of targets, negators, reporters and threats are general. Insults are learned: word
beginnings that labelled toxic documents have and others lack. The weights of the patterns are a
logistic regression on the same rows. Both are fitted on at most ``train_rows`` labelled rows, those with the smallest
hash of the id; rows of the held-out fold are never among them.

Edge cases: a null or empty text has the score of no match; a repeated doc_id gives one row for each
of its rows; a null doc_id is not held out and never learned from; null labels are skipped; without
any usable label the grammar has no insults and threats decide; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import Store, crc_mod

TARGETS = frozenset("you your yours he she they them him her his their people du dich dir sie ihr euch er ihn tu toi te vous il elle ils lui tú ti usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never none isn't don't nicht kein keine nie niemals pas ne jamais aucun nunca ni jamás tampoco".split())
REPORTS = frozenset("said says say wrote called calls quoted claimed reported sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())
THREATS = frozenset("kill destroy hurt shoot stab strangle töten umbringen schlagen tuer frapper matar golpear".split())
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
#: What an arc can report: a plain insult or threat, and either with a target, negated or reported.
PATTERNS = ("insult", "insult_target", "insult_negated", "insult_reported", "threat", "threat_target", "threat_negated", "threat_reported")


@dataclass(frozen=True)
class ToxicityOptions:
    train_rows: int = 8000
    beginnings: tuple[int, ...] = (4, 5, 6, 7, 8, 9)
    evidence: float = 18.0
    most_insults: int = 4000
    memory: int = 3
    folds: int = 5
    held_out: int = 0


class Transducer:
    """A deterministic weighted transducer: (state, symbol) -> (state, output)."""

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def compose(self, other: Transducer, join) -> Transducer:
        """Both read the same symbols; ``join`` combines what they put out on an arc."""
        states, todo, arcs = set(), [(self.start, other.start)], {}
        while todo:
            s = todo.pop()
            if s in states:
                continue
            states.add(s)
            for symbol in range(7):
                (a, x), (b, y) = self.arcs[s[0], symbol], other.arcs[s[1], symbol]
                arcs[s, symbol] = ((a, b), join(x, y))
                todo.append((a, b))
        return Transducer(arcs, (self.start, other.start))


def marker(symbol: int, name: str) -> Transducer:
    return Transducer({(0, s): (0, (name,) if s == symbol else ()) for s in range(7)})


def memory(trigger: int, name: str, steps: int | None) -> Transducer:
    """After ``trigger``, marks every arc for ``steps`` words (None: to the end of the clause)."""
    arcs, last = {}, steps or 1
    for state, s in product(range(last + 1), range(7)):
        after = last if s == trigger else 0 if s == END else state if steps is None else max(state - 1, 0)
        arcs[state, s] = (after, (name,) if state and s != END else ())
    return Transducer(arcs)


def grammar(o: ToxicityOptions) -> Transducer:
    def both(x, y):
        return x + y

    out = marker(INSULT, "insult").compose(marker(THREAT, "threat"), both)
    for part in (memory(TARGET, "target", o.memory), memory(NEGATION, "negated", o.memory), memory(REPORT, "reported", None)):
        out = out.compose(part, both)
    arcs = {}
    for at, (to, fired) in out.arcs.items():
        kind = next((k for k in ("insult", "threat") if k in fired), None)
        names = [] if kind is None else [kind, *(f"{kind}_{m}" for m in ("target", "negated", "reported") if m in fired)]
        arcs[at] = (to, tuple(PATTERNS.index(n) for n in names))
    return Transducer(arcs, out.start)


class Symbols(dict):
    """Remembers the symbol of each word; forgets all when it holds ``bound`` words."""

    def __init__(self, insults: frozenset, lengths: tuple[int, ...], bound: int = 300_000):
        super().__init__()
        self.insults, self.lengths, self.bound = insults, lengths, bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        if word in ".!?;\n":
            out = END
        elif any(word[:k] in self.insults for k in self.lengths if k <= len(word)):
            out = INSULT
        else:
            out = next((s for s, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) if word in words), OTHER)
        self[word] = out
        return out


def clause_features(text: str | None, symbols: Symbols, machine: Transducer) -> list[float]:
    """Patterns fired (log of one plus their count), matched clauses, the most hits in one clause, hits per word."""
    read = list(map(symbols.__getitem__, TOKEN.findall(text.lower()))) if text else []
    if INSULT not in read and THREAT not in read:
        return [0.0] * (len(PATTERNS) + 3)
    counts, clauses, here, most, hits = [0] * len(PATTERNS), 0, 0, 0, 0
    state, arcs = machine.start, machine.arcs
    for s in read:
        state, fired = arcs[state, s]
        for f in fired:
            counts[f] += 1
        if s == INSULT or s == THREAT:
            clauses += here == 0
            here += 1
            hits += 1
            most = max(most, here)
        elif s == END:
            here = 0
    return [float(np.log1p(c)) for c in counts] + [float(np.log1p(clauses)), float(np.log1p(most)), 10 * hits / len(read)]


def training_rows(docs: DataFrame, labels: DataFrame, o: ToxicityOptions) -> DataFrame:
    """(text, toxic) of at most ``train_rows`` labelled documents outside the held-out fold."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", o.folds) != o.held_out))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(o.train_rows)
    return docs.join(F.broadcast(chosen), "doc_id").filter("text is not null").select("text", "toxic")


def learn_insults(rows: DataFrame, o: ToxicityOptions) -> frozenset:
    """Word beginnings of toxic documents that others lack.

    A toxic document counts for a part only if no other has it after the same word: copies of a
    document repeat the surroundings of all its words, a used insult stands in ever new ones.
    """

    def run(frames):
        toxic_parts, held, clean = set(), Counter(), Counter()
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"]):
                words, found = TOKEN.findall(text.lower()), {}
                for before, w in zip([""] + words, words):
                    if len(w) >= min(o.beginnings):
                        for k in o.beginnings:
                            if k <= len(w):
                                found.setdefault(w[:k], before)
                if toxic:
                    toxic_parts.update(found.items())
                (held if toxic else clean).update(found.keys())
        yield pd.DataFrame({"part": [p for p, _ in toxic_parts], "before": [b for _, b in toxic_parts], "docs": 0, "neg": 0}).astype({"part": "str", "before": "str"})
        for counts, column, other in ((held, "docs", "neg"), (clean, "neg", "docs")):
            yield pd.DataFrame({"part": list(counts), "before": None, column: list(counts.values()), other: 0}).astype({"part": "str", column: "int64"})

    sums = (rows.mapInPandas(run, "part string, before string, docs long, neg long")
            .groupBy("part", "before").agg(F.sum("docs").alias("docs"), F.sum("neg").alias("neg"))
            .groupBy("part").agg(F.count("before").alias("pos"), F.sum("docs").alias("docs"), F.sum("neg").alias("neg")))
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    # Log likelihood ratio of the rows with the part against all rows: far above chance for any number of parts.
    n, pos, neg = F.col("pos") + F.col("neg"), F.col("pos"), F.col("neg")
    ratio = pos * F.log(pos / (n * base)) + F.when(neg > 0, neg * F.log(neg / (n * (1 - base)))).otherwise(0.0)
    keen = sums.filter((pos >= 5) & (pos >= 3 * neg)).withColumn("r", ratio).filter(F.col("r") >= o.evidence)
    count = {r["part"]: r["docs"] for r in keen.orderBy(F.desc("r"), "part").limit(o.most_insults).collect()}
    # Of a beginning and its continuation that covers nearly the same rows, the longer one; then none inside another.
    covered = {p[:k] for p, c in count.items() for k in range(1, len(p)) if c >= 0.95 * count.get(p[:k], 1 << 60)}
    kept: set[str] = set()
    for p in sorted(set(count) - covered, key=len):
        if not any(p[:k] in kept for k in range(1, len(p))):
            kept.add(p)
    return frozenset(kept)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, options: ToxicityOptions | None = None) -> DataFrame:
    """``docs`` with score, predicted, held_out and matches (patterns fired); clashing names are replaced."""
    o, store = options or ToxicityOptions(), Store(docs.sparkSession, "toxicity")
    docs = docs.drop("score", "predicted", "held_out", "matches").withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    rows = store.save(training_rows(docs.select("doc_id", "text"), labels, o), "training")
    insults, machine = learn_insults(rows, o), grammar(o)
    width = len(PATTERNS) + 3

    def features(frames):
        symbols = Symbols(insults, o.beginnings)
        for frame in frames:
            yield pd.DataFrame({"f": [clause_features(t, symbols, machine) for t in frame["text"]], "toxic": frame["toxic"]})

    fitted = rows.mapInPandas(features, "f array<double>, toxic int").collect()  # at most train_rows short rows
    store.keep()
    x, y = np.array([r["f"] for r in fitted]).reshape(-1, width), np.array([r["toxic"] for r in fitted], dtype=float)
    w = fit_logistic(x, y) if len(fitted) else np.array([1.0] * width + [-3.0])

    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL("score double, matches array<int>").fields)

    def run(batches):
        symbols = Symbols(insults, o.beginnings)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                f = np.array([clause_features(t, symbols, machine) for t in batch.column("text").to_pylist()]).reshape(-1, width)
                p = 1 / (1 + np.exp(-np.clip(f @ w[:-1] + w[-1], -30, 30)))
                fired = np.rint(np.expm1(f[:, : len(PATTERNS)])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(list(fired), pa.list_(pa.int32()))], names=[*batch.schema.names, "score", "matches"])

    out = docs.mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn(
        "held_out", F.coalesce(crc_mod("doc_id", o.folds) == o.held_out, F.lit(False)))
