"""SentencePiece encoding and decoding by a weighted transducer.

The model is compiled to three transducers: the normaliser (a blank before a text, blanks as the
word mark), the pieces, and the byte fallback for characters without a piece. The pieces of a BPE
model carry no usable path weights, so the piece transducer remembers its last piece: an arc to the next
costs 0 if the pair stays apart when its letters are merged by the model, and one otherwise. A merge
sequence keeps exactly those neighbours apart that it keeps apart on their own, so the path of weight 0 in the tropical
semiring is the model's own encoding. Every beginning of a word has exactly one such path, the encoding of that beginning,
so one arc a place stands for all states (place, last piece); a place without an arc of weight 0 would send the word to the search over states.

A text is composed word mark by word mark: no piece goes on past the next one, so shortest paths join there, and
the paths of words seen before are remembered. The model file is read on the executors; its path is a parameter.

Edge cases: null and empty texts have no pieces and decode to the empty text; a literal word mark
decodes to a blank; any other text decodes to itself; repeated rows and null ids are encoded each; extra columns are
kept, those that clash with the names added are replaced; an empty table gives no rows; the time for a word is linear in its length.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import free_name

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NO_PIECE = -1
REMEMBERED = 64  # letters of the longest word that is remembered
BEGINNING = 6  # letters of the longest beginning that is remembered


class PieceTransducer:
    """The compiled model. ``bound`` limits the words and pairs remembered."""

    def __init__(self, path: str = MODEL, bound: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bound, size = bound, model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.names, pieces = names, {names[i]: i for i in usable}
        self.endings = {p[k:]: pieces.get(p[k:], NO_PIECE) for p in pieces for k in range(len(p))}
        self.merge_score = {names[i]: model.get_score(i) for i in usable}
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.surface = {i: names[i].replace(MARK, " ").encode() for i in usable}
        self.surface |= {i: bytes([b]) for b, i in self.bytes.items()}
        self.letters = [self.surface.get(i, b"") for i in range(size)]
        self.paths: dict[str, tuple[int, ...]] = {}
        self.beginnings: dict[str, tuple[tuple[int, int], ...]] = {"": ((0, NO_PIECE),)}  # last arc (begin, piece) to every place
        self.apart: dict[int, bool] = {}

    def merged(self, letters: str) -> list[str]:
        """Pieces of a short string by merging the best-scored neighbours, the leftmost of equals first."""
        parts = list(letters)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.merge_score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays_apart(self, before: int, piece: int) -> bool:
        """Whether ``piece`` can follow ``before`` (NO_PIECE: the start or a character without a piece) at no cost."""
        first = [] if before == NO_PIECE else [self.names[before]]
        if len(self.apart) > 2 * self.bound:
            self.apart.clear()
        out = self.merged("".join(first) + self.names[piece]) == [*first, self.names[piece]]
        self.apart[before * len(self.names) + piece] = out
        return out

    def shortest(self, word: str) -> tuple[int, ...]:
        """Ids on the shortest path through the composition of a word with the transducers.

        No weight is below 0, so a place reached at cost 0 needs no further arcs. The last arcs to such places depend on
        the letters before only; those of short beginnings are remembered for all words that begin alike.
        """
        n, size, apart, endings, beginnings = len(word), len(self.names), self.apart, self.endings, self.beginnings
        known = min(n, BEGINNING)
        while word[:known] not in beginnings:
            known -= 1
        back = list(beginnings[word[:known]])
        for j in range(known + 1, n + 1):
            i = j - 1
            piece = endings.get(word[i], NO_PIECE)
            if piece == NO_PIECE:  # byte fallback
                back.append((i, NO_PIECE))
                continue
            while True:
                if piece != NO_PIECE:
                    before = back[i][1]
                    key = before * size + piece
                    if apart[key] if key in apart else self.stays_apart(before, piece):
                        back.append((i, piece))
                        break
                i -= 1
                piece = endings.get(word[i:j]) if i >= 0 else None
                if piece is None:  # no piece that begins before ends here
                    return self.shortest_of_states(word)
        if len(beginnings) > self.bound:
            beginnings.clear()
            beginnings[""] = ((0, NO_PIECE),)
            known = 0  # all beginnings of a remembered one are remembered
        for j in range(known + 1, min(n, BEGINNING) + 1):
            beginnings[word[:j]] = tuple(back[: j + 1])
        path, j = [], n
        while j:
            i, piece = back[j]
            path.append((i, j, piece))
            j = i
        return self.ids(word, path)

    def shortest_of_states(self, word: str) -> tuple[int, ...]:
        """The same with a cost for every state (place, last piece), whatever the weights."""
        states: list[dict[int, tuple[int, int, int]]] = [{NO_PIECE: (0, 0, NO_PIECE)}]  # last piece: cost, begin, piece before
        for j in range(1, len(word) + 1):
            here: dict[int, tuple[int, int, int]] = {}
            if self.endings.get(word[j - 1], NO_PIECE) == NO_PIECE:
                here[NO_PIECE] = min((c, j - 1, before) for before, (c, _, _) in states[j - 1].items())
            else:
                i = j - 1
                while i >= 0 and (piece := self.endings.get(word[i:j])) is not None:
                    if piece != NO_PIECE:
                        arcs = [(c + (not self.stays_apart(before, piece)), i, before) for before, (c, _, _) in states[i].items()]
                        here[piece] = min(arcs)
                    i -= 1
            states.append(here)
        path, j = [], len(word)
        last = min(states[j], key=lambda piece: states[j][piece])
        while j:
            _, i, before = states[j][last]
            path.append((i, j, last))
            j, last = i, before
        return self.ids(word, path)

    def ids(self, word: str, path: list[tuple[int, int, int]]) -> tuple[int, ...]:
        """Ids of a path of arcs (begin, end, piece), the last first."""
        out: list[int] = []
        for i, j, piece in path:
            if piece != NO_PIECE:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes.get(b, self.unknown) for b in reversed(word[i:j].encode())]
            else:
                out.append(self.unknown)
        out.reverse()
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words, paths = CHUNK.findall((" " + text).replace(" ", MARK)), self.paths
        try:
            return list(chain.from_iterable(map(paths.__getitem__, words)))
        except KeyError:
            out = []
            for w in words:
                ids = paths.get(w)
                if ids is None:
                    ids = self.shortest(w)
                    if len(w) <= REMEMBERED:
                        if len(paths) >= self.bound:
                            paths.clear()
                        paths[w] = ids
                out += ids
            return out

    def decode(self, ids: Iterable[int]) -> str:
        try:
            text = b"".join(map(self.letters.__getitem__, ids))
        except (IndexError, TypeError):  # ids of no piece
            text = b"".join(self.surface.get(i, b"") for i in ids)
        return text.decode("utf-8", "replace").removeprefix(" ")


_compiled: dict[str, PieceTransducer] = {}


def compiled(path: str) -> PieceTransducer:
    """One transducer per Python worker and model."""
    if path not in _compiled:
        _compiled[path] = PieceTransducer(path)
    return _compiled[path]


def encode_pieces(docs: DataFrame, path: str = MODEL, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` without its text, with pieces, n_pieces, and round_trip: whether they decode to the text."""
    kept = [c for c in docs.columns if c not in ("pieces", "n_pieces", "round_trip") and (keep_text or c != text)]
    own = free_name(docs, "_text")
    docs = docs.select(*kept, F.col(text).cast("string").alias(own))
    schema = T.StructType([docs.schema[c] for c in kept]).add("pieces", T.ArrayType(T.IntegerType())).add("n_pieces", T.LongType()).add("round_trip", T.BooleanType())

    def run(batches):
        t = compiled(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids, ends, same = array("i"), [0], []
                for s in batch.column(own).to_pylist():
                    found = t.encode(s)
                    ids.extend(found)
                    ends.append(len(ids))
                    same.append(t.decode(found) == (s or "").replace(MARK, " "))
                sizes = np.diff(ends)
                pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
                columns = [batch.column(c) for c in kept] + [pieces, pa.array(sizes.astype(np.int64)), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "pieces", "n_pieces", "round_trip"])

    return docs.mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, path: str = MODEL, pieces: str = "pieces") -> DataFrame:
    """``encoded`` with its pieces decoded to ``text`` (a null list is the empty text)."""
    kept = [c for c in encoded.columns if c != "text"]
    schema = T.StructType([encoded.schema[c] for c in kept]).add("text", T.StringType())

    def run(batches):
        t = compiled(path)
        for batch in batches:
            texts = [t.decode(ids or []) for ids in batch.column(pieces).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, "text"])

    return encoded.select(*kept).mapInArrow(run, schema)
