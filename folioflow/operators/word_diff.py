"""Shortest differences between token sequences, by bit-parallel longest common subsequences.

One integer holds a row of the alignment table: its bit j is clear where the longest common subsequence grows with token j
of the right side. A row follows from the one before it by an addition and a few logical operations, whatever its length.
Small tables keep all their rows and are read back from the end; larger ones are cut in half at the column where
the best left and right parts meet, so space stays linear in the two lengths.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np

TOKEN = re.compile(r"\s+|\S+")
#: Cells of a table whose rows are kept, a bit each.
KEPT_CELLS = 1 << 26


def _places(right: Iterable) -> dict:
    places: dict = {}
    for j, token in enumerate(right):
        places[token] = places.get(token, 0) | 1 << j
    return places


def _rows(left: Iterable, right: Sequence):
    """The rows of the table after each token of ``left``, the first before any."""
    places, full = _places(right), (1 << len(right)) - 1
    row = full
    yield row
    for token in left:
        met = row & places.get(token, 0)
        row = (row + met | row - met) & full
        yield row


def common_length(left: Sequence, right: Sequence) -> int:
    """Length of the longest common subsequence."""
    row = 0
    for row in _rows(left, right):
        pass
    return len(right) - row.bit_count()


def _grown(left: Iterable, right: Sequence) -> np.ndarray:
    """Longest common subsequence of ``left`` with every head of ``right``."""
    for row in _rows(left, right):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(right) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(right)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def matches(left: Sequence, right: Sequence) -> list[tuple[int, int]]:
    """Positions (left, right) of a longest common subsequence, rising."""
    found, open_ = [], [(0, len(left), 0, len(right))]
    while open_:
        i0, i1, j0, j1 = open_.pop()
        if i0 == i1 or j0 == j1:
            continue
        a, b = left[i0:i1], right[j0:j1]
        if len(a) > 1 and len(a) * len(b) > KEPT_CELLS:
            half = len(a) // 2
            cut = int(np.argmax(_grown(a[:half], b) + _grown(a[half:][::-1], b[::-1])[::-1]))
            open_ += [(i0 + half, i1, j0 + cut, j1), (i0, i0 + half, j0, j0 + cut)]
            continue
        rows, i, j, here = list(_rows(a, b)), len(a), len(b), []
        while i and j:
            grows = 1 << (j - 1)
            if rows[i] & grows:
                j -= 1
            elif rows[i - 1] & grows:
                i, j = i - 1, j - 1
                here.append((i0 + i, j0 + j))
            else:
                i -= 1
        found += here[::-1]
    return found


def difference(left: list[str], right: list[str], limit: int | None = None) -> list[tuple[str, list[str]]]:
    """Operations ("=", "-", "+") that turn ``left`` into ``right`` with the fewest tokens deleted and inserted.

    Between equal stretches the deleted tokens stand before the inserted ones. With ``limit``, differing middles of more
    than twice that many tokens, or needing more deletions and insertions, are one replacement.
    """
    numbers: dict = {}
    a, b = ([numbers.setdefault(t, len(numbers)) for t in side] for side in (left, right))
    head, least = 0, min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    size = len(mid_a) + len(mid_b)
    inner = matches(mid_a, mid_b) if limit is None or size <= 2 * limit else []
    if limit is not None and size - 2 * len(inner) > limit:
        inner = []
    ops: list[tuple[str, list[str]]] = []

    def put(op: str, tokens: list[str]) -> None:
        if tokens and ops and ops[-1][0] == op:
            ops[-1][1].extend(tokens)
        elif tokens:
            ops.append((op, list(tokens)))

    put("=", left[:head])
    i = j = head
    for x, y in [*((head + x, head + y) for x, y in inner), (len(a) - tail, len(b) - tail)]:
        put("-", left[i:x])
        put("+", right[j:y])
        if x < len(a) - tail:
            put("=", left[x : x + 1])
        i, j = x + 1, y + 1
    put("=", left[len(a) - tail :])
    return ops
