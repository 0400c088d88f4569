"""Maximal periodic runs of words, by the runs theorem.

Every run (a stretch with smallest period p, at least 2p long, that can't be extended) holds a Lyndon root:
the longest Lyndon word that begins at one of its places, in the natural order of words or in the reversed one. The longest
Lyndon word at place i ends where the first smaller suffix begins: at the next smaller value of the inverse suffix
array, and at the next larger one for the reversed order. So 2n roots are all there is to try. A root is
extended to the right by the longest common prefix of the suffixes at its two ends, a range minimum of the LCP array
that a sparse table answers, and to the left in the same way in the reversed text.

A run of length >= max(24, 3p) repeats 8 words at distance p behind the first root in it. Suffixes are sorted by doubling,
so whether 8 words recur is known after three rounds: texts in which none do are done then, and roots that don't are never extended.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, slices, text_or_empty

#: What counts as a run: its length in words and in periods.
MIN_LENGTH, MIN_PERIODS = 24, 3
#: Words that recur at a distance of one period behind the first root of such a run.
RECURRING = MIN_LENGTH // MIN_PERIODS
#: Places of a block of the range minimum, whose sparse table holds one entry a block.
BLOCK = 32

_EMPTY = np.zeros((0, 3), dtype=np.int64)


def _double(rank: np.ndarray, width: int, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by the first 2 * ``width`` words from ranks by ``width``, and the places whose rank others share.

    A rank is the number of suffixes that are smaller. Only the places ``active``, of shared ranks, are sorted.
    """
    n = len(rank)
    behind = np.where(active + width < n, rank[np.minimum(active + width, n - 1)] + 1, 0)
    own = rank[active]
    order = np.lexsort((behind, own))
    own, behind, places = own[order], behind[order], active[order]
    first_of_group = np.concatenate([[True], own[1:] != own[:-1]])
    fresh = first_of_group | np.concatenate([[True], behind[1:] != behind[:-1]])
    at = np.arange(len(order))
    group = np.maximum.accumulate(np.where(first_of_group, at, 0))
    part = np.maximum.accumulate(np.where(fresh, at, 0))
    out = rank.copy()
    out[places] = own + part - group
    shared = ~(fresh & np.concatenate([fresh[1:], [True]]))
    return out, np.sort(places[shared])


class _Suffixes:
    """Suffix array, its inverse, LCP array and range minima of one text of word numbers."""

    def __init__(self, rank: np.ndarray, width: int, active: np.ndarray, words: np.ndarray):
        while len(active):
            rank, active = _double(rank, width, active)
            width *= 2
        self.inverse, n = rank, len(rank)
        suffixes = np.empty(n, dtype=np.int64)
        suffixes[rank] = np.arange(n)
        self.lcp = self._common(words.tolist(), suffixes.tolist(), rank.tolist())
        blocks = -(-n // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        padded[:n] = self.lcp
        square = padded.reshape(blocks, BLOCK)
        self._before = np.minimum.accumulate(square, axis=1).ravel()
        self._behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        self._padded, self._table = padded, [square.min(axis=1)]
        while (1 << len(self._table)) <= blocks:
            last, step = self._table[-1], 1 << (len(self._table) - 1)
            self._table.append(np.minimum(last[:-step], last[step:]))

    @staticmethod
    def _common(words: list[int], suffixes: list[int], inverse: list[int]) -> np.ndarray:
        """Words that the suffix of each rank has in common with the one before it."""
        n, k = len(words), 0
        out = np.zeros(n, dtype=np.int64)
        for i in range(n):
            r = inverse[i]
            if r == 0:
                k = 0
                continue
            j = suffixes[r - 1]
            top = n - max(i, j)
            while k < top and words[i + k] == words[j + k]:
                k += 1
            out[r] = k
            k = max(k - 1, 0)
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at different places ``i`` and ``j`` have in common; a place behind the end has none."""
        n = len(self.inverse)
        inside = (i < n) & (j < n)
        out = np.zeros(len(i), dtype=np.int64)
        a, b = self.inverse[i[inside]], self.inverse[j[inside]]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)  # minimum of lcp[lo..hi]
        first, last = lo // BLOCK, hi // BLOCK
        least = np.minimum(self._behind[lo], self._before[hi])
        same = np.nonzero(first == last)[0]
        if len(same):
            least[same] = np.iinfo(np.int64).max
            for k in range(BLOCK):
                at = lo[same] + k
                ok = at <= hi[same]
                least[same[ok]] = np.minimum(least[same[ok]], self._padded[at[ok]])
        far = np.nonzero(last - first > 1)[0]
        if len(far):
            f, count = first[far] + 1, last[far] - first[far] - 1
            level = np.frexp(count)[1] - 1  # the largest power of two within
            for k in np.unique(level):
                mine = level == k
                table, start = self._table[k], f[mine]
                least[far[mine]] = np.minimum(least[far[mine]], np.minimum(table[start], table[start + count[mine] - (1 << int(k))]))
        out[inside] = least
        return out


def _next_smaller(values: list[int]) -> np.ndarray:
    """The first place behind each at which a smaller value stands, or the number of places."""
    n = len(values)
    out, waiting = [n] * n, []
    for i, v in enumerate(values):
        while waiting and values[waiting[-1]] > v:
            out[waiting.pop()] = i
        waiting.append(i)
    return np.array(out, dtype=np.int64)


def _first_ranks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of places by one word, and the places that share theirs."""
    order = np.sort(words)
    rank = np.searchsorted(order, words)
    return rank, np.nonzero(np.searchsorted(order, words, side="right") - rank > 1)[0]


def runs_of(words: np.ndarray) -> np.ndarray:
    """``(start, length, period)`` of all runs of a text of word numbers, by start and period."""
    n = len(words)
    if n < MIN_LENGTH:
        return _EMPTY
    rank, active = _first_ranks(words)
    width = 1
    while width < RECURRING and len(active):
        rank, active = _double(rank, width, active)
        width *= 2
    if not len(active):
        return _EMPTY
    recurring = rank
    deep = _double(rank, width, active)
    if not len(deep[1]):  # twice as many words recur in a run, too: length - period >= 16
        return _EMPTY
    suffixes = _Suffixes(deep[0], 2 * width, deep[1], words)
    inverse = suffixes.inverse.tolist()
    found = []
    for values in (inverse, [-v for v in inverse]):
        ends = _next_smaller(values)[active]
        within = ends < n
        begin, end = active[within], ends[within]
        again = recurring[begin] == recurring[end]
        begin, end = begin[again], end[again]
        right = suffixes.common(begin, end)
        whole = right > end - begin
        found.append(np.stack([begin[whole], end[whole], right[whole]], axis=1))
    begin, end, right = np.concatenate(found).T
    if not len(begin):
        return _EMPTY
    back = words[::-1].copy()
    rank, active = _first_ranks(back)
    mirrored = _Suffixes(rank, 1, active, back)
    left = mirrored.common(n - begin, n - end)  # what stands before the root's two ends
    rows = np.stack([begin - left, left + end - begin + right, end - begin], axis=1)
    rows = rows[rows[:, 1] >= np.maximum(MIN_LENGTH, MIN_PERIODS * rows[:, 2])]
    return np.unique(rows, axis=0) if len(rows) else _EMPTY


def _ordered(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def strongest(rows: np.ndarray) -> tuple[int, int, int]:
    """The run with the most periods (length / period, exactly); of equal ones the first start, then the smallest period."""
    best = None
    for start, length, period in rows.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapsed(words: list[str], rows: np.ndarray) -> list[str]:
    """The words without those that a run holds behind its first period."""
    if not len(rows):
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, rows[:, 0] + rows[:, 2], 1)
    np.add.at(depth, rows[:, 0] + rows[:, 1], -1)
    return [words[i] for i in np.nonzero(np.cumsum(depth[:-1]) == 0)[0].tolist()]


_NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _run_batches(texts_too: bool):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6 + [pa.string()] * (2 + texts_too) + [pa.list_(pa.list_(pa.int64()))] * texts_too
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    words = WORD.findall(text)
                    numbers: dict[str, int] = {}
                    rows = _ordered(runs_of(np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)))
                    best = strongest(rows)
                    lines = "".join(f"{s},{n},{p}\n" for s, n, p in rows.tolist())
                    kept = " ".join(collapsed(words, rows))
                    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
                    digests = [sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (lines, kept)]
                    out.append((doc_id, len(rows), *top, *digests) + ((kept, rows.tolist()) if texts_too else ()))
                names = _NAMES + ["collapsed", "runs"] * texts_too
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return found


def periodic_runs(docs: DataFrame, texts_too: bool = False) -> DataFrame:
    """One row per row of ``docs``: how many runs its words have, the strongest, digests of all runs and of the collapsed text.

    With ``texts_too`` also ``collapsed``, the kept words joined by a space, and ``runs``, triples (start, length,
    period). A null text has no words, a null doc_id stays null, repeated rows stay, columns other than doc_id and
    text are not read, no rows give none. Texts are whole, however long: memory of a task is about 200 bytes a word
    of a text with recurring words, 60 of others.
    """
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text").cast("string")).alias("text"))
    return named.mapInArrow(_run_batches(texts_too), schema + (", collapsed string, runs array<array<long>>" if texts_too else ""))
