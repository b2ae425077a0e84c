"""Periodic runs of words: passages that repeat themselves at once.

A run is a stretch of words of smallest period ``q``, as long as it goes with that
period, of at least ``max(LEAST, TIMES * q)`` words.  They are read off a suffix automaton
of the words: a state stands for the substrings that end at the same
places, its ends are those of its children in the tree of suffix links, and
the smaller sets are merged into the largest one, which is kept in order.  Where a
word's end comes between others, a distance to a neighbour not over the state's length
is a square, and the run is this square carried on to the right as far as it
goes; the state's length has carried it to the left already.

A run holds a stretch of ``LEAST - LEAST // TIMES`` words that comes again in
it, a third of the text away at most: with the usual values, 16.  Places where such a
stretch is repeated are found first by hash, and automata are built only over the
words that these stretches cover, each unbroken cover alone.  This loses no run: every
word of one lies in such a stretch, and hashes that clash only add places.

Defined cases: null and empty texts have no words and no runs; of two runs over the
same words there is one, of the smaller period; runs may overlap; texts of any length are
taken whole, an automaton takes about 500 bytes for each word that it covers;
repeated rows have the same runs each; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches
from ._words import as_bytes, mix

LEAST = 24
TIMES = 3
_BLOCK = 256


class Ends:
    """An ordered set of word ends in blocks, so that one more costs no move of them all."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, first: int) -> None:
        self.blocks, self.tops, self.size = [[first]], [first], 1

    def add(self, x: int) -> None:
        k = bisect_left(self.tops, x)
        if k == len(self.tops):
            k -= 1
            self.blocks[k].append(x)
            self.tops[k] = x
        else:
            b = self.blocks[k]
            b.insert(bisect_left(b, x), x)
        self.size += 1
        b = self.blocks[k]
        if len(b) > 2 * _BLOCK:
            self.blocks[k : k + 1] = [b[:_BLOCK], b[_BLOCK:]]
            self.tops[k : k + 1] = [b[_BLOCK - 1], b[-1]]

    def around(self, x: int) -> tuple[int, int]:
        """The neighbours of a member; -1 where there is none."""
        k = bisect_left(self.tops, x)
        b = self.blocks[k]
        i = bisect_left(b, x)
        below = b[i - 1] if i else self.blocks[k - 1][-1] if k else -1
        above = b[i + 1] if i + 1 < len(b) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        return below, above

    def __iter__(self):
        for b in self.blocks:
            yield from b


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end (-1: none) of every state of the words' suffix automaton; state 0 is the root."""
    length, link, end = [0], [-1], [-1]
    after: list[dict[int, int]] = [{}]
    last = 0
    for i, c in enumerate(words):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        after.append({})
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                after.append(after[q].copy())
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return length, link, end


def squares(words: list[int], shortest: int = 1):
    """``(first word, period, end)`` of squares, for each run among others the one from its first word.

    States shorter than ``shortest`` are left out.
    """
    length, link, end = automaton(words)
    order = sorted((s for s in range(1, len(length)) if length[s] >= shortest), key=length.__getitem__, reverse=True)
    held: list[Ends | None] = [None] * len(length)
    fresh: list[list[int] | None] = [None] * len(length)
    for s in order:
        long, mine, new = length[s], held[s], fresh[s]
        if mine is None:
            mine = Ends(end[s])
        elif end[s] >= 0:
            mine.add(end[s])
            new = [*(new or ()), end[s]]
        for x in new or ():
            below, above = mine.around(x)
            if below >= 0 and x - below <= long:
                yield below - long + 1, x - below, x
            if above >= 0 and above - x <= long:
                yield x - long + 1, above - x, above
        held[s] = fresh[s] = None
        up = link[s]
        if length[up] < shortest:
            continue
        other = held[up]
        if other is None:
            held[up] = mine
            continue
        if other.size < mine.size:
            held[up], mine, other = mine, other, mine
        if fresh[up] is None:
            fresh[up] = []
        for x in mine:
            other.add(x)
            fresh[up].append(x)


def carried(words: np.ndarray, at: int, period: int) -> int:
    """The first place from ``at`` on whose word is not the one a period before it, or the end."""
    step = 64
    n = len(words)
    while at < n:
        to = min(n, at + step)
        off = np.flatnonzero(words[at:to] != words[at - period : to - period])
        if len(off):
            return at + int(off[0])
        at, step = to, step * 2
    return n


def runs_in(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of one piece, by automaton."""
    seen, out = set(), []
    for start, q, to in squares(words.tolist(), least - least // times):
        # Two ends of one child meet again in its parents, whose strings begin later: their run is known.
        if (start, q) in seen or start and words[start - 1] == words[start - 1 + q]:
            continue
        seen.add((start, q))
        length = carried(words, to + 1, q) - start
        if length >= max(least, times * q):
            out.append((start, length, q))
    return sorted(out)


def covers(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Unbroken stretches, from and to, that hold every run."""
    n, k = len(words), least - least // times
    if n < least:
        return []
    h = _stretch_hashes(words, k)
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    near = same & (order[1:] - order[:-1] <= n // times)
    marks = np.zeros(n + 1, dtype=np.int64)
    places = np.unique(np.concatenate([order[1:][near], order[:-1][near]]))
    np.add.at(marks, places, 1)
    np.add.at(marks, places + k, -1)
    inside = np.concatenate([[0], (np.cumsum(marks) > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(inside))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= least]


def _stretch_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each stretch of ``k`` words, joined from stretches of powers of two."""
    with np.errstate(over="ignore"):
        h, size, out, done = mix(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1, None, 0
        m = len(words) - k + 1
        while k >> (size.bit_length() - 1):
            if k & size:
                part = h[done : done + m]
                out = part if out is None else mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + part)
                done += size
            if 2 * size <= k:
                h = mix(h[:-size] * np.uint64(0x165667B19E3779F9) + h[size:])
            size *= 2
    return out


def numbered(words: list) -> np.ndarray:
    """A number for each word, equal for equal words alone."""
    known: dict = {}
    give = known.setdefault
    return np.fromiter((give(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def word_runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a text's words, by start, then period."""
    if len(words) < least:
        return []
    n = numbered(words)
    return sorted((a + s, m, q) for a, b in covers(n, least, times) for s, m, q in runs_in(n[a:b], least, times))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay if each run is collapsed to its first period."""
    stay = np.ones(n, dtype=bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return stay


def periodic(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: each text's runs by start, then period, and its words without their repeats, joined by a space."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def emit(batches):
        for b in batches:
            counts, found, left = [], [], []
            for data in as_bytes(b.column(1)):
                words = data.split()
                runs = word_runs(words, least, times)
                counts.append(len(words))
                found.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                if runs:
                    words = [words[i] for i in np.flatnonzero(kept(len(words), runs)).tolist()]
                left.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(emit, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
