"""Distinct sampled segmentations of texts into SentencePiece pieces.

A text's lattice has a node at every character and an edge for every piece
that fits; a path's weight is the product of its pieces' weights, which fall
with the piece's rank in the vocabulary (``-THETA * log(2 + rank)``, byte
pieces last).  Backward sums give exact conditional odds of each next piece.

Gumbel top-k without replacement then draws ``k`` distinct paths by an A-star
search over perturbed partial paths.  An open state is a partial path, the node
that it ends at and the edges barred there; it stands for all its completions
and carries the maximum of their perturbed log odds.  The state of largest
maximum is taken; its best completion follows the lattice's odds and is the next
path of the sample.  What the state stood for besides falls apart into one state
a node of that path (the path up to there, its next edge barred), whose maxima
are drawn conditional on the one just taken.  Where the (k+1)-th state would be
taken is the threshold that gives each path's inclusion score
``1 - exp(-exp(log p - threshold))``.

Texts are cut into units between characters that stand side by side in no piece,
and the lattice of a unit into stretches where no piece crosses.  A worker builds
and sums the lattices of all new units together with numpy and keeps them, found
again by a 64-bit hash and compared character by character; those of many texts
are then walked together.  The path of each node's likeliest piece is taken at
once by a stretch whose draw is below that path's odds; otherwise the draw goes on
node by node.  Every draw is a hash of the row's seed, the path's number and the
place in the text, so equal keys and texts give equal samples wherever and however
often they run.  Decoding is exact: a U+2581 of the text, which marks spaces in
pieces, is written as its bytes.

Defined cases: a null or empty text has one segmentation, without pieces;
where a text has fewer than ``k`` segmentations all of them are given with
inclusion 1; repeated rows give equal samples; ties have odds of 2**-53 and go
to the state nearest the text's beginning; null keys hash as null; an empty
table gives no rows; a text of any length has its whole lattice, about 400 bytes
a character, in memory; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches
from ._words import mix

SPACE = "▁"
#: Stands for a space mark of the text itself, and for the end of a text; no valid text holds them.
MARK, END = "\ud800", "\ud801"
THETA = 1.0
SAMPLES = 3
SEED = 17
#: Characters whose lattices are built and walked together.
GROUP = 200_000
#: Units that a worker remembers, and edges in its store (24 bytes each), at most.
UNITS, STORED = 800_000, 12_000_000
#: Pieces of a stretch that are taken at once, and states of a path that have a draw of their own, at most.
CHAIN, WIDTH = 16, 128
#: Places that are followed one by one, at most.
FEW = 12
#: Characters below this have a column of their own in the table of transitions.
DENSE = 0x180
#: Base of the units' hashes, and its inverse modulo 2**64.
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP, _PATH = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93

_lattices: dict[str, Lattice] = {}
_tables: list[np.ndarray] = []


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def seed_of(key: tuple, seed: int = SEED) -> int:
    text = repr((seed, *key)).encode()
    return zlib.crc32(text) << 32 | zlib.crc32(text, 1)


@dataclass
class Texts:
    """Texts laid end to end, each closed by one place without pieces; a place is a character, a node of the store."""

    n: int  # places
    first: np.ndarray  # first place of a text
    #: By stretch: first places, lengths, first nodes, odds of the first pieces, and how many these are.
    cuts: np.ndarray
    length: np.ndarray
    base: np.ndarray
    odds: np.ndarray
    count: np.ndarray
    #: By place: the edges of the first pieces, -1 elsewhere; and the places that have one.
    chain: np.ndarray
    places: np.ndarray

    def nodes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of places, and the ends of their stretches."""
        k = np.searchsorted(self.cuts, at, side="right") - 1
        return self.base[k] + (at - self.cuts[k]), self.cuts[k] + self.length[k]


class Store:
    """The lattices of all units met so far, each a row of stretches: text between two places that no piece crosses.

    A unit's stretches follow one another, a stretch's nodes and a node's edges too.
    """

    #: Columns of units, stretches (chain is where their first pieces begin), first pieces (off is the distance to the
    #: stretch's beginning), nodes (left is the distance to the stretch's end) and edges (piece is -1 for a text's end and -2
    #: less the code point for a character's bytes, cum the sums of odds up to an edge in its node, the last one over 1).
    UNIT = (("unit_at", np.int32), ("unit_n", np.int32), ("unit_size", np.int32), ("hash", np.uint64))
    STRETCH = (("base", np.int32), ("length", np.int32), ("odds", np.float64), ("chain", np.int32), ("chain_n", np.int32))
    FIRST = (("off", np.int32), ("edge", np.int32))
    NODE = (("at", np.int32), ("count", np.int32), ("left", np.int32), ("code", np.uint32))
    EDGE = (("piece", np.int32), ("size", np.int32), ("log_p", np.float64), ("cum", np.float64))
    KINDS = (UNIT, STRETCH, FIRST, NODE, EDGE)
    #: The kind of which a column holds the numbers, which are counted from the first new one on the way in.
    POINTS = {"unit_at": 1, "base": 3, "chain": 2, "edge": 4, "at": 4}

    def __init__(self) -> None:
        self.sizes = [0] * len(self.KINDS)
        #: Once the store is half full: what it held then.
        self.half: list[int] | None = None
        #: Units by hash, in the first free slot from the hash's own on, -1 where there is none.
        self.slots = np.full(1 << 12, -1, dtype=np.int32)
        for name, kind in sum(self.KINDS, ()):
            setattr(self, name, np.empty(1024, dtype=kind))

    @property
    def stretches(self) -> np.ndarray:
        """First nodes of all stretches."""
        return self.base[: self.sizes[1]]

    def find(self, key: np.ndarray) -> np.ndarray:
        """The units of hashes, -1 where there is none."""
        mask = len(self.slots) - 1
        slot = (key & np.uint64(mask)).astype(np.int64)
        out = self.slots[slot]
        todo = np.flatnonzero((out >= 0) & (self.hash[out] != key))
        while len(todo):
            slot[todo] = at = (slot[todo] + 1) & mask
            out[todo] = found = self.slots[at]
            todo = todo[(found >= 0) & (self.hash[found] != key[todo])]
        return out

    def _place(self, unit: np.ndarray) -> None:
        """Put units into the slots."""
        mask = len(self.slots) - 1
        slot = (self.hash[unit] & np.uint64(mask)).astype(np.int64)
        while len(unit):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = unit[free]
            on = np.flatnonzero(self.slots[slot] != unit)
            unit, slot = unit[on], (slot[on] + 1) & mask

    def add(self, new: dict[str, np.ndarray], listed: bool) -> np.ndarray:
        """New units with their columns; only ``listed`` ones are found again."""
        before = list(self.sizes)
        for k, kind in enumerate(self.KINDS):
            a, b = before[k], before[k] + len(new[kind[0][0]])
            for name, _ in kind:
                old = getattr(self, name)
                if b > len(old):
                    setattr(self, name, np.empty(max(b, len(old) * 3 // 2), dtype=old.dtype))
                    getattr(self, name)[:a] = old[:a]
                getattr(self, name)[a:b] = new[name] + before[self.POINTS[name]] if name in self.POINTS else new[name]
            self.sizes[k] = b
        unit = np.arange(before[0], self.sizes[0], dtype=np.int32)
        if listed:
            if 2 * self.sizes[0] > len(self.slots):
                self._list(max(4 * len(self.slots), 1 << (4 * self.sizes[0]).bit_length()), self.find(self.hash[: before[0]]) if before[0] else unit[:0])
            self._place(unit)
        return unit

    def _list(self, size: int, unit: np.ndarray) -> None:
        self.slots = np.full(size, -1, dtype=np.int32)
        self._place(np.unique(unit))

    def trim(self) -> None:
        """Forget what came since the store was half full, when it is full: the most frequent units came early."""
        units, edges = self.sizes[0], self.sizes[-1]
        if self.half is None and (edges > STORED // 2 or units > UNITS // 2):
            self.half = list(self.sizes)
        elif self.half is not None and (edges > STORED or units > UNITS):
            listed = self.slots[self.slots >= 0]
            self.sizes = list(self.half)
            self._list(len(self.slots), listed[listed < self.sizes[0]])


class Lattice:
    """The pieces of a model as a trie, and the lattices of texts."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.bytes_of: list[bytes] = [b""] * n
        self.weight = np.zeros(n)
        self.byte_weight = -THETA * math.log(2 + n)
        pieces: dict[str, int] = {}
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(name[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[name] = i
                self.bytes_of[i] = name.replace(SPACE, " ").encode()
                self.weight[i] = -THETA * math.log(2 + max(0.0, -sp.get_score(i)))
        self.spelled = pa.array(self.bytes_of, pa.large_binary())
        chars = sorted({c for name in pieces for c in name}, key=lambda c: (ord(c) >= DENSE and c != SPACE, c))
        self.dense = 1 + sum(ord(c) < DENSE or c == SPACE for c in chars)
        self.classes = len(chars) + 1
        self.class_of = np.zeros(0x110000, dtype=np.int32)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, self.classes)
        self.class_of[ord(" ")] = self.class_of[ord(SPACE)]  # texts keep their spaces
        beside = {(int(self.class_of[ord(a)]), int(self.class_of[ord(b)])) for name in pieces for a, b in zip(name, name[1:])}
        self.beside = np.zeros((self.dense, self.dense), dtype=bool)
        for a, b in beside:
            if a < self.dense and b < self.dense:
                self.beside[a, b] = True
        self.rare_beside = np.array(sorted(a * self.classes + b for a, b in beside if a >= self.dense or b >= self.dense) or [-1], dtype=np.int64)
        steps: dict[tuple[int, int], int] = {}
        found = {}
        for name, i in pieces.items():
            state = 1
            for c in name:
                state = steps.setdefault((state, int(self.class_of[ord(c)])), len(steps) + 2)
            found[state] = i
        self.table = np.zeros((len(steps) + 2, self.dense), dtype=np.int32)
        rare = sorted((s * self.classes + c, t) for (s, c), t in steps.items() if c >= self.dense)
        self.rare = np.array([k for k, _ in rare] or [-1], dtype=np.int64)
        self.rare_to = np.array([t for _, t in rare] or [0], dtype=np.int32)
        for (s, c), t in steps.items():
            if c < self.dense:
                self.table[s, c] = t
        self.piece_of = np.full(len(steps) + 2, -1, dtype=np.int32)
        self.piece_of[list(found)] = list(found.values())
        self.store = Store()

    def _next(self, state, cls):
        """The trie's next states, 0 where there is none."""
        if len(cls) and int(cls.max()) < self.dense:
            return self.table[state, cls]
        out = self.table[state, np.where(cls < self.dense, cls, 0)]
        at = np.flatnonzero(cls >= self.dense)
        key = (np.broadcast_to(state, cls.shape)[at].astype(np.int64)) * self.classes + cls[at]
        k = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
        out[at] = np.where(self.rare[k] == key, self.rare_to[k], 0)
        return out

    def _cut(self, cls: np.ndarray) -> np.ndarray:
        """First places of the units of a text, by its characters' classes."""
        a, b = cls[:-1], cls[1:]
        if len(cls) and int(cls.max()) < self.dense:
            joined = self.beside.ravel()[a * self.dense + b]
        else:
            plain = (a < self.dense) & (b < self.dense)
            joined = self.beside.ravel()[np.where(plain, a * self.dense + b, 0)]
            odd = np.flatnonzero(~plain)
            key = a[odd].astype(np.int64) * self.classes + b[odd]
            joined[odd] = self.rare_beside[np.minimum(np.searchsorted(self.rare_beside, key), len(self.rare_beside) - 1)] == key
        return np.concatenate([[0], np.flatnonzero(~joined) + 1])

    def texts(self, texts: list[str]) -> Texts:
        """``texts`` as places, with the lattices of what is new in the store."""
        store = self.store
        store.trim()
        whole = "".join([f" {t}{END}" if t else END for t in texts])
        if SPACE in whole:
            whole = whole.replace(SPACE, MARK)
        code = _codes(whole)
        start = self._cut(self.class_of[code])
        size = np.diff(start, append=len(code))
        key = _hashes(code, start, size)
        unit = store.find(key)
        if len(gaps := np.flatnonzero(unit < 0)):
            fresh, first = np.unique(key[gaps], return_index=True)
            first = gaps[first]
            unit[gaps] = self._build(code, start[first], size[first], fresh)[np.searchsorted(fresh, key[gaps])]
        if len(odd := np.flatnonzero(self._other(code, unit, start, size))):  # hashes that clash: built anew
            unit[odd] = self._build(code, start[odd], size[odd], key[odd], listed=False)
        stretch = _runs(store.unit_at[unit], store.unit_n[unit])
        length = store.length[stretch].astype(np.int64)
        cuts = np.cumsum(length) - length
        size = np.array([len(t) + 2 if t else 1 for t in texts])
        count = store.chain_n[stretch]
        k = _runs(store.chain[stretch], count)
        places = np.repeat(cuts, count) + store.off[k]
        chain = np.full(len(code), -1, dtype=np.int32)
        chain[places] = store.edge[k]
        return Texts(len(code), np.cumsum(size) - size, cuts, length, store.base[stretch], store.odds[stretch], count, chain, places)

    def _other(self, code: np.ndarray, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether units are not the text from ``start`` on."""
        store = self.store
        other = store.unit_size[unit] != size
        if other.any():
            keep = np.flatnonzero(~other)
            other[keep] = self._other(code, unit[keep], start[keep], size[keep])
            return other
        text = code if int(size.sum()) == len(code) else code[_runs(start, size)]
        same = text == store.code[_runs(store.base[store.unit_at[unit]], size)]
        if not same.all():
            other[np.repeat(np.arange(len(unit)), size)[~same]] = True
        return other

    def _build(self, text: np.ndarray, begins: np.ndarray, own_size: np.ndarray, key: np.ndarray, listed: bool = True) -> np.ndarray:
        """Put the lattices of new units, parts of a text, into the store."""
        closing = np.cumsum(own_size + 1) - 1  # places between units, which are not kept
        n = int(closing[-1]) + 1
        code = text[np.minimum(_runs(begins, own_size + 1), len(text) - 1)]
        code[closing] = ord(END)
        cls = self.class_of[code]
        count = np.zeros(n, dtype=np.int32)
        reach = np.arange(1, n + 1)
        starts, lengths, ids, ranks = [], [], [], []
        pos, state, step = np.arange(n), self._next(1, cls), 1
        while True:
            go = np.flatnonzero(state)
            pos, state = pos[go], state[go]
            if not len(pos):
                break
            piece = self.piece_of[state]
            hit = np.flatnonzero(piece >= 0)
            at = pos[hit]
            starts.append(at)
            lengths.append(np.full(len(at), step))
            ids.append(piece[hit])
            ranks.append(count[at])
            count[at] += 1
            reach[at] = at + step
            if step == 1:
                single = np.zeros(n, dtype=bool)
                single[at] = True
            inside = np.flatnonzero(pos + step < n)
            pos, state = pos[inside], state[inside]
            state = self._next(state, cls[pos + step])
            step += 1
        at = np.flatnonzero(~single) if starts else np.arange(n)
        bytes_ = utf8_size(code[at])
        close = code[at] == ord(END)
        starts.append(at)
        lengths.append(np.ones(len(at), dtype=np.int64))
        ids.append(np.where(close, -1, -2).astype(np.int32))
        ranks.append(count[at])
        count[at] += 1
        start, length, piece, rank = (np.concatenate(x) for x in (starts, lengths, ids, ranks))
        weight = self.weight[np.maximum(piece, 0)]
        weight[len(weight) - len(at) :] = np.where(close, 0.0, self.byte_weight * bytes_)
        furthest = np.maximum.accumulate(reach)
        ends = np.flatnonzero(furthest == np.arange(1, n + 1)) + 1
        cuts = np.concatenate([[0], ends[:-1]])
        end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        left = end - np.arange(n)
        order = np.argsort(left.astype(np.int16) if n and left.max() < 1 << 15 else left, kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        by = count[order]
        offset = np.concatenate([[0], np.cumsum(by)])
        slot = offset[place[start] + 1] - 1 - rank
        m = len(slot)
        e_piece, e_to, e_w, open_ = np.empty(m, np.int32), np.empty(m, np.int64), np.empty(m), np.empty(m)
        e_piece[slot], e_to[slot], e_w[slot] = piece, start + length, weight
        open_[slot] = start + length < end[start]
        total, p, log_p = np.zeros(n + 1), np.empty(m), np.empty(m)
        levels = np.concatenate([[0], np.flatnonzero(np.diff(left[order])) + 1, [n]])
        for a, b in zip(levels[:-1].tolist(), levels[1:].tolist()):
            x, y = int(offset[a]), int(offset[b])
            v = e_w[x:y] + total[e_to[x:y]] * open_[x:y]
            if y - x == b - a:
                total[order[a:b]], p[x:y], log_p[x:y] = v, 1.0, 0.0
                continue
            cut, k = offset[a:b] - x, by[a:b]
            top = np.maximum.reduceat(v, cut)
            v -= np.repeat(top, k)
            w = np.exp(v)
            s = np.add.reduceat(w, cut)
            log_s = np.log(s)
            total[order[a:b]] = top + log_s
            p[x:y] = w / np.repeat(s, k)
            log_p[x:y] = v - np.repeat(log_s, k)
        del starts, lengths, ids, ranks, start, length, piece, rank, weight, slot, open_, e_w  # a long text needs the room
        e_size = e_to - np.repeat(order, by)
        top = np.maximum.reduceat(p, offset[:-1])  # the likeliest piece of a node comes first
        best = np.flatnonzero(p == np.repeat(top, by))
        whose = np.searchsorted(offset, best, side="right") - 1
        head = offset[:-1].copy()
        head[whose[::-1]] = best[::-1]  # of equal ones that which is written last, the first
        whose = np.flatnonzero(head != offset[:-1])
        a, b = offset[whose], head[whose]
        for x in (e_piece, e_to, e_size, p, log_p):
            x[a], x[b] = x[b], x[a]
        cum = p.copy()
        for r in range(1, int(by.max(initial=1))):
            k = offset[:-1][by > r] + r
            cum[k] += cum[k - 1]
        cum[offset[1:] - 1] = 2.0
        e_piece = np.where(e_piece == -2, -2 - code[np.minimum(e_to - 1, n - 1)].astype(np.int64), e_piece)
        at_node = offset[place]
        nodes = np.delete(np.arange(n), closing)
        c = count[nodes]
        own = np.cumsum(c) - c
        edges = _runs(at_node[nodes], c)
        last = np.searchsorted(cuts, closing)
        unit_n = np.diff(last, prepend=-1) - 1
        begin = np.delete(cuts, last)
        finish = np.delete(ends, last)
        shift = np.repeat(np.arange(len(key)), unit_n)
        base = begin - shift
        live, x, odds = np.arange(len(begin)), begin, np.zeros(len(begin))
        who, off = [], []
        for _ in range(CHAIN):
            who.append(live)
            off.append(x - begin[live])
            k = at_node[x]
            odds[live] += log_p[k]
            x = e_to[k]
            on = np.flatnonzero(x < finish[live])
            live, x = live[on], x[on]
            if not len(live):
                break
        odds = np.exp(odds)
        odds[live] = 0.0
        of, far = np.concatenate(who), np.concatenate(off)
        by_stretch = np.argsort(of, kind="stable")
        of, far = of[by_stretch], far[by_stretch]
        chain_n = np.bincount(of, minlength=len(begin))
        new = {
            "unit_at": np.cumsum(unit_n) - unit_n, "unit_n": unit_n, "unit_size": own_size, "hash": key,
            "base": base, "length": finish - begin, "odds": odds, "chain": np.cumsum(chain_n) - chain_n, "chain_n": chain_n,
            "off": far, "edge": own[base[of] + far],
            "at": own, "count": c, "left": left[nodes], "code": code[nodes],
            "piece": e_piece[edges], "size": e_size[edges], "log_p": log_p[edges], "cum": cum[edges],
        }
        return self.store.add(new, listed)

    def ids(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a path (its edges in order of place) and how many stand before each edge and after the last."""
        piece = self.store.piece[path]
        odd = np.flatnonzero(piece < 0)
        raw = -2 - piece[odd]  # -1 for a text's end
        size = np.ones(len(path), dtype=np.int64)
        size[odd] = np.where(raw < 0, 0, utf8_size(raw))
        offset = np.zeros(len(path) + 1, dtype=np.int64)
        np.cumsum(size, out=offset[1:])
        out = np.repeat(piece, size)
        single = (raw >= 0) & (raw < 0x80)
        out[offset[odd[single]]] = self.byte_ids[raw[single]]
        wide = raw >= 0x80
        for k, x in zip(odd[wide].tolist(), raw[wide].tolist()):
            c = chr(x)
            out[offset[k] : offset[k + 1]] = self.byte_ids[list((SPACE if c == MARK else c).encode("utf-8", "surrogatepass"))]
        return out, offset

    def joined(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of pieces one after the other, and where each begins and the last one ends."""
        out = self.spelled.take(pa.array(ids))
        _, offset, data = out.buffers()
        return memoryview(data or b"").cast("B"), np.frombuffer(offset, dtype=np.int64)[: len(ids) + 1]

    def decode(self, ids) -> str:
        """The text of a segmentation."""
        data, ends = self.joined(np.asarray(ids, dtype=np.int32))
        return bytes(data[: ends[-1]]).decode("utf-8", "replace")[1:]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, dtype=np.uint64)]))


def _hashes(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of parts of a text."""
    n = max(len(code), GROUP)
    if len(_tables) != 2 or len(_tables[0]) <= n:
        _tables[:] = _powers(_BASE, n), _powers(_INVERSE, n)
    up, down = _tables
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum((code + np.uint64(1)) * up[: len(code)], out=total[1:])
    if n > 4 * GROUP:
        _tables.clear()
    return mix((total[start + size] - total[start]) * down[start])


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from each of ``first`` on, one run after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def utf8_size(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80) + (code >= 0x800).astype(np.int64) + (code >= 0x10000)


def keyed(seeds: np.ndarray, path: int) -> np.ndarray:
    """Keys of a path's draws, one for each seed."""
    return mix(seeds + np.uint64((path + 1) * _PATH % (1 << 64)))


def uniform(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Draws in (0, 1), one for each key and place."""
    return ((mix(key + place.astype(np.uint64) * _STEP) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel(u):
    return -np.log(-np.log(u))


def walk(store: Store, at: np.ndarray, node: np.ndarray, origin: np.ndarray, u: np.ndarray, chosen: np.ndarray) -> None:
    """Follow the lattices' odds from the places ``at`` to the ends of their stretches; edges go to ``chosen`` by place.

    A draw that takes the first edge, below whose odds it then is uniform, is
    stretched to (0, 1) for the next node; any other edge asks for a new draw.
    """
    while len(at) > FEW:
        edge = store.at[node]
        first = store.cum[edge]
        more = other = np.flatnonzero(u >= first)
        while len(more):
            on = edge[more] + 1
            edge[more] = on
            more = more[u[more] >= store.cum[on]]
        chosen[at] = edge
        size = store.size[edge]
        u = u / np.minimum(first, 1.0)
        u[other] = -1.0
        on = np.flatnonzero(size < store.left[node])
        size, origin, u = size[on], origin[on], u[on]
        at, node = at[on] + size, node[on] + size
        new = np.flatnonzero(u < 0)
        u[new] = uniform(origin[new], at[new])
    for one in zip(at.tolist(), node.tolist(), origin.tolist(), u.tolist()):
        _walk_one(store, *one, chosen)


def _walk_one(store: Store, at: int, node: int, origin: int, u: float, chosen: np.ndarray) -> None:
    """What :func:`walk` does, for one place in plain numbers."""
    step, full = int(_STEP), (1 << 64) - 1
    places, edges = [], []
    while True:
        edge = store.at.item(node)
        first = store.cum.item(edge)
        again = u < first
        if again:
            u /= min(first, 1.0)
        else:
            edge += 1
            while u >= store.cum.item(edge):
                edge += 1
        places.append(at)
        edges.append(edge)
        size = store.size.item(edge)
        if size >= store.left.item(node):
            break
        at += size
        node += size
        if not again:
            x = origin + at * step & full
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
            x = (x ^ x >> 27) * 0x94D049BB133111EB & full
            u = ((x ^ x >> 31) >> 11) + 0.5
            u *= 2.0**-53
    chosen[places] = edges


def states(ahead: np.ndarray, places: np.ndarray, start: np.ndarray, stop: np.ndarray, lead: np.ndarray, keys: np.ndarray, origin: np.ndarray, most: int) -> list[list[tuple[float, int]]]:
    """For parts ``start`` to ``stop`` of texts' paths, whose steps have log odds ``ahead``, the states of largest perturbed log odds, ``most`` at least or all, as (these, place in the path).

    States behind the first ``WIDTH`` have one draw, the largest of theirs, by
    their odds together.  Where it is among the ``most`` largest, it goes to one
    of them by their odds, and the others' draws are brought below it.
    """
    if not len(ahead):
        return [[] for _ in start]
    width = WIDTH
    at = start[:, None] + np.arange(width)
    inside = at < stop[:, None]
    at = np.minimum(at, len(ahead) - 1)
    lp = np.where(inside, ahead[at], 0.0)
    run = lead[:, None] + np.cumsum(lp, axis=1)
    with np.errstate(divide="ignore"):
        mass = np.where(inside, run - lp + np.log(-np.expm1(lp)), -np.inf)  # of the path ahead and all other edges
    value = mass + gumbel(uniform(keys[:, None], places[at] - origin[:, None]))
    order = np.argpartition(-value, min(most, width) - 1, axis=1)[:, :most]
    best = np.take_along_axis(value, order, axis=1)
    out = [[(x, a + j) for x, j in zip(xs, js) if x > -np.inf] for a, xs, js in zip(start.tolist(), best.tolist(), order.tolist())]
    long = np.flatnonzero(stop - start > width)
    rest = np.array([ahead[a + width : b].sum() for a, b in zip(start[long].tolist(), stop[long].tolist())])
    spare = gumbel(uniform(mix(keys[long]), np.arange(1)))
    tail = run[long, -1] + np.log(-np.expm1(rest)) + spare
    for i in np.flatnonzero((tail >= best[long].min(axis=1)) | (len(best[0]) < most)).tolist():
        r = long[i]
        a, b = int(start[r]) + width, int(stop[r])
        lp = ahead[a:b]
        mass = run[r, -1] + np.cumsum(lp) - lp + np.log(-np.expm1(lp))
        value = mass + gumbel(uniform(keys[r : r + 1], places[a:b] - origin[r]))
        odds = np.cumsum(np.exp(mass - mass.max()))
        first = min(b - a - 1, int(np.searchsorted(odds, odds[-1] * uniform(mix(keys[r : r + 1]), np.arange(1, 2))[0], side="right")))
        value = -np.logaddexp(-tail[i], -value)
        value[first] = tail[i]
        out[r] += [(float(value[j]), a + j) for j in np.argsort(-value, kind="stable")[:most].tolist()]
    return out


def samples(lat: Lattice, texts: list[str], seeds: list[int], k: int = SAMPLES):
    """For each of ``k`` paths: (rows that have it, id offsets, ids, log p, perturbed log p, inclusion)."""
    g = lat.texts(texts)
    store = lat.store
    seeds = np.array(seeds, dtype=np.uint64)
    rows = len(texts)
    bounds = [*g.first.tolist(), g.n]
    by_row = np.diff(np.append(np.searchsorted(g.cuts, g.first), len(g.cuts)))  # stretches
    top = gumbel(uniform(keyed(seeds, 3000), np.arange(1)))
    open_: list[list] = [[] for _ in texts]  # states: (maximum, path, place, barred edges), in no order
    chosen: list[np.ndarray] = []
    done = []
    alive = np.ones(rows, dtype=bool)
    dev = np.full(rows, -1, dtype=np.int64)  # the place at which a row's state ends, and its node
    spot = np.zeros(rows, dtype=np.int64)
    barred: list[tuple] = [()] * rows
    for s in range(k):
        keys = keyed(seeds, s)
        from_ = keys - g.first.astype(np.uint64) * _STEP  # so that a draw goes by the place in its text
        origin = np.repeat(from_, by_row)
        u = uniform(origin, g.cuts)
        beyond = u >= g.odds
        mine = g.chain.copy()
        mine[g.places[np.repeat(beyond, g.count)]] = -1
        starts = []
        since = g.first.copy()  # places from where on stretches are drawn
        if s:  # up to their ends the states just taken hold
            parent = np.zeros(rows, dtype=np.int64)
            at = []
            for r in range(rows):
                if not open_[r]:
                    alive[r] = False
                    since[r] = bounds[r + 1]
                    mine[bounds[r] : bounds[r + 1]] = -1
                    continue
                best = max(open_[r], key=lambda x: x[0])
                open_[r].remove(best)
                top[r], parent[r], dev[r], barred[r] = best
                at.append(r)
            r_ = np.array(at, dtype=np.int64)
            v_ = dev[r_]
            spot[r_], end_ = g.nodes(v_)
            draws = uniform(from_[r_], v_)
            edge_ = np.array([_unbarred(store, n, barred[r], u) for r, n, u in zip(at, spot[r_].tolist(), draws.tolist())], dtype=np.int64)
            for r, v, end in zip(at, v_.tolist(), end_.tolist()):
                mine[bounds[r] : v] = chosen[parent[r]][bounds[r] : v]
                mine[v:end] = -1
            if at:
                mine[v_] = edge_
                size = store.size[edge_]
                on = np.flatnonzero(v_ + size < end_)
                inner = v_[on] + size[on]
                since[r_] = end_
                starts.append((inner, spot[r_[on]] + size[on], from_[r_[on]], uniform(from_[r_[on]], inner)))
        beyond = np.flatnonzero(beyond & (g.cuts >= np.repeat(since, by_row)))
        starts.append((g.cuts[beyond], g.base[beyond], origin[beyond], u[beyond]))
        walk(store, *map(np.concatenate, zip(*starts)), mine)
        chosen.append(mine)
        own = np.flatnonzero(mine >= 0)
        path = mine[own]
        live = np.flatnonzero(alive)
        cut = np.searchsorted(own, g.first[live])
        lp = store.log_p[path]
        total = np.add.reduceat(lp, cut) if len(live) else np.empty(0)
        ids, offset = lat.ids(path)
        done.append((live, np.append(offset[cut], offset[-1]), ids, total, top[live].copy()))
        if not len(live):
            break
        keys, again = keyed(seeds, 1000 + s)[live], keyed(seeds, 2000 + s)[live]
        start = np.searchsorted(own, np.maximum(dev[live], g.first[live] - 1), side="right")
        lead = np.array([lp[a:b].sum() for a, b in zip(cut.tolist(), start.tolist())])
        free = np.flatnonzero(lp < 0)  # elsewhere there is one edge, of log odds 0
        low, high = np.searchsorted(free, start), np.searchsorted(free, np.append(cut[1:], len(lp)))
        for r, found in zip(live.tolist(), states(lp[free], own[free], low, high, lead, keys, g.first[live], k - s)):
            open_[r] += [(_below(float(top[r]), x), s, int(own[free[j]]), (int(path[free[j]]),)) for x, j in found]
        if s:  # the states just taken, without the edges that their paths took
            spare = gumbel(uniform(again, dev[live] - g.first[live])).tolist()
            for r, z, before, j in zip(live.tolist(), spare, lead.tolist(), start.tolist()):
                v = int(dev[r])
                gone = (*barred[r], int(mine[v]))
                left = 1.0 - sum(math.exp(store.log_p[x]) for x in gone)
                if len(gone) < store.count[spot[r]] and left > 0:
                    open_[r].append((_below(float(top[r]), before - float(lp[j - 1]) + math.log(left) + z), s, v, gone))
    threshold = np.array([max((x[0] for x in o), default=-np.inf) for o in open_])
    for live, offset, ids, total, perturbed in done:
        gap = np.minimum(700.0, total - threshold[live])
        yield live, offset, ids, total, perturbed, np.where(np.isfinite(threshold[live]), -np.expm1(-np.exp(gap)), 1.0)


def _below(top: float, x: float) -> float:
    """A Gumbel draw ``x`` brought below ``top``: as if drawn on condition of not exceeding it."""
    low, high = min(-top, -x), max(-top, -x)
    return -(high + math.log1p(math.exp(low - high)))


def _unbarred(store: Store, node: int, barred: tuple, u: float) -> int:
    """An edge of a node by the odds of those that aren't barred."""
    first = int(store.at[node])
    free = [x for x in range(first, first + int(store.count[node])) if x not in barred]
    p = np.exp(store.log_p[free])
    return free[min(len(free) - 1, int(np.searchsorted(np.cumsum(p), u * p.sum(), side="right")))]


def sampled(rows: DataFrame, keys: list[str], text: str = "text", k: int = SAMPLES, seed: int = SEED, path: str | None = None) -> DataFrame:
    """``keys, sample, ids, log_p, perturbed, inclusion, decoded_same`` of every row, ``sample`` from 0."""
    small_batches(rows.sparkSession)
    path = path or default_path()
    names = [f"k{i}" for i in range(len(keys))]
    r = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names)], F.col(f"`{text}`").alias("t"))
    out_names = [*names, "sample", "ids", "log_p", "perturbed", "inclusion", "decoded_same"]

    def part(lat, b, at, texts, own):
        raw = [t.encode() for t in texts]
        for s, (live, offset, ids, lp, g, inc) in enumerate(samples(lat, texts, own, k)):
            same = _decoded(lat, [raw[i] for i in live.tolist()], offset, ids)
            kept = [b.column(i).take(pa.array(at[live], pa.int64())) for i in range(len(names))]
            cols = [pa.array(np.full(len(live), s, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(ids)), *map(pa.array, (lp, g, inc, same))]
            yield pa.RecordBatch.from_arrays([*kept, *cols], out_names)

    def emit(batches):
        lat = lattice(path)
        for b in batches:
            own = [b.column(i).to_pylist() for i in range(len(names))]
            held, size = [], 0
            texts = [t or "" for t in b.column(len(names)).to_pylist()]
            for i, t in enumerate(texts):
                held.append(i)
                size += len(t)
                if size > GROUP or i == len(texts) - 1:
                    yield from part(lat, b, np.array(held), [texts[j] for j in held], [seed_of(tuple(c[j] for c in own), seed) for j in held])
                    held, size = [], 0

    schema = ", ".join([f"{n} {r.schema[n].dataType.simpleString()}" for n in names] + ["sample int, ids array<int>, log_p double, perturbed double, inclusion double, decoded_same boolean"])
    return r.mapInArrow(emit, schema).toDF(*keys, *out_names[len(names) :])


def _decoded(lat: Lattice, raw: list[bytes], offset: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each segmentation decodes to its text in UTF-8, a space before it; all are decoded at once."""
    got, ends = lat.joined(ids)
    ends = ends[offset].tolist()
    return np.array([got[a:b] == (b" " + x if x else b"") for a, b, x in zip(ends, ends[1:], raw)], dtype=bool)
