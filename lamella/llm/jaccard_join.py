"""Exact Jaccard self-join of documents on word shingles, with signature trees.

1. Every text becomes the set of its distinct five-word shingles (64-bit
   hashes), two digests of the set and a bitmap of the set.
2. A set of ``n`` shingles is entered under its first ``n - ceil(0.75 n) +
   margin(n)`` shingles in one global order, common shingles last.  Two sets at
   0.75 or more share at least ``margin`` of the smaller size of these, so every
   link lies inside blocks of one shingle, and each set leaves the largest
   ``margin(ceil(0.75 n)) - 1`` of its blocks: at least one shared block stays.
   Blocks that a sample shows to be large are dealt over several tasks.
3. In each block all sets are compared by size and bitmap with the block's
   leader; what may link joins to provisional families.
4. Blocks that still hold several families are searched by signature trees:
   nodes hold the OR of their sets' bitmaps and their size range; two trees are
   walked together and a pair of nodes is dropped when the largest overlap its
   bitmaps allow is below the least overlap its sizes need.  What may link joins
   families; a block gives a spanning forest, not its pairs.
5. In each family the full sets meet: signature trees with wide bitmaps propose
   pairs, pairs already connected are skipped, the others are intersected, and
   again a spanning forest of true links comes out.  Families of over ``SHARD``
   sets or ``SHARD_ITEMS`` shingles are cut into shards, each with the family's
   leader; only families that then still fall apart meet in every pair of
   shards.  :func:`jaccard_links` skips no pair and counts every link.  Shingles
   are 64-bit hashes, so a false equality inside a pair has odds of about 1e-12.

Sets are told apart by 128 bits: where two share the first digest, which the
shuffles carry, the second one takes its place.  The order of shingles only
steers speed: the common ones are those seen in ``COMMON`` or more documents of
a fixed sample.  Equal texts meet as one digest.

Defined cases: null or wordless texts have an empty set and link with nothing;
texts of under five words have their whole sequence as one shingle; texts of any
length count whole, a slice at a time; repeated rows share a component; ties
have no part, as components don't depend on any order; null ids stay null and
are ignored by the minimum; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ._store import BROADCAST_ROWS, discard, materialize, small_batches, small_side
from ._words import as_bytes, shingles

K = 5
PERCENT = 75
BITS, WIDE = 512, 2048
#: Shingles from which a set's bitmap is doubled, and doubled again at each doubling of its size.
BITS_FOR = 256
SHARD, SHARD_ITEMS = 512, 1 << 20
LEAF, FAN = 8, 4
#: Sets up to which a block's pairs are compared one by one, as trees cost more than they save there.
FEW = 24
#: Bytes of bitmaps that a step of a tree walk compares at a time.
WALK_BYTES = 16 << 20
#: Size from which blocks count as equally large.
LARGE = 1 << 14
SAMPLE, COMMON, COMMON_MOST = 16, 6, 1 << 17
#: Documents of the sample from which a shingle's block is dealt over tasks, one for about as many documents.
HOT = 4096
#: Digests a Python task remembers so that it enters equal texts once.
SEEN = 200_000


def shingle_set(data: bytes, k: int = K) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, ASCII letters in lower case."""
    return np.unique(shingles(data.lower(), k))


def digests_of(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set, 0 for the empty one."""
    if not len(s):
        return 0, 0
    data = s.tobytes()
    return tuple(int(np.uint64(xxh3_64_intdigest(data, seed)).astype(np.int64)) for seed in (0, 1))


def identity(digests: tuple[int, int], clashes: frozenset[int]) -> int:
    """The first digest, or the second where different sets share the first."""
    return digests[1] if digests[0] in clashes else digests[0]


def bitmap(s: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A bit for each hash modulo ``bits``, as bytes."""
    out = np.zeros(bits, dtype=bool)
    out[(s % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out)


def level_of(n: int) -> int:
    """How often the bitmap of a set of ``n`` is doubled; sets two levels apart are too unequal to link."""
    return (n // BITS_FOR).bit_length()


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps brought to ``words`` 64-bit words: the bitmap of the same sets at that width."""
    return np.bitwise_or.reduce(sig.reshape(len(sig), -1, words), axis=1)


def margin(n: int) -> int:
    """Shingles that linked sets share in their prefixes, at least, by the smaller set's size."""
    return 1 + n // 20


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + margin(n) if n else 0


def common_shingles(docs: DataFrame, text: str, k: int = K) -> tuple[np.ndarray, dict[int, int]]:
    """At most ``COMMON_MOST`` shingles that many documents of a fixed sample hold, and the tasks to deal each of the largest over.

    The frequencies from which so few are left are found first, so that no more
    than these reach the driver from however many tasks.
    """

    def emit(batches):
        for b in batches:
            for data in as_bytes(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(data, k).view(np.int64))], ["h"])

    part = docs.filter(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).select(text)
    rows = materialize(part.mapInArrow(emit, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON), "common")
    step = F.floor(8 * F.log2("n")).cast("int")
    least, total = None, 0
    for level, n in sorted(rows.groupBy(step).count().collect(), reverse=True):
        total += n
        if total > COMMON_MOST and least is not None:
            break
        least = level
    got = rows.filter(step >= least).orderBy(F.desc("n"), "h").limit(COMMON_MOST).collect() if least is not None else []
    discard(rows)
    common = np.sort(np.array([r[0] for r in got], dtype=np.int64).view(np.uint64)) if got else np.empty(0, dtype=np.uint64)
    return common, {r[0]: 1 + r[1] // HOT for r in got if r[1] >= HOT}


def profiles(docs: DataFrame, id_col: str, text: str, k: int = K) -> tuple[DataFrame, frozenset[int]]:
    """``doc_id, digest, n, sig`` of every row, written once, and the first digests that different sets share."""

    def emit(batches):
        for b in batches:
            sets = [shingle_set(data, k) for data in as_bytes(b.column(1))]
            both = [digests_of(s) for s in sets]
            sigs = [bitmap(s, BITS << level_of(len(s))).tobytes() if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([d[i] for d in both], pa.int64()) for i in (0, 1)], pa.array([len(s) for s in sets], pa.int32()), pa.array(sigs, pa.binary())], ["doc_id", "digest", "second", "n", "sig"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    out = materialize(rows.mapInArrow(emit, "doc_id long, digest long, second long, n int, sig binary"), "profiles")
    return out, clashes_of(out)


def clashes_of(prof: DataFrame) -> frozenset[int]:
    """First digests of more than one set: about a dozen at 2e10 different sets."""
    rows = prof.groupBy("digest").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).filter("lo <> hi").select("digest")
    return frozenset(r[0] for r in rows.collect())


def identified(prof: DataFrame, clashes: frozenset[int]) -> DataFrame:
    """``prof`` with the digest that :func:`identity` gives."""
    own = F.when(F.col("digest").isin(*clashes), F.col("second")).otherwise(F.col("digest")) if clashes else F.col("digest")
    return prof.select("doc_id", own.alias("digest"), "n", "sig")


def prefix_rows(docs: DataFrame, text: str, common: np.ndarray, hot: dict[int, int], clashes: frozenset[int], k: int = K, percent: int = PERCENT) -> DataFrame:
    """``h, deal, digest``: every set's prefix shingles, ``deal`` one of the tasks of a large block."""
    late_of = docs.sparkSession.sparkContext.broadcast(common)

    def emit(batches):
        late, seen = late_of.value, set()
        many = np.array(sorted(hot), dtype=np.int64)
        tasks = np.array([hot[h] for h in many.tolist()], dtype=np.int64)
        for b in batches:
            prefixes, owners = [], []
            for data in as_bytes(b.column(0)):
                s = shingle_set(data, k)
                both = digests_of(s)
                if both in seen or not len(s):
                    continue
                if len(seen) < SEEN:
                    seen.add(both)
                p = prefix_length(len(s), percent)
                first = s[:p]
                if len(late):
                    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    common_here = late[at] == s
                    rare = s[~common_here]
                    first = rare[:p] if len(rare) >= p else np.concatenate([rare, s[common_here][: p - len(rare)]])
                prefixes.append(first)
                owners.append(identity(both, clashes))
            h = np.concatenate(prefixes).view(np.int64) if prefixes else np.empty(0, np.int64)
            d = np.repeat(np.array(owners, dtype=np.int64), [len(x) for x in prefixes])
            deal = np.zeros(len(h), dtype=np.int32)
            if len(many):
                at = np.minimum(np.searchsorted(many, h), len(many) - 1)
                large = many[at] == h
                deal[large] = d[large] % tasks[at[large]]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(deal, pa.int32()), pa.array(d, pa.int64())], ["h", "deal", "digest"])

    return docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(emit, "h long, deal int, digest long")


def _shared_blocks(batches, dealt: frozenset[int] = frozenset()):
    """Sorted (h, digest) rows to the rows of blocks with two digests or more, with the block's first digest and its size, at most ``LARGE``.

    Of blocks ``dealt`` over tasks all rows are given out, as of that size.
    """
    spread = np.array(sorted(dealt), dtype=np.int64)

    def rows(h, d, lead, size):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, d, lead, size)], ["h", "digest", "leader", "size"])

    def finished(h, d):
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(h)))
        lead, size = np.repeat(d[first], size), np.repeat(size, size)
        if len(spread):
            size = np.where(np.isin(h, spread), LARGE, size)
        many = size > 1
        return rows(h[many], d[many], lead[many], np.minimum(size[many], LARGE))

    h, d = np.empty(0, np.int64), np.empty(0, np.int64)
    large = None  # hash, leader and last digest of a block of which LARGE rows have been given out
    for b in batches:
        h, d = np.concatenate([h, b.column(0).to_numpy()]), np.concatenate([d, b.column(1).to_numpy()])
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        if large and len(h):
            keep[0] = (h[0], d[0]) != large[::2]
        h, d = h[keep], d[keep]
        if large and len(h):
            own = int(np.searchsorted(h, large[0], "right"))
            if own:
                yield rows(h[:own], d[:own], np.full(own, large[1]), np.full(own, LARGE))
                large = *large[:2], d[own - 1]
                h, d = h[own:], d[own:]
        if not len(h):
            continue
        open_at = int(np.searchsorted(h, h[-1]))
        yield finished(h[:open_at], d[:open_at])
        h, d, large = h[open_at:], d[open_at:], large if not open_at and large and h[0] == large[0] else None
        if len(h) >= LARGE:
            yield rows(h, d, np.full(len(h), d[0]), np.full(len(h), LARGE))
            large = h[0], d[0], d[-1]
            h, d = h[:0], d[:0]
    yield finished(h, d)


def entries_of(rows: DataFrame, prof: DataFrame, hot: dict[int, int], percent: int = PERCENT) -> DataFrame:
    """``h, digest, leader`` of the blocks in which different sets that can link meet; written once.

    Linked sets share ``margin`` prefix shingles of the smaller one, so each set
    may leave its largest blocks, one fewer than that, by one order of all
    blocks: what two linked sets leave of their shared blocks is the first of
    them in that order, never all.
    """
    dealt = frozenset(hot)
    # At most COMMON_MOST rows of two numbers.
    hot_parts = F.broadcast(materialize(prof.sparkSession.createDataFrame([(int(h), int(n)) for h, n in hot.items()], "h long, parts long"), "hot")) if hot else None

    def shared(part: DataFrame, unused: str) -> DataFrame:
        part = part.repartition("h", "deal").sortWithinPartitions("h", "digest").select("h", "digest")
        return materialize(part.mapInArrow(lambda batches: _shared_blocks(batches, dealt), "h long, digest long, leader long, size long").drop(unused), "blocks")

    blocks = shared(rows, "leader")
    sizes = prof.filter("n > 0").groupBy("digest").agg(F.min("n").alias("n"))
    spare = F.floor(F.ceil(F.col("n") * percent / 100) / 20)
    place = F.row_number().over(Window.partitionBy("digest").orderBy(F.desc("size"), "h"))
    kept = blocks.join(sizes, "digest").withColumn("place", place).filter(F.col("place") > spare)
    if hot:
        kept = kept.join(hot_parts, "h", "left").withColumn("deal", F.pmod("digest", F.coalesce("parts", F.lit(1))).cast("int"))
    else:
        kept = kept.withColumn("deal", F.lit(0))
    out = shared(kept.select("h", "deal", "digest"), "size")
    discard(blocks)
    return out


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def needed(na, nb, percent: int = PERCENT):
    """Least overlap of sets of these sizes that link."""
    return -(-percent * (na + nb) // (100 + percent))


def _plausible(batches, percent: int = PERCENT):
    """Pairs whose sizes and bitmaps allow a link."""
    for b in batches:
        na, nb = b.column(2).to_numpy().astype(np.int64), b.column(4).to_numpy().astype(np.int64)
        sa, sb = b.column(3).to_pylist(), b.column(5).to_pylist()
        ok = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
        widths = np.array([(len(x), len(y)) for x, y in zip(sa, sb)], dtype=np.int64).reshape(-1, 2)
        for w in np.unique(widths[ok], axis=0):
            at = np.flatnonzero(ok & (widths == w).all(axis=1))
            words = int(w.min()) // 8
            x, y = (folded(np.frombuffer(b"".join([c[i] for i in at]), dtype=np.uint64).reshape(len(at), -1), words) for c in (sa, sb))
            spare = np.minimum(na[at] - _popcount(x), nb[at] - _popcount(y))
            ok[at] = _popcount(x & y) + spare >= needed(na[at], nb[at], percent)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["a", "b"])


def plausible(pairs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that sizes and bitmaps allow to link."""
    a = reps.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = reps.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(lambda batches: _plausible(batches, percent), "a long, b long")


class Tree:
    """A signature tree over sets sorted by size: level 0 holds leaves of ``LEAF`` sets, each level above the OR of ``FAN`` nodes."""

    def __init__(self, n: np.ndarray, sig: np.ndarray, comp: np.ndarray, digest: np.ndarray) -> None:
        order = np.lexsort((digest, comp, n))
        self.n, self.sig, self.comp, self.digest = n[order], sig[order], comp[order], digest[order]
        spare = self.n - _popcount(self.sig)
        cut = np.arange(0, len(n), LEAF)
        self.levels = [self._node(cut, self.sig, self.n, self.n, spare, self.comp, self.comp)]
        while len(self.levels[-1][0]) > 1:
            sig_, lo, hi, sp, c0, c1 = self.levels[-1]
            self.levels.append(self._node(np.arange(0, len(lo), FAN), sig_, lo, hi, sp, c0, c1))

    @staticmethod
    def _node(cut, sig, lo, hi, spare, c0, c1):
        return np.bitwise_or.reduceat(sig, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(spare, cut), np.minimum.reduceat(c0, cut), np.maximum.reduceat(c1, cut)


def traverse(x: Tree, y: Tree, percent: int = PERCENT):
    """Places (in ``x``, in ``y``) of pairs that no bound excludes and whose components differ, a part at a time."""
    a, b = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    lx, ly = len(x.levels) - 1, len(y.levels) - 1
    while True:
        ok = _allowed(x.levels[lx], a, y.levels[ly], b, percent)
        if x is y and lx == ly:
            ok &= a <= b
        a, b = a[ok], b[ok]
        if not len(a) or not lx and not ly:
            break
        if lx and lx >= ly:
            a, b = _down(a, b, FAN, len(x.levels[lx - 1][0]))
            lx -= 1
            if x is y and ly > lx:
                b, a = _down(b, a, FAN, len(y.levels[ly - 1][0]))
                ly -= 1
        else:
            b, a = _down(b, a, FAN, len(y.levels[ly - 1][0]))
            ly -= 1
    a, b = _down(a, b, LEAF, len(x.n))
    b, a = _down(b, a, LEAF, len(y.n))
    if x is y:
        a, b = a[a < b], b[a < b]
    own = [(t.sig, t.n, t.n, t.n - _popcount(t.sig), t.comp, t.comp) for t in (x, y)]
    for k in range(0, len(a), 1 << 15):
        i, j = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
        ok = _allowed(own[0], i, own[1], j, percent)
        yield i[ok], j[ok]


def _allowed(X, a, Y, b, percent):
    """Whether rows ``a`` of nodes ``X`` and ``b`` of ``Y`` may hold a link, ``WALK_BYTES`` of bitmaps at a time."""
    out = np.empty(len(a), dtype=bool)
    step = max(1, WALK_BYTES // max(1, X[0].shape[1] * 8))
    for k in range(0, len(a), step):
        A, B = [v[a[k : k + step]] for v in X], [v[b[k : k + step]] for v in Y]
        most = _popcount(A[0] & B[0]) + np.minimum(A[3], B[3])
        same = (A[4] == A[5]) & (B[4] == B[5]) & (A[4] == B[4])
        out[k : k + step] = (most >= needed(A[1], B[1], percent)) & (100 * A[2] >= percent * B[1]) & (100 * B[2] >= percent * A[1]) & ~same
    return out


def _down(a, b, fan, most):
    a = (a[:, None] * fan + np.arange(fan)).ravel()
    b = np.repeat(b, fan)
    ok = a < most
    return a[ok], b[ok]


class Forest:
    """Union-find over any keys."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def join(self, x, y) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[x] = y
        return True


def _grouped(batches, n_cols: int, work):
    """Rows sorted by (group, i, j) to ``work(i == j, rows of side 0, rows of side 1)``, whose (a, b) pairs are given out."""

    def run(key, rows):
        left, right = [r[1:] for r in rows if r[0] == 0], [r[1:] for r in rows if r[0] == 1]
        if key[1] != key[2] and not (left and right):
            return
        if pairs := work(key[1] == key[2], left, right):
            a, b = zip(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held, key = [], None
    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in range(n_cols)]):
            if row[:3] != key:
                if held:
                    yield from run(key, held)
                held, key = [], row[:3]
            held.append(row[3:])
    if held:
        yield from run(key, held)


def sharded(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``shards`` (shards of their group) dealt to all pairs of these, sorted for :func:`_grouped`."""
    r = rows.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("shards")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    r = r.select(F.col(group).alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), *columns)
    return r.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


def with_leader(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``shards``, each in one shard of its family ``comp`` and the leader (the digest ``comp``) in all, sorted for :func:`_grouped`."""
    own = F.pmod(F.xxhash64("digest"), F.col("shards")).cast("int")
    r = rows.withColumn("i", F.explode(F.when(F.col("digest") == F.col("comp"), F.sequence(F.lit(0), F.col("shards") - 1)).otherwise(F.array(own))))
    r = r.select(F.col("comp").alias("g"), "i", F.col("i").alias("j"), F.lit(0).alias("side"), *columns)
    return r.repartition("g", "i").sortWithinPartitions("g", "i", "j")


def _few_forest(rows, percent: int = PERCENT) -> list:
    """:func:`_plausible_forest` of few rows, by the same bounds."""
    sets = sorted((n, digest, comp, 8 * len(sig), int.from_bytes(sig, "little")) for digest, n, sig, comp in rows)
    forest, out = Forest(), []
    for i, (na, a, ca, wa, va) in enumerate(sets):
        for nb, b, cb, wb, vb in sets[i + 1 :]:
            if 100 * na < percent * nb:
                break
            if ca == cb:
                continue
            x, y, narrow, wide = (va, vb, wa, wb) if wa <= wb else (vb, va, wb, wa)
            while wide > narrow:
                wide //= 2
                y = y >> wide | y & ((1 << wide) - 1)
            m, n = (na, nb) if wa <= wb else (nb, na)
            if (x & y).bit_count() + min(m - x.bit_count(), n - y.bit_count()) >= needed(na, nb, percent) and forest.join(ca, cb):
                out.append((a, b))
    return out


def _plausible_forest(same: bool, left, right, percent: int = PERCENT) -> list:
    """Block work on rows (digest, n, sig, comp)."""
    if same and len(left) <= FEW:
        return _few_forest(left, percent)

    def levels(part) -> dict[int, tuple]:
        by: dict[int, list] = {}
        for row in part:
            by.setdefault(level_of(row[1]), []).append(row)
        out = {}
        for level, rows in by.items():
            digest, n, sig, comp = zip(*rows)
            out[level] = np.array(n, dtype=np.int64), np.frombuffer(b"".join(sig), dtype=np.uint64).reshape(len(n), -1), np.array(comp), np.array(digest)
        return out

    def tree(x: tuple, level: int) -> Tree:
        return Tree(x[0], folded(x[1], (BITS << level) // 64), *x[2:])

    a_side = levels(left)
    b_side = a_side if same else levels(right)
    forest, out = Forest(), []
    for k, part in a_side.items():
        for m in (k, k + 1) if same else (k - 1, k, k + 1):
            if m not in b_side:
                continue
            x = tree(part, min(k, m))
            y = x if same and m == k else tree(b_side[m], min(k, m))
            for i, j in traverse(x, y, percent):
                for a, b, c, d in zip(x.digest[i].tolist(), y.digest[j].tolist(), x.comp[i].tolist(), y.comp[j].tolist()):
                    if forest.join(c, d):
                        out.append((a, b))
    return out


def searched(blocks: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A spanning forest of what may link in ``blocks`` (``h, digest, comp, members``), by dual traversal of signature trees."""
    rows = sharded(blocks.join(reps.select("digest", "n", "sig"), "digest").withColumn("shards", F.ceil(F.col("members") / SHARD).cast("int")), "h", ["digest", "n", "sig", "comp"])
    return rows.mapInArrow(lambda batches: _grouped(batches, 8, partial(_plausible_forest, percent=percent)), "a long, b long").distinct()


def _family_pairs(left, right, same: bool, percent: int, comp: dict, skip):
    """Digests of the true links in family rows (digest, items, ...), without the pairs of one ``comp`` and those that ``skip`` holds for."""

    def tree(part, wide):
        part = sorted({r[0]: r[1] for r in part}.items())
        sets = [np.frombuffer(x, dtype=np.uint64) for _, x in part]
        sig = np.stack([bitmap(x, wide) for x in sets]).view(np.uint64)
        digest = np.array([d for d, _ in part])
        return Tree(np.array([len(x) for x in sets], dtype=np.int64), sig, np.array([comp.get(d, d) for d, _ in part]), digest), dict(zip(digest.tolist(), sets))

    wide = WIDE << min(7, level_of(max(len(r[1]) // 8 for r in left + right)))
    x, sets = tree(left, wide)
    y = x
    if not same:
        y, more = tree(right, wide)
        sets = sets | more
    for i, j in traverse(x, y, percent):
        for a, b in zip(x.digest[i].tolist(), y.digest[j].tolist()):
            if not skip(a, b):
                s, t = sets[a], sets[b]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    yield a, b


def _true_forest(same: bool, left, right, percent: int = PERCENT) -> list:
    """Family work on rows (digest, items), or (digest, items, comp) where links inside a ``comp`` are known: a spanning forest."""
    comp = {r[0]: r[2] for r in left + right if len(r) > 2}
    forest, out, of = Forest(), [], lambda d: comp.get(d, d)
    for a, b in _family_pairs(left, right, same, percent, comp, lambda a, b: forest.root(of(a)) == forest.root(of(b))):
        forest.join(of(a), of(b))
        out.append((a, b))
    return out


def _true_counts(same: bool, left, right, percent: int = PERCENT) -> list:
    """Family work on rows (digest, items, copies): every link, counted for each digest by the other one's copies."""
    copies = {r[0]: r[2] for r in left + right}
    out: dict = {}
    for a, b in _family_pairs(left, right, same, percent, {}, lambda a, b: False):
        out[a] = out.get(a, 0) + copies[b]
        out[b] = out.get(b, 0) + copies[a]
    return list(out.items())


def _key(c):
    return F.coalesce(c.cast("long"), F.lit(-(1 << 63)))


def sized(members: DataFrame) -> DataFrame:
    """``members`` (``comp``, ``n``, ...) with the ``shards`` of their family; only families of several shards are joined."""
    shards = F.greatest(F.ceil(F.count(F.lit(1)) / SHARD), F.ceil(F.sum("n") / SHARD_ITEMS)).cast("int")
    large = small_side(members.groupBy("comp").agg(shards.alias("shards")).filter("shards > 1"))
    return members.join(large, "comp", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))


def with_items(docs: DataFrame, id_col: str, text: str, wanted: DataFrame, k: int, clashes: frozenset[int]) -> DataFrame:
    """``wanted`` (``key, digest, comp, shards`` and at most one more long), written here, with the shingles of its texts as ``items``."""
    more = [c for c in wanted.columns if c not in ("key", "digest", "comp", "shards")]
    wanted = materialize(wanted.select("key", "digest", "comp", "shards", *more), "needed")

    def emit(batches):
        for b in batches:
            want = b.column(0).to_pylist()
            sets = [shingle_set(data, k) for data in as_bytes(b.column(3))]
            ok = pa.array([identity(digests_of(s), clashes) == d for s, d in zip(sets, want)], pa.bool_())
            items = pa.array([s.tobytes() for s in sets], pa.binary())
            cols = [b.column(0), b.column(1), b.column(2), items, *[b.column(4 + c) for c in range(len(more))]]
            yield pa.RecordBatch.from_arrays([x.filter(ok) for x in cols], ["digest", "comp", "shards", "items", *more])

    rows = docs.select(_key(F.col(f"`{id_col}`")).alias("key"), F.col(f"`{text}`").alias("t")).join(small_side(wanted), "key").select("digest", "comp", "shards", "t", *more)
    return rows.mapInArrow(emit, "digest long, comp long, shards int, items binary" + "".join(f", {c} long" for c in more))


def linked(docs: DataFrame, id_col: str, text: str, members: DataFrame, k: int, percent: int, clashes: frozenset[int]) -> DataFrame:
    """A spanning forest of the true links in each family of ``members`` (``key, digest, comp, n, shards``)."""
    forest = partial(_true_forest, percent=percent)
    rows = with_leader(with_items(docs, id_col, text, members.drop("n"), k, clashes), ["digest", "items"])
    links = materialize(rows.mapInArrow(lambda batches: _grouped(batches, 6, forest), "a long, b long"), "links")
    large = members.filter("shards > 1")
    if large.isEmpty():
        return links
    apart = large.join(components(links).withColumnRenamed("comp", "known"), "digest", "left").withColumn("known", F.coalesce("known", "digest"))
    apart = materialize(apart, "apart")
    torn = apart.groupBy("comp").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).filter("lo <> hi").select("comp")
    apart = apart.join(small_side(torn), "comp", "left_semi")
    rows = sharded(with_items(docs, id_col, text, apart.drop("n"), k, clashes), "comp", ["digest", "items", "known"])
    more = materialize(rows.mapInArrow(lambda batches: _grouped(batches, 7, forest), "a long, b long"), "links")
    return links.union(more)


def components(links: DataFrame) -> DataFrame:
    """``digest, comp`` of every linked digest, ``comp`` the smallest in reach; alternating large and small stars until nothing changes.

    Each round is written to the shared folder.  Minima are aggregated before
    they are shuffled, so a digest with very many links needs no large group;
    they are broadcast while the counted edges are few, and beyond that adaptive
    execution splits the edges of such a digest.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = edges.count(), None
    while True:
        near = F.broadcast if 2 * state[0] <= BROADCAST_ROWS else lambda df: df
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(near(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v")))
        before, edges = edges, materialize(small.distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        discard(before)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("digest"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("digest"), F.col("v").alias("comp")).union(roots)


def _families_of(docs: DataFrame, id_col: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """Profiles, the members of families (``key, digest, comp, n, shards``, a document for each digest that may link) and the digests' clashes."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    whole, clashes = profiles(docs, id_col, text, k)
    prof = identified(whole, clashes)
    common, hot = common_shingles(docs, text, k)
    entries = entries_of(prefix_rows(docs, text, common, hot, clashes, k, percent), prof, hot, percent)
    reps = prof.filter("n > 0").groupBy("digest").agg(F.min(_key(F.col("doc_id"))).alias("key"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = materialize(reps.join(entries.select("digest").distinct(), "digest", "left_semi"), "reps")
    stars = entries.filter("leader <> digest").select(F.col("leader").alias("a"), F.col("digest").alias("b")).distinct()
    edges = materialize(plausible(stars, reps, percent), "pairs")
    placed = entries.select("h", "digest").join(components(edges), "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    placed = materialize(placed, "placed")
    discard(entries)
    mixed = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members")).filter("lo <> hi").select("h", "members")
    more = materialize(searched(placed.join(mixed, "h"), reps, percent), "pairs")
    discard(placed)
    members = materialize(components(edges.union(more)).join(reps.select("digest", "key", "n"), "digest"), "families")
    for done in (edges, more, reps):
        discard(done)
    return prof, sized(members), clashes


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id``."""
    prof, members, clashes = _families_of(docs, id_col, text, k, percent)
    return membership(prof, components(linked(docs, id_col, text, members, k, percent, clashes)))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, n_links``, the other rows that it links with directly.

    All plausible pairs inside the families are verified, none skipped; equal
    sets are one digest and count by their copies, repeated rows each.
    """
    prof, members, clashes = _families_of(docs, id_col, text, k, percent)
    copies = materialize(prof.filter("n > 0").groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "copies")
    rows = sharded(with_items(docs, id_col, text, members.drop("n").join(copies, "digest"), k, clashes), "comp", ["digest", "items", "copies"])
    counts = rows.mapInArrow(lambda batches: _grouped(batches, 7, partial(_true_counts, percent=percent)), "a long, b long")
    counts = counts.groupBy(F.col("a").alias("digest")).agg(F.sum("b").alias("others"))
    by_digest = copies.join(counts, "digest", "left").select("digest", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    by_digest = small_side(materialize(by_digest.filter("n_links > 0"), "counts"))
    out = prof.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    return out.join(by_digest, "digest", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def membership(prof: DataFrame, comps: DataFrame) -> DataFrame:
    """Each document with the smallest document id of its component; only digests of several documents are joined."""
    least = prof.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies")).join(comps, "digest", "left")
    least = materialize(least.filter("copies > 1 or comp is not null").select("digest", "doc", F.coalesce("comp", "digest").alias("comp")), "least")
    ids = small_side(least.groupBy("comp").agg(F.min("doc").alias("component_id")))
    classes = small_side(materialize(least.join(ids, "comp").select("digest", "component_id"), "classes"))
    out = prof.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    return out.join(classes, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that link, directly or not, to one of smaller id; repeated rows of one id stay once."""
    out = jaccard_components(docs, id_col, **options)
    own = F.col(f"`{id_col}`")
    gone = materialize(out.filter("component_id <> doc_id").select("doc_id").distinct(), "gone").withColumnRenamed("doc_id", "_gone")
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.cast("long").alias("id"))
    kept = kept.join(small_side(gone), F.col("id") == F.col("_gone"), "left_anti")
    total, ids = out.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if total != ids:
        kept = kept.filter("id is null").union(kept.filter("id is not null").dropDuplicates(["id"]))
    return kept.select("row.*")
