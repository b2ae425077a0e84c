"""Exact similarity joins on distinct words by groups of rare words.

Null texts count as empty and, like texts without words, pair with nothing; rows
of equal keys pair with each other's partners; rows of a null block pair with
nothing; ties have no part, as pairs don't depend on any order; columns may have
any names.  Words are compared by their 64-bit hashes.

Rows with the same words are one class: :func:`classes` gives each row the first
key of its class, and :func:`class_pairs` the pairs between those, so copies cost no
pairs.  :func:`candidates` gives the pairs of the rows themselves, m (m - 1) / 2 for m
texts alike, and so does :func:`row_pairs`, which looks for pairs between classes alone and
writes them out for all members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lamella.storage import cut, near, shuffled

#: Bins of words whose frequency is broadcast, a byte each; results don't depend on it.
BINS = 1 << 22
#: Words of texts, or bytes of one, that a Python task works on at a time.
SLICE = 1 << 18
#: Rows whose sets a task holds to verify pairs, about.
TILE = 512


def word_set(data: bytes) -> np.ndarray:
    """The distinct words' hashes, sorted; a long text goes by slices that end at white space."""
    out, at = np.empty(0, dtype=np.uint64), 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = set(data[at:end].split())
        part = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        out = np.union1d(out, part) if at else np.unique(part)
        at = end
    return out


def word_sets(batch: pa.RecordBatch, content: int, bare: bool = False) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Row numbers and word sets of the rows with words, about :data:`SLICE` words at a time; with ``bare`` texts without words, too."""
    at, sets, n = [], [], 0
    for i, text in enumerate(batch.column(content)):
        s = word_set((text.as_py() or "").encode())
        if len(s) or bare and text.is_valid:
            at.append(i)
            sets.append(s)
            n += len(s) + 1
        if n >= SLICE:
            yield at, sets
            at, sets, n = [], [], 0
    if at:
        yield at, sets


def _taken(batch: pa.RecordBatch, columns: int, at, **more) -> pa.RecordBatch:
    """The first ``columns`` of ``batch`` in rows ``at``, and ``more``."""
    at = pa.array(at, pa.int64())
    return pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(columns)], *more.values()], [*batch.schema.names[:columns], *more])


def frequencies(rows: DataFrame) -> np.ndarray:
    """How frequent the words of ``rows`` (one text column) are, in steps of a third of a doubling, by :data:`BINS` of their hashes.

    The order of words that follows only steers speed: words of a bin count together.
    """

    def emit(batches):
        n = np.zeros(BINS, dtype=np.int64)
        for b in batches:
            for _, sets in word_sets(b, 0):
                np.add.at(n, _bin(np.concatenate(sets)), 1)
        at = np.flatnonzero(n)
        for k in range(0, len(at), SLICE):
            i = at[k : k + SLICE]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(n[i])], ["bin", "n"])

    got = rows.mapInArrow(emit, "bin int, n long").groupBy("bin").agg(F.floor(3 * F.log2(F.sum("n"))).cast("tinyint").alias("step")).toArrow()
    out = np.zeros(BINS, dtype=np.int8)
    out[got.column("bin").to_numpy()] = got.column("step").to_numpy()
    return out


def _bin(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(20)).astype(np.int64) & (BINS - 1)


def group_count(n: np.ndarray, percent: int) -> np.ndarray:
    """Groups that the rare words of two sets are dealt to, by the smaller set's size; 0: one shared word must do.

    The sets share at least ``ceil(percent n / 100)`` words, and one more than there are groups is asked of them.
    """
    most = np.minimum(np.maximum(1, n * (100 - percent) // 100), -(-percent * n // 100) - 1)
    return np.where(most < 1, 0, 1 << np.int64(np.log2(np.maximum(most, 1))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def entries(sets: list[np.ndarray], often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and the places in ``sets`` that they belong to; sets at ``percent`` or more have a key in common.

    In one order of all words, rare ones first, two sets at the threshold share
    ``m`` of their first ``n - ceil(percent n / 100) + m`` words, whatever ``m`` up to what they share
    at least.  With ``m`` one more than the groups that a word's hash deals these words to, two
    shared words fall into one group: a key is two words of a group.  The number of groups
    follows the smaller set, so a set is entered for each number that its partners may have.
    """
    n = np.array([len(s) for s in sets])
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.lexsort((flat, often[_bin(flat)], own))
    flat, place = flat[order], np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    low, high = group_count(-(-percent * n // 100), percent), group_count(n, percent)
    keys, owners = [], []
    for g in sorted({0, *(1 << np.arange(int(high.max()).bit_length())).tolist()}):
        here = (low <= g) & (g <= high)
        if not here.any():
            continue
        first = np.where(here, n - -(-percent * n // 100) + g + 1, 0)
        keep = place < np.repeat(first, n)
        t, o = flat[keep], own[keep]
        if not g:
            keys.append(_mixed(t))
            owners.append(o)
            continue
        group = (t & np.uint64(g - 1)).astype(np.int64)
        order = np.lexsort((t, group, o))
        t, o, group = t[order], o[order], group[order]
        i = np.arange(len(t))
        lag = 1
        while len(i := i[i + lag < len(t)]):
            i = i[(o[i] == o[i + lag]) & (group[i] == group[i + lag])]
            keys.append(_mixed(t[i] + _mixed(t[i + lag] + np.uint64(g))))
            owners.append(o[i])
            lag += 1
    return np.concatenate(keys), np.concatenate(owners)


def candidates(rows: DataFrame, key: str, content: str, block: str, percent: int = 80, side: str | None = None) -> DataFrame:
    """Pairs in a block (``a, b, both, na, nb``) with Jaccard of distinct words of at least ``percent``.

    Rows meet where they share a key of :func:`entries`, two rare words of a group,
    which random texts seldom do; only keys are shuffled.  For these pairs the sets'
    bitmaps meet, and the sets for the pairs that are left then.  With ``side`` only rows
    of different sides pair, ``a`` from the smaller one.
    """
    col = lambda c: F.col(f"`{c}`")
    d = rows.select(col(key).alias("k"), col(block).alias("blk"), (col(side) if side else F.lit(0)).alias("side"), col(content).alias("t")).filter("blk is not null and t is not null")
    known = rows.sparkSession.sparkContext.broadcast(frequencies(d.select("t")))
    typed = {c: t for c, t in d.dtypes}

    def emit(batches):
        for b in batches:
            for at, sets in word_sets(b, 3):
                keys, own = entries(sets, known.value, percent)
                n = np.array([len(s) for s in sets], dtype=np.int32)
                yield _taken(b, 3, np.array(at)[own], n=pa.array(n[own]), h=pa.array(keys.view(np.int64)))

    met = d.mapInArrow(emit, f"k {typed['k']}, blk {typed['blk']}, side {typed['side']}, n int, h long").select("k", "side", "n", F.xxhash64("h", "blk").alias("h"))
    a, b = (met.select("h", *[F.col(c).alias(f"{c}{x}") for c in ("side", "k", "n")]) for x in "ab")
    order = F.col("sidea") < F.col("sideb") if side else F.col("ka") < F.col("kb")
    sized = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & order
    pairs = cut(a.hint("merge").join(b, "h").filter(sized).select(F.col("ka").alias("a"), F.col("kb").alias("b")).distinct(), "pairs")
    likely = cut(met_in_buckets(pairs, d, bitmap, partial(_likely, percent), bool(side)).select("a", "b").distinct(), "likely")
    return met_in_buckets(likely, d, np.ndarray.tobytes, partial(_alike, percent), bool(side))


def bitmap(words: np.ndarray) -> bytes:
    """The size of a set, and a bit for each word modulo a power of two of at least one and a half times the size."""
    bits = np.zeros(max(512, 1 << int(3 * len(words) // 2).bit_length()), dtype=bool)
    bits[(words & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return len(words).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def _likely(percent: int, x: bytes, y: bytes) -> tuple | None:
    """Zeros if sizes and bitmaps allow two sets to be at ``percent``: the wider bitmap is folded to the other's width."""
    (m, v), (n, w) = ((int.from_bytes(z[:8], "little"), int.from_bytes(z[8:], "little")) for z in (x, y))
    wide, narrow = 8 * (len(x) - 8), 8 * (len(y) - 8)
    if wide < narrow:
        m, v, n, w, wide, narrow = n, w, m, v, narrow, wide
    while wide > narrow:
        wide //= 2
        v = v >> wide | v & ((1 << wide) - 1)
    most = (v & w).bit_count() + min(m - v.bit_count(), n - w.bit_count())
    return (0, 0, 0) if 100 * min(m, n) >= percent * max(m, n) and (100 + percent) * most >= percent * (m + n) else None


def _alike(percent: int, x: bytes, y: bytes) -> tuple | None:
    """Shared words and sizes of two sets at ``percent`` or more."""
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return (both, len(x), len(y)) if 100 * both >= percent * (len(x) + len(y) - both) else None


def tiled(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the ``bucket`` in which each is verified: alike texts in one, at most about ``2 * TILE`` of them from one group of texts alike.

    A row's group is its least partner, so rows that all pair with each other are one group; a
    group's pairs go to tiles, and tiles to buckets of about :data:`TILE` rows.
    """
    ends = pairs.select(F.col("a").alias("k"), F.least("a", "b").alias("m")).union(pairs.select("b", F.least("a", "b")))
    group = cut(ends.groupBy("k").agg(F.min("m").alias("group")), "groups")
    buckets = max(1, group.count() // TILE)
    large = near(cut(group.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("shards")).filter("shards > 1"), "large"))
    out = pairs.join(group.withColumnRenamed("k", "a"), "a").join(large, "group", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    i, j = (F.pmod(F.xxhash64(x), F.col("shards")) for x in "ab")
    return out.select("a", "b", F.pmod(F.xxhash64("group", F.least(i, j), F.greatest(i, j)), F.lit(buckets)).cast("int").alias("bucket"))


def met_in_buckets(pairs: DataFrame, d: DataFrame, form: Callable[[np.ndarray], bytes], judge: Callable[[bytes, bytes], tuple | None], sides: bool) -> DataFrame:
    """``a, b, both, na, nb`` of those ``pairs`` of rows ``d`` (``k, blk, side, t``) for whose sets, in ``form``, ``judge`` has numbers.

    A bucket gets a row's set once, however many of its pairs the row is in.
    """
    kind = dict(d.dtypes)
    tiles = cut(tiled(pairs), "tiles")
    places = tiles.select(F.col("a").alias("_k"), "bucket").union(tiles.select("b", "bucket")).groupBy("_k").agg(F.collect_set("bucket").alias("buckets"))
    places = near(cut(places, "places"))

    def sets_of(batches):
        for b in batches:
            for at, sets in word_sets(b, 4):
                yield _taken(b, 4, at, w=pa.array([form(x) for x in sets], pa.binary()))

    found = d.join(places, F.col("k") == F.col("_k")).select("k", "blk", "side", "buckets", "t")
    found = found.mapInArrow(sets_of, f"k {kind['k']}, blk {kind['blk']}, side {kind['side']}, buckets array<int>, w binary").withColumn("bucket", F.explode("buckets")).drop("buckets")
    plain = lambda x: tuple(x.values()) if isinstance(x, dict) else x

    def work(found: pa.Table, tiles: pa.Table) -> pa.Table:
        rows: dict = {}
        for k, *row in zip(*[found.column(c).to_pylist() for c in ("k", "blk", "side", "w")]):
            rows.setdefault(plain(k), []).append(row)
        out = []
        for i, (a, b) in enumerate(zip(tiles.column("a").to_pylist(), tiles.column("b").to_pylist())):
            for blk, side, x in rows[plain(a)]:
                for other, opposite, y in rows[plain(b)]:
                    if blk == other and (not sides or side < opposite) and (got := judge(x, y)):
                        out.append((i, *got))
        at, *numbers = (pa.array([r[c] for r in out], pa.int32()) for c in range(4))
        return pa.table([tiles.column("a").take(at), tiles.column("b").take(at), *numbers], ["a", "b", "both", "na", "nb"])

    return found.groupBy("bucket").cogroup(tiles.groupBy("bucket")).applyInArrow(work, f"a {kind['k']}, b {kind['k']}, both int, na int, nb int")


#: Classes of more rows than the others by this much of the table are broadcast; so few exist.
HEAVY = 10_000


def classes(rows: DataFrame, key: str, content: str, block: str) -> DataFrame:
    """``key, representative``: each row with words and the least key of its block with the same words."""
    return _classed(rows, key, content, block).select(F.col("k").alias(key), F.col("rep").alias("representative"))


def _classed(rows: DataFrame, key: str, content: str, block: str, bare: bool = False) -> DataFrame:
    """``k, rep, blk, n``: the rows of :func:`classes` with the size of their word set; with ``bare`` texts without words are a class, too."""
    col = lambda c: F.col(f"`{c}`")
    d = rows.select(col(key).alias("k"), col(block).alias("blk"), col(content).alias("t"))

    def digests(batches):
        for b in batches:
            for at, sets in word_sets(b, 2, bare):
                h = [pa.array(np.array([xxh3_64_intdigest(s.tobytes(), seed) for s in sets], dtype=np.uint64).view(np.int64)) for seed in (0, 1)]
                yield _taken(b, 2, at, h=h[0], h2=h[1], n=pa.array([len(s) for s in sets], pa.int32()))

    d = cut(d.mapInArrow(digests, f"k {dict(d.dtypes)['k']}, blk {dict(d.dtypes)['blk']}, h long, h2 long, n int"), "classes")
    found = d.groupBy("blk", "h", "h2", "n").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    found = cut(found, "classes")
    bound = max(1000, d.count() // HEAVY)
    other = found.select(*[F.col(c).alias(f"_{c}") for c in ("blk", "h", "h2", "n", "rep", "m")])
    same = F.col("blk").eqNullSafe(F.col("_blk")) & (F.col("h") == F.col("_h")) & (F.col("h2") == F.col("_h2")) & (F.col("n") == F.col("_n"))
    first = d.join(F.broadcast(other.filter(F.col("_m") > bound)), same, "left").select(*d.columns, F.col("_rep").alias("large"))
    met = first.filter("large is not null").select("k", F.col("large").alias("rep"), "blk", "n")
    rest = first.filter("large is null").drop("large").join(other.filter(F.col("_m") <= bound), same, "left")
    return met.union(rest.select("k", F.coalesce("_rep", "k").alias("rep"), "blk", "n"))


def class_pairs(rows: DataFrame, key: str, content: str, block: str, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The rows' classes, and :func:`candidates` between their representatives."""
    members = cut(classes(rows, key, content, block), "members")
    return members, _between(rows, members.select(F.col(f"`{key}`").alias("k"), F.col("representative").alias("rep")), key, content, block, percent)


def _between(rows: DataFrame, members: DataFrame, key: str, content: str, block: str, percent: int) -> DataFrame:
    others = near(cut(members.filter("k <> rep").select(F.col("k").alias("_other")), "others"))
    firsts = rows.join(others, rows[f"`{key}`"] == others["_other"], "left_anti")
    return candidates(firsts, key, content, block, percent)


def row_pairs(rows: DataFrame, key: str, content: str, block: str, percent: int = 80) -> DataFrame:
    """The pairs of :func:`candidates` of rows with unique keys, and those of texts without words in a block, which are alike with nothing shared.

    Classes of copies are told first, and pairs looked for between their
    representatives.  A class's keys go to tiles of about :data:`TILE`, so a pair of classes, or a class
    and itself, is a row for each two tiles until it is written out, and a large class
    goes over many tasks.
    """
    members = cut(_classed(rows, key, content, block, bare=True), "members").filter("blk is not null")
    sizes = cut(members.groupBy("rep").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("n")).filter("m > 1").select("rep", F.ceil(F.col("m") / TILE).cast("int").alias("shards"), "n"), "sizes")
    shard = F.pmod(F.xxhash64("k"), F.col("shards")).cast("int")
    tiles = cut(members.join(near(sizes), "rep").groupBy("rep", shard.alias("shard")).agg(F.collect_list("k").alias("keys")), "copies")
    pairs = cut(_between(rows, members, key, content, block, percent), "between")
    for c in "ab":
        pairs = pairs.join(near(sizes).select(F.col("rep").alias(c), F.col("shards").alias(f"shards_{c}")), c, "left")
    pairs = cut(pairs, "between")
    alone = pairs.filter("shards_a is null and shards_b is null").select("a", "b", "both", "na", "nb")
    place = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(f"shards_{c}", F.lit(1)) - 1)).alias(f"_{c}")
    met = pairs.filter("shards_a is not null or shards_b is not null").select("*", place("a")).select("*", place("b"))
    own = sizes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), *[F.col("n").alias(c) for c in ("both", "na", "nb")], *[F.col("shards").alias(f"shards_{c}") for c in "ab"])
    met = met.unionByName(own.select("*", place("a")).select("*", place("b")).filter("_a <= _b"))
    for c in "ab":
        keys = tiles.select(F.col("rep").alias(c), F.col("shard").alias(f"_{c}"), F.col("keys").alias(f"keys_{c}"))
        met = met.join(shuffled(keys), [c, f"_{c}"], "left").withColumn(f"keys_{c}", F.coalesce(f"keys_{c}", F.array(c)))
    out = met.select("*", F.explode("keys_a").alias("x")).select("*", F.explode("keys_b").alias("y")).filter("if(a = b and _a = _b, x < y, x <> y)")
    size = lambda one, other: F.when(F.col("x") < F.col("y"), F.col(one)).otherwise(F.col(other))
    return alone.union(out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "both", size("na", "nb").alias("na"), size("nb", "na").alias("nb")))
