"""How filters act together: what each one removes after any set of others.

Rows become packed bitmaps inside the tasks: one NumPy bitset for each filter's
failures, for each label, and for each part of the table.  What a filter meets
after a set of others is the part's bits AND NOT each of those filters' bits;
counts are popcounts, and the counts of all tasks are summed.  A step of an
order of filters depends on the set before it alone, so ``n * 2 ** (n - 1)`` counts a
part (80 for five filters) give all ``n!`` orders.

A chunk's rows are sorted by part and each part takes whole words of the
bitsets, so the work grows with the rows and not with rows times parts.

Copies: a row fails ``E`` if a row of smaller id has an equal text.  Texts are
compared by 128-bit hashes.  Groups that hold over a hundred-thousandth of all rows
are found by their counts, fewer than 100,000 whatever the input, and broadcast;
the others join by a shuffle.

Defined cases: null texts count as empty; null ids are neither smaller nor
larger than others, so their rows never fail ``E``; null labels and rows without one count as 0, of
several the largest counts; a null part is the empty string; repeated rows
count each, and none of two with one id is a copy of the other; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize, small_batches
from ._words import as_bytes, word_runs

FILTERS = ("A", "B", "C", "D", "E")
LABELS = ("quality", "toxic")
CHUNK = 1 << 18
#: Groups of copies above this share of all rows are broadcast.
HEAVY = 100_000
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"
#: Bytes of UTF-8 that don't begin a code point.
_CONTINUED = bytes(range(0x80, 0xC0))


def measured(data: bytes) -> tuple[bool, bool, bool, bool]:
    """Failures of the four filters that see one text alone."""
    n, distinct = 0, set()
    for words in word_runs(data):
        n += len(words)
        distinct.update(words)
    upper = len(data) - len(data.translate(None, _UPPER))
    chars = len(data) - len(data.translate(None, _CONTINUED)) if not data.isascii() else 0
    return n < 100, 100 * len(distinct) < 80 * n, 100 * upper > 10 * (len(data) - chars), len(data) != len(data.translate(None, _MARKS))


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang", heavy: int = HEAVY) -> DataFrame:
    """``part, A, B, C, D, E, quality, toxic`` of every row, the latter booleans."""
    small_batches(docs.sparkSession)

    def emit(batches):
        for b in batches:
            data = as_bytes(b.column(2))
            marks = [measured(x) for x in data]
            cols = list(zip(*marks)) or [[]] * 4
            digests = pa.array([xxhash.xxh3_128_digest(x) for x in data], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), digests, *[pa.array(c, pa.bool_()) for c in cols]], ["id", "part", "digest", *FILTERS[:4]])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("t"))
    rows = materialize(rows.mapInArrow(emit, "id long, part string, digest binary, A boolean, B boolean, C boolean, D boolean"), "flags")
    groups = materialize(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies")
    bound = max(1000, rows.count() // heavy)
    rows = rows.join(F.broadcast(groups.filter(F.col("n") > bound).select("digest", "first")), "digest", "left")
    other = rows.filter(F.col("first").isNull()).drop("first").join(groups.filter(F.col("n") <= bound).select("digest", "first"), "digest", "left")
    rows = rows.filter(F.col("first").isNotNull()).unionByName(other).withColumn("E", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    marks = labels.groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg(*[F.max((F.col(f"`{c}`") == 1).cast("int")).alias(c) for c in LABELS])
    return rows.join(marks, "id", "left").select("part", *FILTERS, *[F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in LABELS])


class Index:
    """Bitsets of a chunk of rows; each part has whole words of its own."""

    def __init__(self, parts: np.ndarray, columns: list[np.ndarray]) -> None:
        order = np.argsort(parts, kind="stable")
        self.parts, counts = np.unique(parts[order], return_counts=True)
        words = -(-counts // 64)
        self.bounds = np.concatenate([[0], np.cumsum(words)])
        place = np.repeat(self.bounds[:-1] * 64 - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(order))
        self.all = self._packed(place, np.ones(len(order), dtype=bool))
        self.bits = [self._packed(place, c[order]) for c in columns]

    def _packed(self, place: np.ndarray, flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(int(self.bounds[-1]) * 64, dtype=bool)
        bits[place] = flags
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def counts(self, bits: np.ndarray) -> np.ndarray:
        """Set bits of each part."""
        return np.add.reduceat(np.bitwise_count(bits).astype(np.int64), self.bounds[:-1])


def prefix_counts(flags: DataFrame, filters=FILTERS, labels=LABELS, chunk: int = CHUNK) -> DataFrame:
    """``part, before, which, met, removed, lost_0, ...``: for each part, set of filters and filter not in it.

    ``before`` has bit ``k`` for the ``k``-th filter.  ``met`` rows pass all of
    ``before``; of these ``removed`` fail the filter, and ``lost_k`` of them hold
    the ``k``-th label.
    """
    n = len(filters)
    lost = [f"lost_{k}" for k in range(len(labels))]
    schema = "part string, before int, which int, met long, removed long" + "".join(f", {c} long" for c in lost)

    def summed(parts):
        t = pa.Table.from_batches(parts)
        names = t.column(0).combine_chunks().dictionary_encode()
        x = Index(names.indices.to_numpy(), [t.column(1 + k).to_numpy() for k in range(n + len(labels))])
        own = names.dictionary.take(pa.array(x.parts))
        rows = []
        for before in range(1 << n):
            left = x.all.copy()
            for k in range(n):
                if before >> k & 1:
                    left &= ~x.bits[k]
            met = x.counts(left)
            for k in range(n):
                if not before >> k & 1:
                    gone = left & x.bits[k]
                    rows.append((before, k, met, x.counts(gone), *[x.counts(gone & b) for b in x.bits[n:]]))
        for before, k, *sums in rows:
            fixed = [pa.array(np.full(len(own), v, dtype=np.int32)) for v in (before, k)]
            yield pa.RecordBatch.from_arrays([own, *fixed, *map(pa.array, sums)], ["part", "before", "which", "met", "removed", *lost])

    def emit(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= chunk:
                yield from summed(held)
                held, size = [], 0
        if held:
            yield from summed(held)

    sums = flags.select("part", *filters, *labels).mapInArrow(emit, schema)
    return sums.groupBy("part", "before", "which").agg(*[F.sum(c).alias(c) for c in ("met", "removed", *lost)])


def audited(counts: DataFrame, filters=FILTERS, labels=LABELS) -> DataFrame:
    """One row for each part, order of all filters and step, from :func:`prefix_counts`."""
    n = len(filters)
    spark = counts.sparkSession
    whole = Window.partitionBy("part", "which")
    others = F.lit((1 << n) - 1) - F.expr("shiftleft(1, which)")
    # An order meets a set of s filters just before one more in s! (n - 1 - s)! of all orders.
    ways = F.element_at(F.array(*[F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)]), F.bit_count("before") + 1)
    known = counts.select(
        "*",
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).over(whole).alias("fails"),
        F.sum(F.when(F.col("before") == others, F.col("removed"))).over(whole).alias("unique_fails"),
        F.sum(F.col("removed") * ways).over(whole).alias("shapley"),
    )
    steps = [("".join(filters[k] for k in p), at + 1, sum(1 << k for k in p[:at]), p[at]) for p in permutations(range(n)) for at in range(n)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, before int, which int")
    return known.join(F.broadcast(orders), ["before", "which"]).select(
        "part", "filter_order", "step",
        (F.col("met") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        *[F.col(f"lost_{k}").alias(f"{c}_lost") for k, c in enumerate(labels)], "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The five filters over ``docs`` in all their orders; counts of a part are in the tables' rows."""
    return audited(prefix_counts(flagged(docs, labels, id_col, text, part)))
