"""Vector best-fit packing of token sequences into bins.

A bin has three capacities: tokens, documents, and attention cost (the sum of
squared piece lengths).  Pieces are dealt to groups of bounded size; within a
group they are placed longest first, each into the open bin that takes it under
every capacity and scores best: by the largest weighted dot product of demand
and residual, or by the smallest weighted norm of the residual left.  Each
group fills its bins to the last few, so the share of unfilled space falls with
the group's size (``GROUP_TOKENS``), which is the same for every input.

Defined cases: null texts count as empty and hold the end id alone; texts
longer than a bin are cut into full pieces and a last shorter one; ties go to
the bin found first; repeated rows are packed each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, small_batches
from ._tokens import default_path, encoder

CAPACITY = 4096
#: Pieces in a bin, and squared tokens.  Neither closes a bin that still has room for tokens: an option may set less.
DOCUMENTS = CAPACITY
ATTENTION = 4096**2
WEIGHTS = (1.0, 0.25, 0.25)
GROUP_TOKENS = 16 << 20
GROUP_PIECES = 1_000_000
END_ID = 1


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, row``: the token pieces of every document."""
    path = path or default_path()

    def cut(ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        for start in range(0, len(ids), capacity):
            part = ids[start : start + capacity]
            yield start, len(part), zlib.crc32(part.tobytes())

    def emit(batches):
        enc = encoder(path)
        for b in batches:
            rows = []
            for doc, row, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), enc.many(b.column(2).to_pylist())):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                rows += [(doc, k, start, n, crc, row) for k, (start, n, crc) in enumerate(cut(ids))]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("t"))
    return rows.mapInArrow(emit, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def place(lengths: np.ndarray, capacity: int = CAPACITY, documents: int = DOCUMENTS, attention: float = ATTENTION, weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ``rule`` is ``norm`` or ``dot``."""
    lengths = np.asarray(lengths, dtype=np.int64)
    full = np.array([capacity, documents, attention], dtype=np.float64)
    w = np.asarray(weights, dtype=np.float64)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    least = int(lengths.min()) if len(lengths) else 0
    room = np.empty((max(16, len(lengths)), 3))
    name, used = np.empty(len(room), dtype=np.int64), np.empty(len(room), dtype=np.int64)
    n_open = n_bins = 0
    for k in order:
        n = int(lengths[k])
        need = np.array([n, 1.0, float(n) * n])
        at = -1
        if n_open and n < capacity:
            r = room[:n_open]
            fits = np.flatnonzero((r[:, 0] >= n) & (r[:, 1] >= 1) & (r[:, 2] >= need[2]))
            if len(fits):
                left = (r[fits] - need) / full
                if rule == "norm":
                    score = left**2 @ w
                    at = fits[score.argmin()]
                else:
                    at = fits[((r[fits] / full) @ (w * need / full)).argmax()]
        if at < 0:
            at = n_open
            room[at], name[at], used[at] = full, n_bins, 0
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[k], offsets[k] = name[at], used[at]
        room[at] -= need
        used[at] += n
        if room[at, 0] < least or room[at, 1] < 1 or room[at, 2] < float(least) * least:
            n_open -= 1
            for x in (room, name, used):
                x[at] = x[n_open]
    return bins, offsets


def packed(rows: DataFrame, capacity: int = CAPACITY, documents: int = DOCUMENTS, attention: float = ATTENTION, weights=WEIGHTS, rule: str = "norm") -> DataFrame:
    """``rows`` of :func:`pieces` with ``sequence_id`` and ``offset``.

    The pieces are written once; their totals fix the number of groups.
    """
    rows = materialize(rows, "pieces")
    tokens, count = rows.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-tokens // GROUP_TOKENS), -(-count // GROUP_PIECES))

    def flush(group, parts):
        t = pa.Table.from_batches(parts)
        bins, offsets = place(t.column("length").to_numpy(), capacity, documents, attention, weights, rule)
        out = t.drop_columns(["group", "row"]).append_column("sequence_id", pa.array((int(group) << 32) + bins)).append_column("offset", pa.array(offsets))
        yield from out.combine_chunks().to_batches()

    def emit(batches):
        held, now = [], None
        for b in batches:
            g = b.column("group").to_numpy()
            for part in np.split(np.arange(len(g)), np.flatnonzero(g[1:] != g[:-1]) + 1) if len(g) else []:
                if held and g[part[0]] != now:
                    yield from flush(now, held)
                    held = []
                now = g[part[0]]
                held.append(b.slice(int(part[0]), len(part)))
        if held:
            yield from flush(now, held)

    keyed = rows.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("long"))
    keyed = keyed.repartition(min(groups, 100_000), "group").sortWithinPartitions("group", F.desc("length"), "doc_id", "row", "piece")
    return keyed.mapInArrow(emit, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, **options) -> DataFrame:
    """Tokenize, cut and pack ``docs``."""
    small_batches(docs.sparkSession)
    return packed(pieces(docs, id_col, text, path, options.get("capacity", CAPACITY)), **options)
