"""Token ids as files of static range asymmetric numeral system (rANS) blocks.

One frequency table, counted over all documents and scaled to ``2**SCALE_BITS``,
serves every file.  A file holds the ids of a range of documents in ascending
id order as independent blocks of ``BLOCK`` ids.  A block interleaves ``lanes``
coders: id ``s * lanes + l`` belongs to lane ``l``, all lanes advance together,
and the 32-bit words they emit share one stream, so numpy codes a whole row of
lanes at a time.

File: ``MAGIC``, crc32 of the table; the blocks; an index with one checkpoint a
block (offset, first id's position, count, lanes, words, crc32 of the ids) and
the documents (id, null flag, count); the index's length, its crc32, ``MAGIC``.
A reader can start at any checkpoint.  Reading checks every crc32.

Defined cases: null texts count as empty and hold the end id alone; null ids
sort first; repeated rows are written each; an empty table gives an empty
result; other columns are ignored; very long texts span many blocks.

Between the tokenizer and the files an id takes two bytes where the vocabulary
has at most 65,536 ids, else four.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._files import Written, opened
from ._ranges import bounds, key_of, range_count, range_udf
from ._store import discard, materialize, new_path, small_batches
from ._tokens import default_path, encoder, id_type

MAGIC = b"LRANS001"
SCALE_BITS = 20
#: Blocks that a task decodes.
SPAN = 64
BLOCK = 1 << 18
LANES = 4096
LOW = np.uint64(1 << 31)
RANGE_ROWS = 500_000
END_ID = 1
_CHECKPOINT = struct.Struct("<QQIIII")
_DOC = struct.Struct("<qBQ")


class Table:
    """Frequencies scaled to sum to ``2**SCALE_BITS``, each seen id at least 1."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @classmethod
    def scaled(cls, counts: np.ndarray) -> Table:
        counts = np.asarray(counts, dtype=np.float64)
        total, size = counts.sum(), 1 << SCALE_BITS
        seen = counts > 0
        if seen.sum() > size:
            raise ValueError(f"more than {size} different ids")
        freq = np.where(seen, np.maximum(1, np.floor(counts / max(total, 1) * size)), 0).astype(np.int64)
        over = int(freq.sum() - size)
        order = np.argsort(-freq, kind="stable")
        while over > 0:
            for i in order:
                cut = min(over, int(freq[i]) // 2)
                freq[i] -= cut
                over -= cut
                if not over:
                    break
        if over < 0 and seen.any():
            freq[order[0]] -= over
        return cls(freq)

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    def crc(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())


def encode_block(ids: np.ndarray, table: Table) -> tuple[int, bytes]:
    """Lanes, and the final states followed by the words in reading order."""
    lanes = int(min(LANES, max(1, len(ids) // 64)))
    steps = -(-len(ids) // lanes)
    x = np.full(lanes, LOW, dtype=np.uint64)
    out = []
    top, low32 = np.uint64(63 - SCALE_BITS), np.uint64(32)
    for s in range(steps - 1, -1, -1):
        sym = ids[s * lanes : (s + 1) * lanes]
        m = len(sym)
        f, c, v = table.freq[sym], table.cum[sym], x[:m]
        big = v >= (f << top)
        if big.any():
            out.append(v[big].astype(np.uint32))
            v = np.where(big, v >> low32, v)
        q, r = np.divmod(v, f)
        x[:m] = (q << np.uint64(SCALE_BITS)) + r + c
    words = np.concatenate(out[::-1]) if out else np.empty(0, dtype=np.uint32)
    return lanes, x.astype("<u8").tobytes() + words.astype("<u4").tobytes()


def decode_block(data: bytes, count: int, lanes: int, table: Table) -> np.ndarray:
    x = np.frombuffer(data, dtype="<u8", count=lanes).copy()
    words = np.frombuffer(data, dtype="<u4", offset=8 * lanes)
    ids = np.empty(count, dtype=np.uint32)
    slots, freq, cum = table.slots, table.freq, table.cum
    mask, bits, low32 = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    at = 0
    for s in range(-(-count // lanes)):
        m = min(lanes, count - s * lanes)
        v = x[:m]
        slot = v & mask
        sym = slots[slot]
        v = freq[sym] * (v >> bits) + slot - cum[sym]
        small = np.flatnonzero(v < LOW)
        if len(small):
            v[small] = (v[small] << low32) | words[at : at + len(small)]
            at += len(small)
        x[:m] = v
        ids[s * lanes : s * lanes + m] = sym
    if at != len(words) or (x != LOW).any():
        raise ValueError("block is not whole")
    return ids


class FileWriter:
    """Writes documents' ids to an open stream, a block at a time."""

    def __init__(self, out, table: Table) -> None:
        self.out, self.table = out, table
        self.held: list[np.ndarray] = []
        self.n_held = self.position = 0
        self.offset = len(MAGIC) + 4
        self.checkpoints, self.docs = io.BytesIO(), io.BytesIO()
        self.n_docs = self.n_blocks = 0
        out.write(MAGIC + struct.pack("<I", table.crc()))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.write(_DOC.pack(doc_id or 0, doc_id is None, len(ids)))
        self.n_docs += 1
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, dtype=np.uint32)
        at = 0
        while len(ids) - at >= BLOCK or last and at < len(ids):
            part = ids[at : at + BLOCK]
            lanes, data = encode_block(part, self.table)
            self.out.write(data)
            self.checkpoints.write(_CHECKPOINT.pack(self.offset, self.position, len(part), lanes, len(data), zlib.crc32(part.astype("<u4").tobytes())))
            self.offset += len(data)
            self.position += len(part)
            self.n_blocks += 1
            at += len(part)
        self.held = [ids[at:]]
        self.n_held = len(ids) - at

    def close(self) -> int:
        self._blocks(True)
        index = struct.pack("<QQ", self.n_blocks, self.n_docs) + self.checkpoints.getvalue() + self.docs.getvalue()
        self.out.write(index + struct.pack("<QI", len(index), zlib.crc32(index)) + MAGIC)
        return self.position


class FileReader:
    """Reads a file's index, then any block or all documents in order."""

    def __init__(self, stream, table: Table) -> None:
        self.stream, self.table = stream, table
        stream.seek(0)
        head = stream.read(len(MAGIC) + 4)
        stream.seek(0, 2)
        end = stream.tell() - len(MAGIC) - 12
        stream.seek(end)
        tail = stream.read()
        size, crc = struct.unpack_from("<QI", tail)
        if head[: len(MAGIC)] != MAGIC or tail[12:] != MAGIC:
            raise ValueError("not a token file")
        if struct.unpack_from("<I", head, len(MAGIC))[0] != table.crc():
            raise ValueError("another frequency table")
        stream.seek(end - size)
        index = stream.read(size)
        if zlib.crc32(index) != crc:
            raise ValueError("index checksum")
        n_blocks, n_docs = struct.unpack_from("<QQ", index)
        at = 16 + n_blocks * _CHECKPOINT.size
        self.checkpoints = list(_CHECKPOINT.iter_unpack(index[16:at]))
        self.docs = [(None if null else doc, n) for doc, null, n in _DOC.iter_unpack(index[at:])]

    def block(self, i: int) -> np.ndarray:
        offset, _, count, lanes, size, crc = self.checkpoints[i]
        self.stream.seek(offset)
        ids = decode_block(self.stream.read(size), count, lanes, self.table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} checksum")
        return ids

    def parts(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(document's place in the index, some of its ids, whether they end it) of the documents that begin in blocks ``first`` to before ``last``.

        Decoding begins at the first block's checkpoint; what ends an earlier document there is passed over,
        and the last document is followed into the blocks after.  A block is in memory at a time.
        """
        lengths = np.array([n for _, n in self.docs], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        places = [c[1] for c in self.checkpoints]
        end = len(places) if last is None else min(last, len(places))
        if first >= end:
            return
        doc = int(np.searchsorted(starts, places[first]))
        stop = len(starts) if end == len(places) else int(np.searchsorted(starts, places[end]))
        done = 0
        for i in range(first, len(places)):
            if doc >= stop:
                return
            if not done and starts[doc] >= places[i] + self.checkpoints[i][2]:
                continue  # inside a document of an earlier block
            ids, at = self.block(i), int(max(0, starts[doc] + done - places[i]))
            while doc < stop and at < len(ids):
                n = min(int(lengths[doc]) - done, len(ids) - at)
                done += n
                yield doc, ids[at : at + n], done == lengths[doc]
                at += n
                if done == lengths[doc]:
                    doc, done = doc + 1, 0


def token_rows(docs: DataFrame, id_col: str, text: str, path: str) -> DataFrame:
    """``doc_id, key, ids``: each document's ids with the end id, as :func:`id_type` little-endian integers."""
    dtype = id_type(path)

    def emit(batches):
        enc, end = encoder(path), np.array([END_ID], dtype=dtype).tobytes()
        for b in batches:
            ids = [x.astype(dtype).tobytes() + end for x in enc.many(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(emit, "doc_id long, ids binary")
    return rows.withColumn("key", key_of(F.col("doc_id")))


def frequency_table(tokens: DataFrame, dtype: str) -> Table:
    """Counts over all documents; a row a different id reaches the driver, so at most the vocabulary."""

    def emit(batches):
        total = np.zeros(1, dtype=np.int64)
        for b in batches:
            c = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=dtype))
            if len(c) > len(total):
                c[: len(total)] += total
                total = c
            else:
                total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(emit, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r[0] for r in rows), default=0) + 1, dtype=np.int64)
    for i, n in rows:
        counts[i] = n
    return Table.scaled(counts)


def write_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> tuple[DataFrame, Table]:
    """Write ``docs`` to ``folder``; a manifest (``range, file, n_docs, n_tokens, n_blocks``, one row a file) and the table."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or default_path()
    dtype = id_type(path)
    tokens = materialize(token_rows(docs, id_col, text, path), "tokens")
    table = frequency_table(tokens, dtype)
    cuts = bounds(tokens.select("key"), "key", range_count(spark, tokens.count(), RANGE_ROWS))
    freq = spark.sparkContext.broadcast(table.freq)

    def emit(batches):
        own = Table(freq.value)
        now = held = writer = None
        done = []

        def finish():
            n = writer.close()
            held.__exit__(None)
            done.append((now, uri, writer.n_docs, n, writer.n_blocks))

        for b in batches:
            for rng, doc, ids in zip(*(c.to_pylist() for c in b.columns)):
                if rng != now:
                    if writer:
                        finish()
                    uri = f"{folder}/part-{rng:08d}.rans"
                    now, held = rng, Written(uri)
                    writer = FileWriter(held.__enter__(), own)
                writer.add(doc, np.frombuffer(ids, dtype=dtype).astype("<u4"))
        if writer:
            finish()
        cols = list(zip(*done)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["range", "file", "n_docs", "n_tokens", "n_blocks"])

    rows = tokens.select(range_udf(cuts)("key").alias("range"), "key", "doc_id", "ids").repartitionById(len(cuts) + 1, "range")
    rows = rows.sortWithinPartitions("range", "key", "ids").select(F.col("range").cast("long"), "doc_id", "ids")
    manifest = materialize(rows.mapInArrow(emit, "range long, file string, n_docs long, n_tokens long, n_blocks long"), "manifest")
    discard(tokens)
    return manifest, table


def read_files(manifest: DataFrame, table: Table, span: int = SPAN) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files.

    A task decodes the documents that begin in ``span`` blocks of a file, from the checkpoint of
    the first one.  One manifest row a file reaches the driver, for the running total of ids.
    """
    spark: SparkSession = manifest.sparkSession
    files, start = [], 0
    for _, uri, _, n, blocks in sorted(map(tuple, manifest.collect())):
        files.append((uri, start, blocks))
        start += n
    freq = spark.sparkContext.broadcast(table.freq)

    def emit(batches):
        own = Table(freq.value)
        for b in batches:
            for uri, begin, first in zip(*(c.to_pylist() for c in b.columns)):
                with opened(uri) as stream:
                    reader = FileReader(stream, own)
                    starts = np.cumsum([0, *[n for _, n in reader.docs]])
                    rows, crc = [], 0
                    for doc, ids, ends in reader.parts(first, first + span):
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        if ends:
                            doc_id, n = reader.docs[doc]
                            rows.append((doc_id, begin + int(starts[doc]), n, crc))
                            crc = 0
                            if len(rows) == 10_000:
                                yield _batch(rows)
                                rows = []
                    yield _batch(rows)

    listed = spark.createDataFrame(files, "file string, start long, blocks long")
    spans = listed.select("file", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("blocks") - 1), F.lit(span).cast("long"))).alias("first"))
    tasks = sum(max(1, -(-n // span)) for _, _, n in files)
    return spans.repartition(max(1, tasks)).mapInArrow(emit, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [[]] * 4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the documents' ids as files and return what the files hold."""
    manifest, table = write_files(docs, folder or new_path(docs.sparkSession, "rans"), **options)
    return read_files(manifest, table)
