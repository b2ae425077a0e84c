r"""WARC archives in Zstandard frames: a writer that stores repeated payloads once, and the reader.

An archive starts with a skippable frame that holds the Zstandard dictionary
(left out where none could be trained); each record is one frame of its own
with content size and checksum.  The reader takes the dictionary from that
frame, decodes one frame a record and checks version, named headers, header,
block and payload lengths, record ends, each response's payload digest and each
archive's number of records; :func:`verified` checks every revisit's length and
digest against the response that it names.

Records of equal payloads of at least ``MIN_REVISIT`` bytes: the smallest page
id is the response, the others are revisits that name it and hold no payload.

Defined cases: a null html is an empty payload; null ids are written as
``null``, count as larger than all others and are read back as null; rows that
repeat the response's id and payload are responses too; control characters in
URLs are percent-coded; an empty table gives an empty result; other columns are
ignored, whatever their names; a payload of any length is one record, held whole
in memory, as are the rows of ties and repeated ids, each a record.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import Written, opened
from ._store import materialize, new_path, small_batches, small_side

VERSION = b"WARC/1.1"
DICT_MAGIC = 0x184D2A5D
MIN_REVISIT = 100
LEVEL = 3
#: Payload bytes after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
#: Rows and bytes of a row that the dictionary is trained on, and its size.
DICT_ROWS, DICT_ROW_BYTES, DICT_BYTES = 400, 8192, 32 << 10
DATE = b"2024-01-01T00:00:00Z"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LAST = (1 << 63) - 1
_DIGEST = re.compile(r"sha256:[0-9a-f]{64}")
#: What a record says of its payload, without the payload.
ABOUT = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")


def trained_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary from a bounded sample of payloads, those of least hash; ``b""`` where they are too few.

    A share of the hashes that holds some times ``DICT_ROWS`` different payloads
    is cut out first, so that few rows reach the driver from however many tasks.
    """
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    hashed = pages.select(F.xxhash64(text).alias("h"), F.encode(F.substring(text, 1, DICT_ROW_BYTES // 4), "utf-8").alias("b"))
    n = hashed.select(F.approx_count_distinct("h", 0.05)).first()[0]
    share = min(1 << 30, (1 << 30) * 4 * DICT_ROWS // max(1, n) + 1)
    rows = hashed.filter(F.pmod("h", F.lit(1 << 30)) < share).distinct().orderBy("h", "b").limit(DICT_ROWS).collect()
    samples = [bytes(r["b"]) for r in rows if r["b"]]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 20 else b""
    except zstandard.ZstdError:
        return b""


def _safe(url: str) -> bytes:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url).encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, header and block."""
    block = b"" if revisit else payload
    head = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:page:%s>" % (b"null" if page_id is None else b"%d" % page_id),
        b"WARC-Target-URI: " + _safe(url or ""),
        b"WARC-Date: " + DATE,
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"X-Payload-Length: %d" % len(payload),
        b"Content-Type: text/html; charset=utf-8",
        b"Content-Length: %d" % len(block),
    ]
    if revisit:
        head[5:5] = [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: " + PROFILE]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block; raises ``ValueError`` on any fault."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != VERSION:
        raise ValueError("no WARC/1.1 header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.decode().lower()] = value.strip().decode()
    kind = fields.get("warc-type")
    needed = ["warc-type", "warc-record-id", "warc-date", "content-length"]
    if kind in ("response", "revisit"):
        needed += ["warc-payload-digest", "x-payload-length"] + ["warc-refers-to", "warc-profile"] * (kind == "revisit")
    for name in needed:
        if name not in fields:
            raise ValueError(f"no {name}")
    size = fields["content-length"]
    if not _number(size) or len(rest) != int(size) + 4 or rest[int(size) :] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the block")
    block = rest[: int(size)]
    if kind in ("response", "revisit"):
        if not _number(fields["x-payload-length"]) or not _DIGEST.fullmatch(fields["warc-payload-digest"]):
            raise ValueError("bad payload length or digest")
        if kind == "revisit" and block:
            raise ValueError("a revisit holds a block")
        if kind == "response" and (int(fields["x-payload-length"]) != len(block) or fields["warc-payload-digest"] != "sha256:" + hashlib.sha256(block).hexdigest()):
            raise ValueError("payload length or digest does not match")
    return fields, block


def _number(text: str) -> bool:
    return text.isascii() and text.isdigit()


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""


class ArchiveWriter:
    def __init__(self, out, dictionary: bytes) -> None:
        self.out, self.size = out, 0
        out.write(dictionary_frame(dictionary))
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True, write_content_size=True)

    def add(self, data: bytes) -> None:
        self.out.write(self.frames.compress(data))
        self.size += len(data)


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive in order; a record and a chunk are in memory at a time."""
    data = stream.read(8)
    d = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICT_MAGIC:
        size = struct.unpack("<I", data[4:])[0]
        raw = stream.read(size)
        if len(raw) != size:
            raise ValueError("dictionary frame is cut off")
        if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be a frame
            raw = zstandard.ZstdDecompressor().decompress(raw)
        d, data = zstandard.ZstdCompressionDict(raw), b""
    frames = zstandard.ZstdDecompressor(dict_data=d)
    while data := data or stream.read(chunk):
        one, parts = frames.decompressobj(), []
        while True:
            parts.append(one.decompress(data))
            if one.eof:
                data = one.unused_data
                break
            if not (data := stream.read(chunk)):
                raise ValueError("frame is cut off")
        yield parse_record(b"".join(parts))


def responses(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """``digest, first``: of payloads that are stored once for several pages, the page that is the response.

    Only digests and ids are shuffled, counted before the shuffle.
    """
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "utf-8")
    rows = pages.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("id"), F.length(payload).alias("size"), F.sha2(payload, 256).alias("digest"))
    return rows.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "first")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record a row below ``folder``; the archives' names and record counts.

    An archive is named by its task's attempt as well, so that a doubled task
    writes others; only those of the attempt that counts are listed.
    """
    small_batches(pages.sparkSession)
    dictionary = trained_dictionary(pages, html)
    first = materialize(responses(pages, id_col, html), "responses")
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256)).join(small_side(first, 200_000), "digest", "left").select("id", "url", "html", "digest", "first")

    def emit(batches):
        from pyspark import TaskContext

        task, k, held, writer, n, done = TaskContext.get(), 0, None, None, 0, []
        for b in batches:
            for page, address, text, digest, ref in zip(*(c.to_pylist() for c in b.columns)):
                if writer is None:
                    uri = f"{folder}/part-{task.partitionId():08d}-{task.taskAttemptId():08d}-{k:04d}.warc.zst"
                    held, k, n = Written(uri), k + 1, 0
                    writer = ArchiveWriter(held.__enter__(), dictionary)
                revisit = ref is not None and ref != (LAST if page is None else page)
                writer.add(record(page, address, text.encode(), digest, ref, revisit))
                n += 1
                if writer.size >= ARCHIVE_BYTES:
                    held.__exit__(None)
                    done.append((uri, n))
                    writer = None
        if writer is not None:
            held.__exit__(None)
            done.append((uri, n))
        names, counts = zip(*done) if done else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["file", "records"])

    return materialize(p.mapInArrow(emit, "file string, records long"), "archives")


def _id(field: str | None) -> int | None:
    if field is None:
        return None
    name = field.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row a record of the archives (``file, records``): ids, type, URL, payload (null for revisits), its length and digest."""
    fields = (("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(list(zip(*rows)) or [[]] * 7, fields)], [n for n, _ in fields])

    def emit(batches):
        for b in batches:
            for uri, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with opened(uri) as stream:
                    rows, held, n = [], 0, 0
                    for h, block in read_archive(stream):
                        kind = h["warc-type"]
                        n += 1
                        if kind not in ("response", "revisit"):
                            continue
                        rows.append((_id(h["warc-record-id"]), h.get("warc-target-uri"), kind, _id(h.get("warc-refers-to")), int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:"), block if kind == "response" else None))
                        held += len(block)
                        if held > 4 << 20 or len(rows) == 256:
                            yield batch(rows)
                            rows, held = [], 0
                    yield batch(rows)
                    if n != records:
                        raise ValueError(f"{uri} holds {n} records, not {records}")

    files = archives.select("file", "records").repartition(max(1, archives.count()))
    return files.mapInArrow(emit, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def verified(records: DataFrame) -> DataFrame:
    """``records``, failing where a revisit's payload isn't that of a response of the id it names.

    Only ids, lengths and digests of named responses are joined.
    """
    what = ("payload_bytes", "payload_digest")
    named = small_side(records.filter("record_type = 'revisit'").select(F.col("refers_to").alias("named")).distinct())
    own = F.coalesce("page_id", F.lit(LAST))
    responses_ = records.filter("record_type = 'response'").select(own.alias("named"), *what).join(named, "named", "left_semi").distinct().withColumn("known", F.lit(True))
    out = records.withColumn("named", F.when(F.col("record_type") == "revisit", F.col("refers_to"))).join(small_side(responses_, 200_000), ["named", *what], "left")
    fault = F.raise_error(F.concat(F.lit("no response holds what a revisit names: "), F.coalesce(F.col("refers_to").cast("string"), F.lit("null"))))
    whole = F.when((F.col("record_type") == "revisit") & F.col("known").isNull(), fault.cast("string")).otherwise(F.col("record_type"))
    return out.withColumn("record_type", whole).select(*records.columns)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages as archives and return what the archives' records say of their payloads, verified."""
    archives = write_archives(pages, folder or new_path(pages.sparkSession, "warc"), **options)
    return verified(materialize(read_archives(archives).select(*ABOUT), "records"))
