"""Threshold-scaled sketches of texts.

A sketch keeps every five-word shingle hash below 1/``SCALE`` of the hash
space, whatever the text's length.  Two sketches merge by set union, which gives
the sketch of the union; the containment of one text in another is the share of
its kept hashes that the other also holds.  ``likeness`` is the containment of
the smaller sketch in the larger, made for very unequal texts.

A text with words of which no hash lies below the threshold (odds ``(1 -
1/SCALE) ** n`` for ``n`` different shingles)
has its smallest hash for a sketch, which is above the threshold.  It tells equal texts apart from others and is never compared with kept hashes, of
which it knows nothing: its likeness to another sketch is 0 unless they are the
same.

A fingerprint is the sorted hashes as little-endian bytes in base 64.

Defined cases: null texts count as empty; a text without words has an empty
fingerprint; two empty fingerprints have likeness 1, an empty and another 0;
equal texts have equal fingerprints; under five words the whole sequence is the
one shingle; texts of any length are hashed whole, a slice at a time; repeated
rows follow one another and are each other's neighbours, rows of one id sort by
their text; null ids come last in descending order; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ranges import NULL_KEY, bounds, key_of, range_count, range_udf
from ._store import small_batches
from ._words import shingles

K = 5
#: One hash in so many is kept; the README has the size and error of other values.
SCALE = 4
RANGE_ROWS = 500_000


def limit_of(scale: int = SCALE) -> np.uint64:
    """Hashes below it are kept."""
    return np.uint64((1 << 64) // scale) if scale > 1 else np.uint64((1 << 64) - 1)


def sketch(text: str, k: int = K, scale: int = SCALE) -> np.ndarray:
    h = shingles(text.encode(), k)
    if not len(h):
        return h
    low = h[h < limit_of(scale)]
    return np.unique(low) if len(low) else h.min(keepdims=True)


def lone(s: np.ndarray, scale: int = SCALE) -> bool:
    """Whether a sketch is of words none of whose hashes is kept."""
    return len(s) == 1 and bool(s[0] >= limit_of(scale))


def merged(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    both = np.union1d(a, b)
    low = both[both < limit_of(scale)]
    return low if len(low) else both[:1]


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Estimated share of ``a``'s shingles that ``b`` holds."""
    if not len(a) or not len(b) or lone(a, scale) or lone(b, scale):
        return float(np.array_equal(a, b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    return containment(a, b, scale) if len(a) <= len(b) else containment(b, a, scale)


def written(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u8")


def edited(text: str, following: str) -> str:
    """The last third of ``text``'s code points replaced by as many first ones of ``following``, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, scale: int = SCALE) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every text."""
    small_batches(docs.sparkSession)

    def emit(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([written(sketch(t, k, scale)) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(emit, "doc_id long, n_chars long, fingerprint string")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_doc_id long"


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document's text, by descending id.

    Texts are shuffled once, to ranges of the id; the first document of each
    range goes to the range before it as well, where it follows the last one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = F.col(f"`{id_col}`")
    d = docs.select(own.cast("long").alias("doc_id"), key_of(own).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    keys = d.select("key")
    cuts = bounds(keys, "key", range_count(spark, keys.count(), RANGE_ROWS))
    of = range_udf(cuts)
    heads = sorted(map(tuple, keys.select((F.lit(len(cuts)) - of("key")).alias("r"), "key").groupBy("r").agg(F.max("key")).collect()))
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    ahead_of = np.array(sorted(before), dtype=np.int64)
    target = np.array([before[h] for h in ahead_of.tolist()], dtype=np.int32)

    @F.pandas_udf("array<int>")
    def places(key):
        x = key.to_numpy()
        own = len(cuts) - np.searchsorted(cuts, x, side="right")
        at = np.minimum(np.searchsorted(ahead_of, x), len(ahead_of) - 1)
        out = np.empty(len(x), dtype=object)
        for i, (r, j) in enumerate(zip(own.tolist(), at.tolist())):
            out[i] = [r, -1 - int(target[j])] if ahead_of[j] == x[i] else [r]
        return key.__class__(out)

    r = d.withColumn("place", F.explode(places("key")))
    r = r.select(F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("r"), (F.col("place") < 0).alias("ahead"), "key", "doc_id", "t")
    r = r.repartitionById(len(cuts) + 1, "r").sortWithinPartitions("r", "ahead", F.desc("key"), "t")

    def pair(pending, following):
        _, doc, t, s = pending
        _, next_doc, u, v = following
        e = edited(t, u)
        es = s if e == t else sketch(e, k, scale)
        return doc, len(t), hashlib.sha256(e.encode()).hexdigest(), written(s), written(es), likeness(s, es, scale), likeness(s, v, scale), next_doc

    def emit(batches):
        pending, done = None, None
        for b in batches:
            rows = []
            for rng, ahead, doc, t in zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4))):
                if ahead and done == rng:
                    continue
                now = (rng, doc, t, sketch(t, k, scale))
                if pending is not None:
                    rows.append(pair(pending, now))
                if ahead:
                    pending, done = None, rng
                else:
                    pending = now
            cols = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_doc_id"])

    return r.mapInArrow(emit, SCHEMA)
