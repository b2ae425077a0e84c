"""Words and word shingles as 64-bit hashes, computed in bounded slices of a text.

A word is a maximal run of characters other than space, tab, line feed,
vertical tab, form feed and carriage return, which is how ``bytes.split``
cuts UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from xxhash import xxh3_64_intdigest

SLICE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_runs(data: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, a slice of about ``size`` bytes at a time."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            m = _SPACE.search(data, end)
            end = m.start() if m else len(data)
        yield data[at:end].split()
        at = end


def shingles(data: bytes, k: int = 5, size: int = SLICE) -> np.ndarray:
    """Hashes of all ``k``-word shingles in order, repeats included.

    A text of 1 to ``k - 1`` words has its whole sequence as the one shingle;
    a text without words has none.
    """
    carry = np.empty(0, dtype=np.uint64)
    parts, n = [], 0
    for words in word_runs(data, size):
        n += len(words)
        h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        h = np.concatenate([carry, h]) if len(carry) else h
        if len(h) >= k:
            parts.append(_rolled(h, k))
            carry = h[len(h) - k + 1 :]
        else:
            carry = h
    if not n:
        return np.empty(0, dtype=np.uint64)
    if n < k:
        return mix(_rolled(carry, n) + np.uint64(n))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    m = len(h) - k + 1
    out = h[:m] * _ODD[0]
    for j in range(1, k):
        out += mix(h[j : j + m] + _ODD[j])* _ODD[j]
    return mix(out)


def as_bytes(column) -> list:
    """An Arrow string column's values as UTF-8 bytes, null as ``b""``."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
