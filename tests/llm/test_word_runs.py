"""Runs of words against their definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from lamella.llm import queries, word_runs


def plain_runs(words, least, times):
    """All runs by trying every period: stretches in which words a period apart are equal."""
    n, out, covered = len(words), [], set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q) and (i, length) not in covered:
                out.append((i, length, q))
            if j > i and length >= 2 * q:
                covered.add((i, length))
            i = j + 1
    return sorted(out)


def test_small_alphabets():
    rng = random.Random(5)
    for trial in range(600):
        n = rng.randrange(0, 90)
        words = [rng.choice("ab" if trial % 2 else "abc") for _ in range(n)]
        if trial % 3 == 0 and n > 10:
            p, a = rng.randrange(1, 12), rng.randrange(n // 2)
            words = words[:a] + [words[a + i % p] if a + i % p < n else "a" for i in range(n - a)]
        least, times = rng.choice([(24, 3), (6, 3), (4, 2), (10, 4), (2, 2), (7, 3)])
        assert word_runs.word_runs(words, least, times) == plain_runs(words, least, times), (words, least, times)


def test_covers_hold_every_run():
    rng = random.Random(6)
    for _ in range(60):
        words = [str(rng.randrange(40)) for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(4)):
            q, m, at = rng.randrange(1, 30), rng.randrange(3, 6), rng.randrange(len(words))
            words[at:at] = [str(rng.randrange(40)) for _ in range(q)] * m
        assert word_runs.word_runs(words) == plain_runs(words, 24, 3)


def test_ordered_ends():
    rng = random.Random(1)
    x = list(range(5000))
    rng.shuffle(x)
    e = word_runs.Ends(x[0])
    for v in x[1:]:
        e.add(v)
    assert list(e) == sorted(x) and e.around(0) == (-1, 1) and e.around(4999) == (4998, -1) and e.around(2500) == (2499, 2501)


def test_long_repetition():
    words = [str(i % 7) for i in range(60_000)] + ["end"]
    assert word_runs.word_runs(words) == [(0, 60_000, 7)]
    assert word_runs.word_runs(["a"] * 60_000) == [(0, 60_000, 1)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    rows = {r["doc_id"]: r for r in queries.op12_word_runs(spark, f"/root/testdata/{sf}").collect()}
    docs = pq.read_table(f"/root/testdata/{sf}/documents.parquet").to_pandas()
    assert len(rows) == len(docs)
    found = 0
    for d, text in zip(docs.doc_id, docs.text):
        w = [x.decode() for x in (text or "").encode().split()]
        h, n = zlib.crc32(str(d).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        ids = np.unique(np.array(w), return_inverse=True)[1] if w else np.empty(0, dtype=int)
        runs, seen = [], set()
        for q in range(1, n // 3 + 1):
            same = np.concatenate([[0], (ids[q:] == ids[:-q]).astype(int), [0]])
            edge = np.flatnonzero(np.diff(same))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                length = e - s + q
                if length >= max(24, 3 * q) and (s, length) not in seen:
                    seen.add((s, length))
                    runs.append((s, length, q))
        runs.sort()
        r = rows[d]
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        assert (r["start"], r["length"], r["period"]) == best and r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        found += bool(runs)
    assert found > len(docs) // 20


def test_defined_cases(spark):
    rep = " ".join(["x y z"] * 10)
    schema = "doc_id long, text string, runs int, collapsed string"
    rows = [(1, None, 1, ""), (2, "", 1, ""), (None, rep, 1, ""), (4, rep, 1, ""), (4, rep, 1, ""), (5, " \n ", 2, None), (6, "é " * 30, 3, "")]
    out = word_runs.periodic(spark.createDataFrame(rows, schema)).collect()
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out)
    assert got == [(0, 30, [(0, 30, 3)], "x y z"), (1, 0, [], ""), (2, 0, [], ""), (4, 30, [(0, 30, 3)], "x y z"), (4, 30, [(0, 30, 3)], "x y z"), (5, 0, [], ""), (6, 30, [(0, 30, 1)], "é")]
    assert word_runs.periodic(spark.createDataFrame([], schema)).count() == 0
