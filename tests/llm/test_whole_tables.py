"""Queries without SQL against plain Python over the same tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from lamella.llm import best_fit, fingerprints, queries, toxicity

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()


@pytest.fixture(scope="module")
def ids(docs):
    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return {int(d): np.array([*t.encode(x, add_special_tokens=False).ids, 1], dtype="<u4") for d, x in zip(docs.doc_id, docs.text)}


def test_token_files(spark, sf_dir, ids):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op10_token_ids(spark, sf_dir).collect()}
    want, at = {}, 0
    for d in sorted(ids):
        want[d] = (at, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        at += len(ids[d])
    assert got == want


def test_packing(spark, sf_dir, ids):
    rows = queries.op9_best_fit(spark, sf_dir).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == {(d, s // 4096, s, len(x[s : s + 4096]), zlib.crc32(x[s : s + 4096].tobytes())) for d, x in ids.items() for s in range(0, len(x), 4096)}
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, n in sorted(b):
            assert offset == end
            end += n
        assert end <= 4096
    total = sum(map(len, ids.values()))
    assert len(bins) <= -(-total // 4096) + 1


def test_packing_of_short_documents(spark):
    """Only tokens close a bin: documents of one and of two tokens fill theirs."""
    for text, n in ((None, 4096), ("the", 2048)):
        rows = best_fit.packed_documents(spark.createDataFrame([(i, text) for i in range(n)], "doc_id long, text string")).collect()
        assert len({r["sequence_id"] for r in rows}) == 1
        assert sorted(r["offset"] for r in rows) == list(range(0, 4096, 4096 // n))


def plain_sketch(text, limit=(1 << 64) // fingerprints.SCALE):
    """Kept shingle hashes by another route: whole-number arithmetic on Python integers."""
    mask = (1 << 64) - 1

    def mix(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * by & mask
        return x ^ x >> 31

    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
    h = [xxhash.xxh3_64_intdigest(w) for w in text.encode().split()]
    n = min(5, len(h))
    out = set()
    for i in range(len(h) - n + 1 if h else 0):
        x = mix((h[i] * odd[0] + sum(mix(h[i + j] + odd[j] & mask) * odd[j] for j in range(1, n))) & mask)
        out.add(x if n == 5 else mix(x + n & mask))
    low = {x for x in out if x < limit}
    return sorted(low) if low else sorted(out)[:1]


def test_fingerprints(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in queries.op5_fingerprints(spark, sf_dir).collect()}
    text = dict(zip(docs.doc_id, docs.text))
    order = sorted(text, reverse=True)
    assert len(rows) == len(order)
    near, half = [], []
    words = lambda x: {tuple(x.split()[k : k + 5]) for k in range(max(1, len(x.split()) - 4))} if x.split() else set()

    def share(a, b, limit=(1 << 64) // fingerprints.SCALE):
        a, b = sorted((a, b), key=len)
        if not a or not b or max(a[0], b[0]) >= limit:
            return float(a == b)
        return len(set(a) & set(b)) / len(a)

    for i, d in enumerate(order):
        t, u = text[d], text[order[(i + 1) % len(order)]]
        n = len(t) // 3
        e = t[: len(t) - n] + u[:n]
        r = rows[d]
        s, es, us = (plain_sketch(x) for x in (t, e, u))
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert fingerprints.read(r["fingerprint"]).tolist() == s and fingerprints.read(r["edited_fingerprint"]).tolist() == es
        assert r["near_edited"] == share(s, es) and r["near_next"] == share(s, us)
        a, b = words(t), words(e)
        if min(len(a), len(b)) >= 20:
            near.append(abs(r["near_edited"] - len(a & b) / min(len(a), len(b))))
            half.append(abs(share(plain_sketch(t, 1 << 63), plain_sketch(e, 1 << 63), 1 << 63) - len(a & b) / min(len(a), len(b))))
    assert np.mean(near) < 0.05 and np.mean(half) < 0.03


def test_toxicity_held_out(spark):
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pandas()
    text, lang = dict(zip(docs.doc_id, docs.text)), dict(zip(docs.doc_id, docs.lang))
    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas()
    toxic = dict(zip(labels.doc_id, labels.toxic))
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = Counter((lang[r["doc_id"]], toxic[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in toxic)
    for x in ("en", "fr", "de", "es"):
        assert held[x, 1, 1] >= 0.9 * (held[x, 1, 1] + held[x, 1, 0])
        assert held[x, 0, 1] <= 0.06 * (held[x, 0, 0] + held[x, 0, 1])
    words = Counter(text[r["doc_id"]][int(a) : int(b)].lower() for r in rows if r["toxic_spans"] for a, b in (s.split("-") for s in r["toxic_spans"].split(",")))
    assert all(w.isprintable() and w.strip() == w for w in words)


def test_toxicity_scores_in_plain_python(spark, docs):
    larger = "/root/testdata/sf0.01"
    chain = toxicity.train(spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet"))
    own = spark.createDataFrame([(int(d), t) for d, t in zip(docs.doc_id, docs.text)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(own, chain).collect()}
    t, s = np.exp(chain.transitions), np.exp(chain.start)
    for d, x in zip(docs.doc_id, docs.text):
        words = re.findall(r"\w+", x)
        emit = np.exp(np.clip([chain.emission(w) for w in words], -30, 30)) if words else []
        ahead, f = [], None
        for e in emit:
            f = (s if f is None else f @ t) * np.array([1.0, e])
            f = f / f.sum()
            ahead.append(f)
        seen, b = 0.0, np.ones(2)
        for e, f in zip(emit[::-1], ahead[::-1]):
            p = (f * b / (f * b).sum())[1]
            seen += min(8.0, -np.log1p(-min(p, 1 - 1e-9))) if p >= 0.05 else 0.0
            b = t @ (np.array([1.0, e]) * b)
            b = b / b.sum()
        assert abs(got[d] - 1 / (1 + np.exp(-(chain.curve[0] + chain.curve[1] * min(16.0, seen))))) < 1e-6


def test_token_totals(spark, sf_dir, docs, ids):
    got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in queries.op4_token_counts(spark, sf_dir).collect()}
    want: Counter = Counter()
    n: Counter = Counter()
    for d, s, lang, t in zip(docs.doc_id, docs.source, docs.lang, docs.text):
        for v, k in (("words-1", len(t.split())), ("word_bpe_49k-1", len(ids[d]) - 1)):
            want[s, lang, v] += k
            n[s, lang, v] += 1
    assert got == {k: (n[k], want[k]) for k in n}


def test_packing_rules():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 4097, 500)
    for rule in ("norm", "dot"):
        bins, offsets = best_fit.place(lengths, documents=3, rule=rule)
        for k in set(bins.tolist()):
            own = bins == k
            assert lengths[own].sum() <= 4096 and own.sum() <= 3
            o = np.argsort(offsets[own])
            assert (offsets[own][o] == np.concatenate([[0], np.cumsum(lengths[own][o])[:-1]])).all()
    bins, _ = best_fit.place(np.full(10, 100), attention=20_000.0)
    assert max(Counter(bins.tolist()).values()) == 2


def test_chain_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    e, t, s = rng.normal(size=9), rng.normal(size=(2, 2)), rng.normal(size=2)
    first = np.zeros(9, dtype=bool)
    first[[0, 4]] = True
    post, pair = toxicity.marginals(e, first, t, s, edges=True)
    total, ones, edges = 0.0, np.zeros(9), np.zeros((2, 2))
    for code in range(1 << 9):
        y = [(code >> i) & 1 for i in range(9)]
        w = np.exp(sum((s[y[i]] if first[i] else t[y[i - 1], y[i]]) + e[i] * y[i] for i in range(9)))
        total += w
        ones += w * np.array(y)
        for i in range(9):
            if not first[i]:
                edges[y[i - 1], y[i]] += w
    assert np.allclose(post, ones / total) and np.allclose(pair, edges / total)
