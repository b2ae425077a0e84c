"""The hash ring against keys entered one by one, and the filter audit against plain sets of rows."""

import itertools
import struct
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
import xxhash

from lamella.llm import filter_audit, hash_ring, queries

MASK = (1 << 64) - 1


def spark_hash(*values):
    """What ``xxhash64`` gives for an int and longs; nulls change nothing."""
    h = 42
    for v, fmt in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack(fmt, v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def one_by_one(rows, shards, load, room):
    """``(doc_id, size, crc)`` rows entered in their order, each at the first shard clockwise with room."""
    ring = sorted((xxhash.xxh64_intdigest(f"{s}/{k}", seed=13) - (1 << 63), s) for s in range(shards) for k in range(hash_ring.NODES))

    def arc(d):
        h = spark_hash((11, "<i"), (d, "<q"))
        return next((i for i, (p, _) in enumerate(ring) if p >= h), 0)

    def order(r):
        d, size, crc = r
        bucket = ((spark_hash((12, "<i"), (d, "<q")) & MASK) >> 32) * hash_ring.BUCKETS >> 32
        return bucket, arc(d), spark_hash((d, "<q"), (size, "<q"), (crc, "<q")) % hash_ring.PARTS, d is not None, d or 0, size, crc

    used, out = [0] * shards, []
    for r in sorted(rows, key=order):
        a = arc(r[0])
        s = next(x for x in itertools.islice(itertools.cycle([s for _, s in ring]), a, a + len(ring)) if used[x] < room[x])
        out.append((*r, s, used[s]))
        used[s] += load(r)
    return out


def key(r):
    return tuple((x is not None, x or 0) for x in r)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_ring_over_whole_table(spark, sf):
    got = queries.op11_hash_ring(spark, f"/root/testdata/{sf}").collect()
    docs = pq.read_table(f"/root/testdata/{sf}/documents.parquet").to_pandas()
    rows = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in zip(docs.doc_id.tolist(), docs.text)]
    share, more = divmod(len(rows), 40)
    want = one_by_one(rows, 40, lambda r: 1, [share + (s < more) for s in range(40)])
    assert sorted(tuple(r[c] for c in ("doc_id", "size", "text_crc32", "shard", "slot")) for r in got) == sorted(want)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(40)) <= 1
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


SCHEMA = "doc_id long, text string, shard string, size int"
ROWS = [(None, None, "x", 1), (None, "a", "x", 1), (3, "", None, None), (4, "é", "x", 1), (4, "é", "x", 1), *[(7, "same", "x", 1)] * 500, *[(7, f"other {i}", "x", 1) for i in range(300)], *[(i, "t" * (i % 90), "x", 1) for i in range(100, 700)]]


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_ring_cases(spark, law):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    plain = hash_ring.sharded(docs, 6, law).collect()
    split = hash_ring.sharded(docs, 6, law, hot_rows=20).collect()
    rows = lambda x: sorted((key(tuple(r)) for r in x))
    assert rows(plain) == rows(split) and len(plain) == len(ROWS)
    slots = defaultdict(list)
    for r in plain:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    if law == "rows":
        sizes = [len(x) for x in slots.values()]
        assert max(sizes) - min(sizes) <= 1
        want = one_by_one([(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS], 6, lambda r: 1, [len(ROWS) // 6 + (s < len(ROWS) % 6) for s in range(6)])
        assert rows(plain) == sorted(key(r) for r in want)
    else:
        sizes = Counter()
        for r in plain:
            sizes[r["shard"]] += r["size"]
        assert max(sizes.values()) - min(sizes.values()) <= 4 * max(r["size"] for r in plain)
    assert hash_ring.sharded(spark.createDataFrame([], SCHEMA), 6, law).count() == 0
    assert hash_ring.sharded(spark.createDataFrame(ROWS[:3], SCHEMA), 6, law).count() == 3


def test_ring_moves_few(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    shards = lambda n, slack: {r["doc_id"]: r["shard"] for r in hash_ring.sharded(docs, n, slack=slack).select("doc_id", "shard").collect()}
    for slack, most in ((0.0, 0.08), (0.25, 0.04)):
        a, b = shards(40, slack), shards(41, slack)
        assert sum(a[d] != b[d] for d in a) <= most * len(a)
        assert max(Counter(b.values()).values()) <= len(b) * (1 + slack) / 41 + 1


def test_audit_cases(spark):
    words = " ".join(f"w{i}" for i in range(120))
    rows = [(1, words, "en", 1), (2, words, "en", 1), (2, words, None, 1), (2, words, "", 1), (None, words, "en", 1), (3, None, "en", 1), (4, "", "fr", 1), (5, "A" * 50 + " b", "fr", 1), (6, words + " #", "en", 1), (7, "a " * 200, "en", 1), (8, "Éé" * 9, "de", 1), (0, None, "de", 1)]
    marks = [(1, 1, 0), (2, None, 1), (2, 1, None), (3, 0, 1), (9, 1, 1), (None, 1, 1), (7, 1, 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, E int, digest string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    facts = []
    for d, t, part, _ in rows:
        t = t or ""
        w = t.split()
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), d is not None and d > first[t]]
        own = [m for m in marks if d is not None and m[0] == d]
        facts.append((part or "", fails, any(m[1] == 1 for m in own), any(m[2] == 1 for m in own)))
    want = {}
    for part in {f[0] for f in facts}:
        own, shares = [f for f in facts if f[0] == part], Counter()
        for order in itertools.permutations(range(5)):
            left = own
            for step, k in enumerate(order):
                gone = [f for f in left if f[1][k]]
                left = [f for f in left if not f[1][k]]
                shares[k] += len(gone)
                fails = sum(f[1][k] for f in own)
                want[part, "".join("ABCDE"[j] for j in order), step + 1] = [len(left), len(gone), fails - len(gone), sum(f[1][k] and sum(f[1]) == 1 for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone), k]
        for k, v in want.items():
            if k[0] == part:
                v[-1] = shares[v[-1]]
    got = filter_audit.audit(docs, labels).collect()
    columns = ("kept", "removed", "redundant", "unique_fails", "quality_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in got} == want and len(got) == len(want)
    assert filter_audit.audit(docs.limit(0), labels.limit(0)).count() == 0
    flags = filter_audit.flagged(docs.repartition(3), labels, heavy=1)
    small = filter_audit.prefix_counts(flags, chunk=2)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, filter_audit.prefix_counts(flags).collect()))


def test_heavy_groups(spark):
    rows = [(i, "same text" if i % 2 else f"own {i}", "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    flags = filter_audit.flagged(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), heavy=10)
    assert flags.filter("E").count() == 1999
