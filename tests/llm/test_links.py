"""Every direct link of the Jaccard join, counted by documents, against all pairs in plain Python."""

import random

import pytest

from lamella.llm import jaccard_join, queries

SCHEMA = "doc_id long, text string"


def brute(rows):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    return sorted((str(d), len(s), sum(1 for j, t in enumerate(sets) if i != j and s and 100 * len(s & t) >= 75 * len(s | t))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("shard", [4, 512])
def test_links(spark, monkeypatch, shard):
    monkeypatch.setattr(jaccard_join, "SHARD", shard)
    r = random.Random(5)
    rows = [(1000, None), (1001, ""), (None, "a b"), (1002, "A B")]
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(120)]
        for i in range(12):
            words = list(base)
            for _ in range(r.randint(0, 5)):
                words[r.randrange(120)] = f"x{r.randrange(10**6)}"
            rows.append((family * 100 + i, " ".join(words)))
    rows += [rows[10], (500, rows[10][1]), (501, rows[10][1].upper())]
    got = sorted((str(x["doc_id"]), x["n_shingles"], x["n_links"]) for x in jaccard_join.jaccard_links(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)
    assert max(n for *_, n in got) > 5


def plain_components(rows):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(t) for d, t in rows}
    comp = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {d: low if c == high else c for d, c in comp.items()}
    return sorted(comp.items())


@pytest.mark.parametrize("shard,items", [(4, 1 << 20), (512, 300), (512, 1 << 20)])
def test_components_of_cut_families(spark, monkeypatch, shard, items):
    """Chains of texts, each linked with its neighbours alone, in families of many shards."""
    monkeypatch.setattr(jaccard_join, "SHARD", shard)
    monkeypatch.setattr(jaccard_join, "SHARD_ITEMS", items)
    r, rows = random.Random(3), []
    for family in range(3):
        words = [f"f{family}w{i}" for i in range(100)]
        for i in range(20):
            rows.append((family * 100 + r.randrange(100) * 1000 + i, " ".join(words)))
            words = words[4:] + [f"f{family}x{i}y{j}" for j in range(4)]
    rows.append((7, None))
    got = sorted((x["doc_id"], x["component_id"]) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == plain_components(rows)


def test_sets_of_one_first_digest(spark, monkeypatch):
    """Different sets that share their first digest stay apart."""
    own = jaccard_join.digests_of
    assert own(jaccard_join.shingle_set(b"a b c d e f")) != own(jaccard_join.shingle_set(b"a b c d e g"))
    d = spark.createDataFrame([(1, 5, 10, 3, b"x"), (2, 5, 11, 3, b"x"), (3, 6, 12, 3, b"x")], "doc_id long, digest long, second long, n int, sig binary")
    clashes = jaccard_join.clashes_of(d)
    assert clashes == frozenset([5])
    assert sorted((x["doc_id"], x["digest"]) for x in jaccard_join.identified(d, clashes).collect()) == [(1, 10), (2, 11), (3, 6)]
    assert jaccard_join.identity((5, 10), clashes) == 10 and jaccard_join.identity((6, 12), clashes) == 6


def test_no_rows(spark):
    assert jaccard_join.jaccard_links(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, sf_dir):
    docs = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op8_jaccard_links"](spark, sf_dir).collect()
    assert sorted((str(x["doc_id"]), x["n_shingles"], x["n_links"]) for x in got) == brute(docs)
