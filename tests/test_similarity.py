"""Pairs alike are those of all pairs compared, and texts that share a rare word only are not brought together."""

import random
from itertools import combinations

import pytest

from lamella import storage
from lamella.operators import similarity
from lamella.plans import registry
from tests.oracle import same_rows


def _alike(x: str, y: str, percent: int) -> int:
    a, b = set(x.split()), set(y.split())
    return len(a & b) if 100 * len(a & b) >= percent * len(a | b) else 0


def _texts(n: int) -> list[str]:
    draw, out = random.Random(4), []
    while len(out) < n:
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice((1, 2, 3, 5, 8, 20, 60, 150)))]
        for _ in range(3):
            out.append(" ".join(words))
            words = [w if draw.random() > 0.06 else f"w{draw.randrange(400)}" for w in words] + [f"w{draw.randrange(400)}"] * draw.randrange(2)
    return out[:n]


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_pairs_as_all_pairs_compared(spark, monkeypatch, percent):
    monkeypatch.setattr(similarity, "TILE", 7)
    monkeypatch.setattr(similarity, "SLICE", 300)
    rows = [(i, "xy"[i % 17 == 0], t) for i, t in enumerate(_texts(240))] + [(900, "x", None), (901, "x", " \n"), (902, None, "one two"), (903, None, "one two")]
    d = spark.createDataFrame(rows, "k long, b string, t string")
    got = sorted((r["a"], r["b"], r["both"]) for r in similarity.candidates(d, "k", "t", "b", percent).collect())
    want = [(a, b, n) for (a, p, x), (b, q, y) in combinations(rows[:240], 2) if p == q and (n := _alike(x, y, percent))]
    assert got == want and len(want) > 40


def test_sides_and_keys_of_parts(spark):
    texts = _texts(90)
    d = spark.createDataFrame([((i % 2, f"id{i}"), i % 2, "x", t) for i, t in enumerate(texts)], "k struct<s:int,id:string>, s int, b string, t string")
    got = sorted((r["a"]["id"], r["b"]["id"], r["both"]) for r in similarity.candidates(d, "k", "t", "b", 80, side="s").collect())
    assert got == sorted((f"id{i}", f"id{j}", n) for i in range(0, 90, 2) for j in range(1, 90, 2) if (n := _alike(texts[i], texts[j], 80)))


def test_repeated_keys_pair_each(spark):
    d = spark.createDataFrame([(1, "x", "a b c d e"), (1, "x", "a b c d e f"), (2, "x", "e d c b a")], "k long, b string, t string")
    assert sorted((r["a"], r["b"], r["both"], r["na"], r["nb"]) for r in similarity.candidates(d, "k", "t", "b").collect()) == [(1, 2, 5, 5, 5), (1, 2, 5, 6, 5)]


def test_a_shared_rare_word_is_not_enough(spark, monkeypatch):
    seen = {}

    def cut(df, label="step"):
        out = storage.cut(df, label)
        seen[label] = out.count()
        return out

    monkeypatch.setattr(similarity, "cut", cut)
    rows = [(i, "x", " ".join(f"{min(i, j)}-{max(i, j)}" for j in range(60) if j != i)) for i in range(60)] + [(60, "x", "p q r s t u"), (61, "x", "p q r s t")]
    got = similarity.candidates(spark.createDataFrame(rows, "k long, b string, t string"), "k", "t", "b").collect()
    assert [(r["a"], r["b"], r["both"]) for r in got] == [(60, 61, 5)]
    assert seen["pairs"] == seen["likely"] == 1


def test_words_of_long_texts(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500)).encode() + b"\n\n\tword7 end"
    whole = similarity.word_set(text).tolist()
    monkeypatch.setattr(similarity, "SLICE", 11)
    assert similarity.word_set(text).tolist() == whole and len(whole) == 501


def test_pairs_of_rows_hold_all_copies(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 4)
    texts = _texts(60)
    texts += [" ".join(reversed(t.split())) for t in texts[:20]] + ["p q r s t u"] * 11 + ["u t s r q p q", "p q r s t"] * 5
    rows = [(7 * i % 211, "xy"[i % 17 == 0], t) for i, t in enumerate(texts)] + [(900, "x", ""), (901, "x", " \n"), (902, "y", ""), (903, "x", None), (904, None, "p q r s t"), (905, None, ""), (906, None, "")]
    got = sorted(map(tuple, similarity.row_pairs(spark.createDataFrame(rows, "k long, b string, t string"), "k", "t", "b").collect()))
    sets = sorted((k, b, set(t.split())) for k, b, t in rows if b is not None and t is not None)
    want = [(a, b, len(x & y), len(x), len(y)) for (a, p, x), (b, q, y) in combinations(sets, 2) if p == q and 100 * len(x & y) >= 80 * len(x | y)]
    assert got == want and (900, 901, 0, 0, 0) in got


def test_copies_are_pairs_in_the_query(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(["a b c d e"] * 3 + ["a b c d e f", "", "\t", "z"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    (file,) = (tmp_path / "documents.parquet").glob("part-*")
    table = tmp_path / "in"
    table.mkdir()
    (table / "documents.parquet").write_bytes(file.read_bytes())
    found = registry.queries()["fuzzy_match_candidates"](spark, str(table))
    assert found.count() == 7
    same_rows(found, registry.oracle_sql()["fuzzy_match_candidates"], str(table))
