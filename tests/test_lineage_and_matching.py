"""Lines of history through renames and moves, chains of any length, and greedy choices in few rounds."""

import random

import pytest
from pyspark.sql import functions as F

from lamella import storage
from lamella.operators import lineage, matching

SCHEMA = "version long, file_path string, id string, name string, parent_id string, content_hash string, structural_hash string, start_line long"


def plain_line(files, v, e):
    """The predecessor by the rules, one entity at a time; ``files`` maps path to {version: entities}."""
    touched = sorted(p for p, vs in files.items() if v in vs)
    before = {p: next((u for u in sorted(files[p], reverse=True) if u < v), None) for p in touched}
    order = [e[0], *[p for p in touched if p != e[0]]]
    for at in (2, 4):
        for p in order:
            if before.get(p) is not None:
                for x in sorted(files[p][before[p]], key=lambda x: (x[5], x[1])):
                    if e[at] is not None and x[at] == e[at]:
                        return before[p], x
    return None


def test_histories_against_plain_rules(spark):
    rng = random.Random(3)
    files = {f"f{i}": {} for i in range(5)}
    for v in range(1, 9):
        for p in files:
            if v == 1 or rng.random() < 0.6:
                n = rng.randrange(4)
                names = [rng.choice(["a", "b", "c", "d", None]) for _ in range(n)]
                files[p][v] = [(p, f"{p}::{k}::{names[k]}", names[k], f"c{rng.randrange(9)}", rng.choice(["s0", "s1", "s2", "s3", None]), k + 1) for k in range(n)]
    rows = [(v, e[0], e[1], e[2], None, e[3], e[4], e[5]) for p, vs in files.items() for v, es in vs.items() for e in es]
    touched = [(v, p) for p, vs in files.items() for v in vs]
    entities, changed = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(touched, "version long, file_path string")
    links = {(r["version"], r["a"]["id"]): (r["was"], r["b"]["id"]) if r["b"] else None for r in lineage.predecessors(entities, changed).collect() if r["a"]}
    want = {}
    for p, vs in files.items():
        for v, es in vs.items():
            for e in es:
                found = plain_line(files, v, e)
                want[v, e[1]] = (found[0], found[1][1]) if found else None
    assert links == want
    first = {(r["version"], r["id"]): (r["first_version"], r["first_id"]) for r in lineage.firsts(lineage.predecessors(entities, changed)).collect()}
    for k in want:
        at = k
        while want[at]:
            at = want[at]
        assert first[k] == at


def test_one_line_through_renames_moves_and_deletion(spark):
    rows = [(1, "a.py", "a.py::f", "f", None, "c1", "s", 1), (1, "b.py", "b.py::x", "x", None, "c", "t", 1), (2, "a.py", "a.py::g", "g", None, "c2", "s", 4), (3, "b.py", "b.py::x", "x", None, "c", "t", 1), (3, "b.py", "b.py::g", "g", None, "c2", "s", 9), (4, "b.py", "b.py::x", "x", None, "c", "t", 1), (4, "b.py", "b.py::h", "h", None, "c3", "s", 9), (5, "b.py", "b.py::h", "h", None, "c4", "s2", 9)]
    touched = [(1, "a.py"), (1, "b.py"), (2, "a.py"), (3, "a.py"), (3, "b.py"), (4, "b.py"), (5, "b.py")]
    d, t = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(touched, "version long, file_path string")
    got = [tuple(r) for r in lineage.history_of(d, t, "b.py::h").select("version", "id", "change", "logic").collect()]
    assert got == [(1, "a.py::f", "added", False), (2, "a.py::g", "renamed", False), (3, "b.py::g", "moved", False), (4, "b.py::h", "renamed", False), (5, "b.py::h", "modified", True)]
    assert [tuple(r) for r in lineage.history_of(d, t, "b.py::x").select("version", "change").collect()] == [(1, "added"), (5, "deleted")]
    assert lineage.histories(d.limit(0), t.limit(0)).count() == 0


def test_chains_of_any_length_and_circles(spark):
    n = 1000
    rows = [(f"n{i}", f"n{i - 1}" if i else None, f"m{i}") for i in range(n)]
    rows += [("x", "z", "X"), ("y", "x", "Y"), ("z", "y", "Z"), ("w", "x", "W"), ("v", "w", "V"), ("o", "lost", "O")]
    d = spark.createDataFrame(rows, "id string, parent_id string, name string")
    got = dict(tuple(r) for r in matching.parent_chains(d).collect())
    assert got["n999"] == "::".join(f"m{i}" for i in range(999)) and got["n0"] is None and got["o"] is None
    assert got["x"] is got["y"] is got["z"] is None and got["w"] == "X" and got["v"] == "X::W"
    depth = dict(tuple(r) for r in matching.depths(d).collect())
    assert depth["n999"] == 999 and depth["v"] == 2 and depth["x"] == 0


def plain_greedy(pairs):
    a, b, out = set(), set(), []
    for x, y, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            out.append((x, y))
    return sorted(out)


@pytest.mark.parametrize("bound", [500_000, 3])
def test_greedy_choices(spark, monkeypatch, bound):
    monkeypatch.setattr(matching, "COMPONENT", bound)
    rng = random.Random(8)
    pairs = [(a, b, rng.randrange(6)) for a in range(60) for b in rng.sample(range(60), 4)]
    d = spark.createDataFrame(pairs, "a_id long, b_id long, s long")
    assert sorted(map(tuple, matching.greedy(d, [-F.col("s")]).collect())) == plain_greedy(pairs)


def test_greedy_over_a_long_chain(spark):
    n = 10_000
    pairs = [(i, i, 2 * i) for i in range(n)] + [(i + 1, i, 2 * i + 1) for i in range(n - 1)]
    d = spark.createDataFrame(pairs, "a_id long, b_id long, s long")
    before = len(storage._made)
    out = matching.greedy(d, [-F.col("s")])
    assert sorted(map(tuple, out.collect())) == plain_greedy(pairs)
    assert len(storage._made) <= before + 4
