"""What a task holds follows the counted rows: more rows are dealt over more tasks, with the same results."""

from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from lamella import storage
from lamella.operators import history, lineage, matching


def _kept(monkeypatch, module) -> dict[str, int]:
    """Partitions of what ``module`` writes, by label, when a task is to hold 20 rows."""
    seen = {}

    def cut(df, label="step"):
        seen[label] = df.rdd.getNumPartitions()
        return storage.cut(df, label)

    monkeypatch.setattr(storage, "HELD_ROWS", 20)
    monkeypatch.setattr(module, "cut", cut)
    return seen


def test_co_changes_dealt_by_rows(spark, monkeypatch):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(f"e{(i * 7 + j * j) % 11}", f"c{i}") for i in range(20 * tasks) for j in range(4)]
    rows += [("e1", None), (None, "c1"), *[(f"w{j}", "wide") for j in range(51)]]
    seen = _kept(monkeypatch, history)
    got = {(r["a"], r["b"]): (r["together"], r["commits_a"], r["commits_b"]) for r in history.co_changes(spark.createDataFrame(rows, "entity string, sha string")).collect()}
    sets = {}
    for e, c in set(rows):
        if e and c and c != "wide":
            sets.setdefault(c, set()).add(e)
    pairs, alone = Counter(), Counter()
    for s in sets.values():
        pairs.update(combinations(sorted(s), 2))
        alone.update(s)
    assert got == {p: (n, alone[p[0]], alone[p[1]]) for p, n in pairs.items() if n > 1}
    assert seen["sets"] > tasks
    assert spark.conf.get("spark.sql.shuffle.partitions") == str(tasks)


def _shuffled(monkeypatch, module) -> dict[str, int]:
    """Shuffle partitions under which ``module`` writes its tables, by label, when a task is to hold 20 rows."""
    seen = {}

    def cut(df, label="step"):
        seen[label] = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return storage.cut(df, label)

    monkeypatch.setattr(storage, "HELD_ROWS", 20)
    monkeypatch.setattr(module, "cut", cut)
    return seen


def test_hotspots_dealt_by_rows(spark, monkeypatch):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = spark.range(21 * tasks).selectExpr("id % 3 as entity", "id as sha", "id % 5 as author", "id % 7 as committed_at")
    seen = _shuffled(monkeypatch, history)
    got = {r["entity"]: (r["commits"], r["authors"], r["newest"]) for r in history.hotspots(d).collect()}
    assert got == {e: (7 * tasks, 5, max((s % 7, s) for s in range(21 * tasks) if s % 3 == e)[1]) for e in range(3)}
    assert seen["hotspots"] > tasks
    assert spark.conf.get("spark.sql.shuffle.partitions") == str(tasks)


def test_lines_dealt_by_rows(spark, monkeypatch):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = 11 * tasks
    rows = [(v, f"f::{i}", "f", f"n{i}", None, f"c{i}{v}", f"s{i}", i) for v in (1, 2) for i in range(k)]
    entities = spark.createDataFrame(rows, "version long, id string, file_path string, name string, parent_id string, content_hash string, structural_hash string, start_line int")
    seen = _shuffled(monkeypatch, lineage)
    got = lineage.histories(entities, entities.select("version", "file_path")).groupBy("first_version", "version", "change").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, "added", k), (1, 2, "modified", k)]
    assert min(seen[x] for x in ("tried", "links", "lines", "changes")) >= tasks
    assert seen["changes"] > tasks and seen["tried"] > tasks


def test_wide_rows_are_not_broadcast(spark):
    d = spark.range(1000).select("id", F.repeat(F.col("id").cast("string"), 20_000).alias("text"))
    plan = lambda t: storage.near(t)._jdf.queryExecution().analyzed().toString()
    t = storage.cut(d)
    assert "strategy=broadcast" not in plan(t)
    assert "strategy=broadcast" in plan(t.select("id"))


def test_reordered_needs_the_first_phase_alone(spark):
    names = ", ".join(f"{c} {'long' if c.endswith('_line') else 'string'}" for c in matching.FIELDS)
    side = lambda lines: spark.createDataFrame([(f"f::{n}", "f", "function", n, None, n, n, n, at, at) for n, at in lines], names)
    before, after = side([("a", 1), ("b", 2), ("c", 3), ("old", 4)]), side([("b", 1), ("c", 2), ("a", 3), ("new", 4)])
    assert [r["id"] for r in matching.reordered_ids(storage.cut(matching.by_id(before, after))).collect()] == ["f::a"]
