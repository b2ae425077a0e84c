"""Operators on small inputs."""

import pytest

import __spark_entry__
from lamella.functions import predicates as P
from lamella.functions import text as T
from lamella.operators import diff, entities, graph, history, search
from lamella.sources import git_text
from lamella.streaming import incremental


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_headings(spark):
    d = spark.createDataFrame([("a.md", "intro\n# One\ntext\n## Two\nx\n# Three\n")], "p string, t string")
    got = rows(entities.headings(d, "p", "t").select("name", "level", "start_line", "end_line", "parent_name"), "start_line")
    assert got == [("One", 1, 2, 5, None), ("Two", 2, 4, 5, "One"), ("Three", 1, 6, 6, None)]


def test_chunks_of_empty_and_long_texts(spark):
    d = spark.createDataFrame([(1, ""), (2, None), (3, "\n".join(map(str, range(41))) + "\n")], "p int, t string")
    assert rows(entities.chunks(d, "p", "t").select("file_path", "start_line", "end_line")) == [(3, 1, 20), (3, 21, 40), (3, 41, 41)]


def test_lnds():
    assert diff.longest_non_decreasing([3, 1, 2, 2, 5, 4]) in ({1, 2, 3, 4}, {1, 2, 3, 5})
    assert diff.longest_non_decreasing([]) == set()


def test_cosmetic_filter_keeps_unknown(spark):
    d = spark.createDataFrame([(1, None, "modified"), (2, False, "modified"), (3, True, "modified"), (4, False, "moved")], "id int, structural_change boolean, change_type string")
    assert [r[0] for r in rows(diff.not_cosmetic(d).select("id"))] == [1, 3, 4]


def test_reach_over_a_cycle(spark):
    e = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("d", "a", "calls")], "from_entity string, to_entity string, ref_type string")
    start = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.reach(e, start), "depth", "id") == [("c", 1), ("d", 1), ("b", 2)]
    assert rows(graph.reach(e, start, reverse=False, depth=1)) == [("b", 1)]
    assert graph.reach(e, start, most=1).count() == 1


def test_history_shape(spark):
    c = spark.createDataFrame([(1, "x", 1, "f"), (1, "x", 1, "g"), (2, "x", 2, "f"), (2, "y", 2, "g"), (3, "y", 3, "f")], "sha int, author string, committed_at int, entity string")
    assert rows(history.hotspots(c), "entity") == [("f", 3, 2, 3), ("g", 2, 2, 2)]
    assert rows(history.co_changes(c)) == [("f", "g", 2, 3, 2, 1.0)]


def test_blame_prefers_uncommitted(spark):
    d = spark.createDataFrame([("e", 1, "a", 5), ("e", 2, None, None), ("e", 3, "b", 9), ("f", 1, "a", 5), ("f", 2, "b", 5)], "e string, line int, sha string, t int")
    assert rows(history.entity_blame(d, "e", "line", "sha", "t"), "e") == [("e", None, 2), ("f", "a", 1)]


def test_paths(spark):
    d = spark.createDataFrame([(p,) for p in ("src/a.py", "dist/x.js", "src/dist/x.js", "a/vendor/b.go", "x.min.js", "lib/Foo.framework/Foo", "a/b_test.go", "spec/a.rb", "contest/a.py")], "p string")
    got = {r[0]: tuple(r)[1:] for r in d.select("p", P.default_excluded(d.p), P.probably_binary(d.p), P.test_path(d.p)).collect()}
    assert [p for p, v in got.items() if v[0]] == ["dist/x.js", "a/vendor/b.go", "x.min.js"]
    assert [p for p, v in got.items() if v[1]] == ["lib/Foo.framework/Foo"]
    assert [p for p, v in got.items() if v[2]] == ["a/b_test.go", "spec/a.rb"]
    import re

    assert re.match(P.glob_regex("src/**/*.py"), "src/a/b.py") and re.match(P.glob_regex("src/**/*.py"), "src/b.py") and not re.match(P.glob_regex("src/*.py"), "src/a/b.py")
    assert re.match(P.glob_regex("docs"), "docs/x") and re.match(P.glob_regex("[!a]?.c"), "bb.c")


def test_remote_urls(spark):
    d = spark.createDataFrame([("git@Host.org:a/b.git",), ("https://host.org/a/b",), ("ssh://git@host.org/a/b.git/",)], "u string")
    assert {r[0] for r in d.select(T.remote_url(d.u)).collect()} == {"host.org/a/b"}


def test_packing_skips_and_goes_on(spark):
    d = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40)], "g int, o int, n int")
    assert [r[3] for r in rows(search.packed(d, "g", "o", "n", 100), "o")] == [True, False, True]


def test_patch():
    text = 'diff --git a/x.txt b/y.txt\nsimilarity index 90%\nrename from x.txt\nrename to y.txt\n--- a/x.txt\n+++ b/y.txt\n@@ -1,2 +1,2 @@\n one\n-two\n+2\ndiff --git a/n b/n\nnew file mode 100644\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+hi\ndiff --git a/p.png b/p.png\nBinary files a/p.png and b/p.png differ\n'
    got = git_text.patch(text)
    assert [(r["file_path"], r["status"], r["old_file_path"], r["before_content"], r["after_content"]) for r in got] == [("y.txt", "renamed", "x.txt", "one\ntwo\n", "one\n2\n"), ("n", "added", None, None, "hi\n"), ("p.png", "modified", None, None, None)]
    assert git_text.name_status("M\0a\0R100\0b\0c\0D\0d\0") == [("a", "modified", None), ("c", "renamed", "b"), ("d", "deleted", None)]


def test_blame_text():
    sha = "a" * 40
    text = f"{sha} 1 1 1\nauthor Ann\nauthor-time 12\nsummary first\n\tline\n{'0' * 40} 2 2\nauthor Not Committed Yet\nauthor-time 99\nsummary x\n\tmore"
    assert git_text.blame_porcelain(text) == [(1, sha, "Ann", 12, "first"), (2, None, "Not Committed Yet", None, "x")]


def test_commit_index_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    d = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "sha int, m string")
    d.write.parquet(src)
    incremental.index_commits(spark, src, "sha int, m string", out, cp)
    spark.createDataFrame([(2, "b"), (3, "c")], "sha int, m string").write.mode("append").parquet(src)
    incremental.index_commits(spark, src, "sha int, m string", out, cp)
    assert sorted(r[0] for r in spark.read.parquet(out).select("sha").collect()) == [1, 2, 3]


def test_json_source(spark):
    d = spark.createDataFrame([('[{"filePath":"a","status":"added","afterContent":"x"}]',)], "j string")
    assert rows(git_text.file_changes_json(d, "j")) == [("a", "added", None, None, "x")]


def test_patch_without_final_newline_and_faults():
    head = "--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n"
    got = git_text.patch(head + " one\n-two\n\\ No newline at end of file\n+2\n")
    assert [(r["before_content"], r["after_content"]) for r in got] == [("one\ntwo", "one\n2\n")]
    assert git_text.patch("") == []
    for bad in (head + " one\n-two", "hello\n", head + "!x\n", "--- a/f\n+++ b/f\n@@ nonsense @@\n"):
        with pytest.raises(ValueError):
            git_text.patch(bad)


def test_json_source_is_strict(spark):
    for bad in ('[{"filePath":"a","status":"added","extra":"x"}]', '[{"status":"added"}]', '[{"filePath":"a","status":"odd"}]', "[{"):
        with pytest.raises(Exception, match="unknown|no filePath|MALFORMED|Malformed"):
            git_text.file_changes_json(spark.createDataFrame([(bad,)], "j string"), "j").collect()
    assert git_text.file_changes_json(spark.createDataFrame([(None,)], "j string"), "j").collect() == []


def test_commit_index_replays_a_batch(spark, tmp_path):
    import glob
    import os

    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([(1, "a"), (2, "b")], "sha int, m string").write.parquet(src)
    incremental.index_commits(spark, src, "sha int, m string", out, cp)
    for f in glob.glob(f"{cp}/commits/*") + glob.glob(f"{cp}/commits/.*crc"):
        os.remove(f)
    incremental.index_commits(spark, src, "sha int, m string", out, cp)
    assert sorted(r[0] for r in spark.read.parquet(out).select("sha").collect()) == [1, 2]


def test_nested_headings(spark):
    text = "# A\n### B\n## C\n#### D\n## E\n# F\n"
    d = spark.createDataFrame([("m", text), ("n", None), ("o", "plain")], "p string, t string")
    got = rows(entities.headings(d, "p", "t").select("name", "start_line", "end_line", "parent_name"), "start_line")
    assert got == [("A", 1, 5, None), ("B", 2, 2, "A"), ("C", 3, 4, "A"), ("D", 4, 4, "C"), ("E", 5, 5, "A"), ("F", 6, 6, None)]


@pytest.mark.parametrize("depth", [0, 2])
def test_reach_of_many_starts(spark, depth):
    import random

    rng = random.Random(4)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(260)] + [(3, 3), (None, 4), (5, None)]
    edges = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "from_entity long, to_entity long, ref_type string")
    starts = spark.createDataFrame([(i,) for i in [*range(140), 7, 999, None]], "id long")
    out = {}
    for s in range(140):
        at, seen, step = {s}, {s}, 0
        while at and (not depth or step < depth):
            step += 1
            at = {a for a, b in pairs if b in at and a is not None} - seen
            seen |= at
            out |= {(s, x): step for x in at}
    got = graph.reach_many(edges, starts, depth=depth).collect()
    assert {(r["start"], r["id"]): r["depth"] for r in got} == out and len(got) == len(out)


def test_extension_order_is_an_order(spark, sf_dir):
    from lamella.plans import registry

    got = [tuple(r) for r in registry.queries()["extension_order"](spark, sf_dir).select("rank", "path").collect()]
    assert got == sorted(got) and len(got) > 30


def test_context_of_a_target_too_large(spark):
    from lamella.operators import context

    nodes = spark.createDataFrame([("big", "big", "a.py", "def big():\n" + "\n".join(f"  line {i} of many" for i in range(60))), ("d", "d", "a.py", "def d(): pass"), ("lost", "lost", "b.py", None)], "id string, name string, file_path string, content string")
    edges = spark.createDataFrame([("big", "d", "calls"), ("lost", "big", "calls")], "from_entity string, to_entity string, ref_type string")
    got = context.packed(nodes, edges, "big", 100)["entries"].collect()
    assert [(r["entity_id"], r["form"]) for r in got] == [("big", "head"), ("d", "full"), ("lost", "full")]
    assert "truncated" in got[0]["content"] and got[0]["tokens"] <= 70
    assert context.packed(nodes, edges, "unknown", 100)["entries"].count() == 0
    many = context.packed_many(nodes, edges, spark.createDataFrame([("big",), ("d",), ("unknown",)], "id string"), 100)
    assert {r["target"] for r in many["entries"].collect()} == {"big", "d"}


def test_similarity_classes(spark):
    from lamella.operators import similarity

    rows = [(i, "same words here", "x", 1) for i in range(2500)] + [(3000, "here words same same", "x", 1), (3001, "same words here", "y", 1), (3002, "same words here", None, 1), (3003, "here same words", None, 1), (3004, None, "x", 1), (3005, " ", "x", 1), (3006, "same words here now", "x", 1), (3007, "now here words same", "x", 1)]
    d = spark.createDataFrame(rows, "k long, t string, b string, rep int")
    got = {r["k"]: r["representative"] for r in similarity.classes(d, "k", "t", "b").collect()}
    assert got == {**{i: 0 for i in range(2500)}, 3000: 0, 3001: 3001, 3002: 3002, 3003: 3002, 3006: 3006, 3007: 3006}
    members, pairs = similarity.class_pairs(d, "k", "t", "b", 75)
    assert [(r["a"], r["b"], r["both"]) for r in pairs.collect()] == [(0, 3006, 3)] and members.count() == len(got)


def test_commit_keys_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "FOLDERS", 3)
    index = lambda: incremental.KeyIndex(spark, f"file://{tmp_path}/keys", "sha", "string")
    rows = lambda *keys: spark.createDataFrame([(k, 1) for k in keys], "sha string, n int")
    seen = set()
    for batch in range(9):
        keys = [f"k{batch}", f"k{batch // 2}", None]
        new = index().unknown(rows(*keys), batch)
        got = {r["sha"] for r in new.collect()}
        assert got == set(keys) - seen
        seen |= got
        index().add(rows(*got), batch)
        assert {r["sha"] for r in index().unknown(rows(*keys), batch).collect()} == got  # the batch again
        index().fold(batch)
    folded, batches = index()._listed()
    assert folded >= 5 and len(batches) <= 3
    monkeypatch.setattr(incremental, "LISTED", 0)
    assert index().unknown(rows("k1", "k8", "new", None), 9).collect() == rows("new").collect()


def test_language_of_content(spark):
    from pyspark.sql import functions as F

    from lamella.functions import pieces

    cases = [("#!/usr/bin/env node\n", ".js"), ("#!/opt/python3.12 -u\nfunc a\nfunc b", ".py"), ("#!/bin/odd\nimport a\nimport b\n", ".py"), ("x\n/* vim: set ft=Go: */", ".go"), ("# vim: ft=odd\nimport a\nimport b", None), ("import a", None), ("  [ {", ".json"), ("", None), (None, None), ("fn a() {}\nuse b::c;\nconst x = 1\nconst y = 2\n", ".rs")]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["x"] for r in d.select("i", pieces.language_of_content(F.col("t")).alias("x")).collect()}
    assert got == {i: x for i, (_, x) in enumerate(cases)}


def test_counted_sides_over_the_bound_are_shuffled(spark):
    from pyspark.sql import functions as F

    from lamella import storage

    d = storage.cut(spark.range(20).selectExpr("concat('t', id) id"))
    plan = d.join(storage.near(d.withColumnRenamed("id", "b"), bound=10), F.col("id") == F.col("b"))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_places_over_ranges(spark):
    from lamella.operators import history

    rows = [(i * 7919 % 100, i % 3) for i in range(300)]
    d = spark.createDataFrame([(r, k, i) for i, (r, k) in enumerate(rows)], "a int, b int, i int")
    got = {tuple(r) for r in history.placed(d, ["b", "a", "i"]).select("b", "a", "i", "place").collect()}
    assert got == {(*x, n) for n, x in enumerate(sorted((k, r, i) for i, (r, k) in enumerate(rows)), 1)}
    assert history.placed(d.limit(0), ["a"]).count() == 0


def test_diff_lines_are_the_document(spark):
    import json

    from lamella.sinks import documents

    rows = [("e1", "added", "function", "f", 3, "b.py", None, "x,"), ("e2", "deleted", "function", "g", 1, "a.py", "y", None), ("e3", "modified", "orphan", "h", 9, "a.py", "y", "z")]
    d = spark.createDataFrame(rows, "entity_id string, change_type string, entity_type string, entity_name string, entity_line int, file_path string, before_content string, after_content string")
    lines = documents.diff_json_lines(d)
    text = "".join(r["text"] for r in lines.orderBy(*lines.columns[:4]).collect())
    assert json.loads(text) == json.loads(documents.diff_json(d).first()["json"])
    assert json.loads("".join(r["text"] for r in documents.diff_json_lines(d.limit(0)).orderBy("part").collect()))["changes"] == []
