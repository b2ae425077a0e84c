"""Folders, repositories, saved tables and the calls over them."""

import json
import os
import subprocess

import pytest

from lamella import api
from lamella.operators import extract, graph_build
from lamella.sinks import documents
from lamella.sources import caches, files, repository
from lamella.streaming import upkeep


def git(path, *args):
    env = {**os.environ, "GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "a@x", "GIT_CONFIG_GLOBAL": "/dev/null"}
    subprocess.run(["git", "-C", str(path), *args], check=True, capture_output=True, env=env)


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("repo")
    git(p, "init", "-q", "-b", "main")
    (p / "a.py").write_text("def one():\n    return 1\n\n\ndef two():\n    return one()\n")
    (p / "b.md").write_text("# T\r\ntext\r\n")
    git(p, "add", ".")
    git(p, "commit", "-qm", "first")
    (p / "a.py").write_text("def one():\n    return 2\n\n\ndef two():\n    return one()\n")
    git(p, "mv", "b.md", "c.md")
    git(p, "add", ".")
    git(p, "commit", "-qm", "second")
    (p / "a.py").write_text("def one():\n    return 3\n\n\ndef two():\n    return one()\n")
    (p / "new.txt").write_text("not known to git\n")
    return repository.Repository(spark, str(p))


def changes(df):
    return sorted((r["file_path"], r["status"], r["old_file_path"]) for r in df.collect())


def test_repository(repo):
    assert [r["message"] for r in repo.log().collect()] == ["second", "first"] and repo.log(1).count() == 1
    assert changes(repo.commit("HEAD")) == [("a.py", "modified", None), ("c.md", "renamed", "b.md")]
    assert changes(repo.commit("HEAD~1")) == [("a.py", "added", None), ("b.md", "added", None)]
    assert changes(repo.between("HEAD~1", "HEAD")) == changes(repo.commit("HEAD"))
    assert changes(repo.working_tree()) == [("a.py", "modified", None)] and changes(repo.staged()) == []
    assert changes(repo.since("HEAD~1")) == [("a.py", "modified", None), ("c.md", "renamed", "b.md")]
    row = repo.working_tree().first()
    assert "return 2" in row["before_content"] and "return 3" in row["after_content"]
    assert repo.show("HEAD~1", "b.md") == "# T\ntext\n" and repo.show("HEAD", "b.md") is None and "return 2" in repo.show("", "a.py")
    assert [r["message"] for r in repo.file_history("c.md", follow=True).collect()] == ["second", "first"]
    assert [r["message"] for r in repo.file_history("a.py").collect()] == ["second", "first"]
    assert repo.changed_paths("HEAD") == ["a.py", "c.md"] and repo.merge_base("HEAD~1", "HEAD") == repo.resolve("HEAD~1")
    lines = repo.blame("a.py").collect()
    assert lines[1]["commit_sha"] is None and lines[0]["commit_sha"] == repo.resolve("HEAD~1")
    assert not repo.clean() and not upkeep.oracle_says_fresh(repo.epoch(), repo.epoch())
    with pytest.raises(ValueError):
        repo.resolve("nowhere")


def test_calls_over_a_repository(spark, repo):
    rows = api.diff_files(repo.commit("HEAD")).collect()
    assert [(r["entity_id"], r["change_type"]) for r in rows] == [("a.py::function::one", "modified"), ("c.md::heading::T", "moved")]
    found = files.scan(spark, repo.path)
    assert [r["file_path"] for r in found.collect()] == ["a.py", "c.md", "new.txt"]
    e = api.entities(found, only=("function",))
    assert [r["name"] for r in e.collect()] == ["one", "two"]
    with pytest.raises(ValueError, match="there are chunk, function, heading"):
        api.entities(found, only=("class",))
    got = {r["id"]: r["sha"] for r in api.blame(e, repo.blame("a.py")).collect()}
    assert got == {"a.py::function::one": None, "a.py::function::two": repo.resolve("HEAD~1")}
    hit = api.text_search(found, "return one").first()
    assert (hit["file_path"], hit["line"], hit["id"]) == ("a.py", 6, "a.py::function::two")


def test_folder_scan(spark, tmp_path):
    for p, text in {"src/a.py": "x", "src/.hidden/b.py": "x", "dist/c.js": "x", "node_modules/d.js": "x", "log/e.txt": "x", "keep.txt": "x\r\ny", "img.png": "x", "src/gen.py": "x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(text.encode())
    (tmp_path / "nul.txt").write_bytes(b"a\0b")
    (tmp_path / "latin.txt").write_bytes(b"\xff\xfe")
    rules = files.ignore_rules("# rules\nlog/\n*.py\n!src/a.py\n")
    got = {r["file_path"]: r["content"] for r in files.scan(spark, str(tmp_path), rules=rules).collect()}
    assert got == {"keep.txt": "x\ny", "src/a.py": "x"}
    assert [r[0] for r in files.scan(spark, f"file://{tmp_path}", extensions=("py",), under="src").select("file_path").collect()] == ["src/a.py", "src/gen.py"]
    assert files.scan(spark, str(tmp_path), default_excludes=False).filter("file_path = 'dist/c.js'").count() == 1
    assert files.compared("a.py", "x", "b.py", "y") == [("b.py", "modified", "a.py", "x", "y")] and len(files.compared("a.py", "x", "b.md", "y")) == 2


def test_saved_graph(spark, tmp_path):
    project = spark.createDataFrame([("a.py", "def one():\n  return 1\ndef two():\n  return one()\n")], "file_path string, content string")
    nodes, edges = graph_build.graph(project)
    path = str(tmp_path / "g.db")
    assert documents.save_sqlite({"nodes": nodes.drop("metadata"), "edges": edges}, path) == {"nodes": 2, "edges": 1}
    n, e = caches.graph(spark, path, topology=True)
    assert "content" not in n.columns and sorted(r["id"] for r in n.collect()) == ["a.py::function::one", "a.py::function::two"]
    assert [tuple(r) for r in e.collect()] == [("a.py::function::two", "a.py::function::one", "calls")]
    assert [r["name"] for r in caches.entities_under(spark, path, "a.").collect()] == ["one", "two"]
    with pytest.raises(ValueError):
        caches.sqlite_table(spark, path, "nothing")
    answer = json.dumps({"impact": [{"id": "x", "depth": 2}]})
    assert [tuple(r) for r in caches.service_rows(spark, lambda p: answer, "/impact", "id string, depth int", "impact").collect()] == [("x", 2)]


def test_warm_graph(spark):
    project = spark.createDataFrame([("a.py", "def one():\n  return 1\ndef two():\n  return one()\n")], "file_path string, content string")
    warm = api.Warm(project)
    assert [r["id"] for r in warm.impact("a.py::function::one")["impact"].collect()] == ["a.py::function::two"]
    warm.refresh(spark.createDataFrame([("a.py", "def one():\n  return 1\ndef three():\n  return one()\n")], "file_path string, content string"))
    assert [r["id"] for r in warm.impact("a.py::function::one")["impact"].collect()] == ["a.py::function::three"]
    assert [r["role"] for r in warm.context("one")["entries"].collect()] == ["target", "direct_dependent"]
    with pytest.raises(ValueError, match="not found"):
        warm.context("nobody")
    with pytest.raises(ValueError):
        api.impact(warm.nodes, warm.edges, "x", depth=-1)
    assert warm.text("return one").count() == 1


def test_replies(spark):
    long = "\n".join(map(str, range(300)))
    rows = [(1, "s", "e", "a\nb"), (2, "s", "e", "a\nb"), (3, "s", "e", "a\nc"), (4, "s", "e", long), (5, "t", "e", "x" * 70_000), (6, "t", "e", "y")]
    got = [(r["kind"], r["told"][:5]) for r in upkeep.replies(spark.createDataFrame(rows, "o int, s string, e string, b string"), "s", "e", ["o"], "b").orderBy("o").collect()]
    assert got == [("first", "a\nb"), ("unchanged", ""), ("delta", "-b\n+c"), ("full", "0\n1\n2"), ("first", "xxxxx"), ("full", "y")]


def test_refresh_plans(spark):
    schema = "file_path string, mtime long, content_hash string"
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")], schema)
    new = spark.createDataFrame([("a", 2, "x"), ("b", 2, "w"), ("c", 1, "z")], schema)
    found = upkeep.changes(old, new)
    assert sorted(tuple(r) for r in found.collect()) == [("a", "touched"), ("b", "content")]
    assert upkeep.plan(found).first()["action"] == "incremental" and upkeep.plan(upkeep.changes(old, old)).first()["action"] == "reuse"
    assert upkeep.plan(upkeep.changes(old.limit(0), new)).first()["action"] == "walk"
    e = spark.createDataFrame([("a::f", "a"), ("c::g", "c")], "id string, file_path string")
    i = spark.createDataFrame([("a", "b")], "importing_file string, imported_file string")
    assert sorted(tuple(r) for r in upkeep.dependency_fresh(found, i, e).collect()) == [("a::f", False), ("c::g", True)]
    assert extract.custom_suffixes(".x = .py") == {".x": ".py"}
    assert extract.applied([(2, 3, "X"), (2, 2, "Y"), (5, 5, "Z")], list("abcdef")) == "a\nX\nd\nZ\nf"


def test_ledger_as_a_stream(spark, tmp_path):
    from lamella.streaming import incremental

    src = str(tmp_path / "in")
    schema = "s string, e string, b string"
    spark.createDataFrame([("s", "e", "x")], schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    run = lambda: incremental.ledger_stream(stream, "s", "e", "b", ttl=None).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    run()
    spark.createDataFrame([("s", "e", "x")], schema).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([("s", "e", "y"), ("t", "e", "y")], schema).write.mode("append").parquet(src)
    run()
    got = sorted((r["s"], r["reply"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("s", "changed"), ("s", "first"), ("s", "unchanged"), ("t", "first")]
