"""Versions of a project: equal to full builds, atomic, pinned by readers, and read by token bucket."""

import pytest
from pyspark.sql import functions as F

from lamella import project
from lamella.operators import graph_build

FILES = {f"m{k}/{p}": t for k in range(6) for p, t in (("util.ts", f"export function help{k}(a) {{\n  return a;\n}}\n"), ("lib.ts", f'export {{ help{k} as aid }} from "./util";\n'), ("app.ts", 'import { aid } from "./lib";\nexport function run(x) {\n  return aid(x);\n}\n'))}


def table(spark, files):
    return spark.createDataFrame(sorted(files.items()), "file_path string, content string")


def rows(d):
    return sorted(map(tuple, d.collect()))


class Killed(Exception):
    pass


def test_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(project, "LAYERS", 2)
    files, p = dict(FILES), project.Project(spark, f"file://{tmp_path}/project")
    first = p.create(table(spark, files))
    start = rows(first.edges())
    assert start == rows(graph_build.graph(table(spark, files))[1]) and len(start) == 18
    steps = [({"m0/util.ts": "export function other(a) {\n  return a;\n}\n"}, ["m1/lib.ts"]), ({"m1/lib.ts": FILES["m1/lib.ts"], "m2/app.ts": "// note\n" + FILES["m2/app.ts"]}, [])]
    for changed, deleted in steps:
        files = {k: v for k, v in files.items() if k not in deleted} | changed
        gone = spark.createDataFrame([(d,) for d in deleted], "file_path string")
        now = p.update(table(spark, changed), gone)
        nodes, edges = graph_build.graph(table(spark, files))
        assert rows(now.edges()) == rows(edges)
        assert rows(now.nodes().select("id", "content_hash")) == rows(nodes.select("id", "content_hash"))
    assert rows(p.at(0).edges()) == start and p.versions() == [0, 1, 2]
    assert all(len(x) == 1 for x in p.at().manifest["tables"].values())
    # A step that is killed before it publishes leaves the last version; the next one takes its number.
    before = rows(p.at().edges())
    with monkeypatch.context() as m:
        m.setattr(project.Project, "_publish", lambda *_: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            p.update(table(spark, {"m3/util.ts": "export const x = 1;\n"}))
    assert p.versions() == [0, 1, 2] and rows(p.at().edges()) == before
    with pytest.raises(project.Conflict):
        p._publish(2, {})
    assert rows(p.at().edges()) == before
    moved = p.renamed(spark.createDataFrame([("m4/util.ts", "m4/tool.ts")], "old_file_path string, file_path string"))
    files["m4/tool.ts"] = files.pop("m4/util.ts")
    assert rows(moved.edges()) == rows(graph_build.graph(table(spark, files))[1]) and moved.version == 3
    p.vacuum(1)
    assert p.versions() == [3] and rows(p.at().edges()) == rows(moved.edges())
    assert p.update(table(spark, {"m0/app.ts": ""}).limit(0)).version == 3


def test_mentions_read_their_buckets_alone(spark, tmp_path):
    files = {f"f{k}.py": f"def run{k}():\n  return helper{k}() + common()\n" for k in range(300)}
    p = project.Project(spark, f"file://{tmp_path}/project")
    s = p.create(table(spark, files))
    found = s.mentions(["helper7"])
    assert [r["file_path"] for r in found.collect()] == ["f7.py"]
    plan = found._jdf.queryExecution().executedPlan()
    scans, todo = [], [plan]
    while todo:
        x = todo.pop()
        if x.nodeName().startswith("Scan parquet"):
            scans.append(x)
        todo += [x.children().apply(i) for i in range(x.children().size())]
    assert len(scans) == 1 and "bucket" in scans[0].simpleString(5000).split("PartitionFilters")[1]
    whole = s.table("references")
    bucket = spark.range(1).select(graph_build.bucket_of(F.lit("helper7"))).first()[0]
    assert whole.count() == 600 and whole.filter(F.col("bucket") == bucket).count() < 75
