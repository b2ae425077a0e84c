"""Exports followed through barrels, and graphs refreshed over generated histories against full builds."""

import random

import pytest

from lamella import storage
from lamella.operators import exports, graph_build


def edges_of(spark, files):
    d = spark.createDataFrame(sorted(files.items()), "file_path string, content string")
    return {tuple(r) for r in graph_build.graph(d)[1].select("from_entity", "to_entity", "ref_type").collect()}


def test_barrels_defaults_and_stars(spark):
    files = {
        "util.ts": "export function help(a) {\n  return a;\n}\nexport default function run() {\n  return 1;\n}\n",
        "lib/index.ts": 'export { help } from "../util";\nexport { default } from "../util";\n',
        "lib/all.ts": 'export * from "./index";\nexport * from "../more";\n',
        "more.ts": "class Box {\n  open() {\n    return 2;\n  }\n}\nexport { Box as Crate };\nconst hidden = 1;\n",
        "a.ts": 'import Go, { help as aid } from "./lib";\nexport function one(x) {\n  aid(x);\n  return Go();\n}\n',
        "b.ts": 'import * as all from "./lib/all";\nimport { Crate, help } from "./lib/all";\nexport function two(x) {\n  help(x);\n  return all.help(x) + new Crate().open();\n}\n',
        "c.ts": 'import Named from "./lib/all";\nexport function three() {\n  return Named();\n}\n',
        "x.ts": 'export { loop } from "./y";\n',
        "y.ts": 'export { loop } from "./x";\n',
        "d.ts": 'import { loop } from "./x";\nexport function four() {\n  return loop();\n}\n',
        "pkg/__init__.py": "from .deep import work as labour\n",
        "pkg/deep.py": "def work():\n  return 1\n",
        "use.py": "from pkg import labour\n\ndef five():\n  return labour()\n",
        "default_source.ts": "export default function Public() {\n  return 1;\n}\n",
        "named_source.ts": "export function named() {\n  return 1;\n}\n",
        "barrel.ts": "import Public from './default_source';\nexport { named as Public } from './named_source';\n",
    }
    got = edges_of(spark, files)
    assert {
        ("a.ts::function::one", "util.ts::function::help", "calls"),
        ("a.ts::function::one", "util.ts::function::run", "calls"),
        ("a.ts::function::one", "lib/index.ts::export::help", "imports"),
        ("lib/index.ts::export::help", "util.ts::function::help", "imports"),
        ("lib/index.ts::export::default", "util.ts::function::run", "imports"),
        ("b.ts::function::two", "util.ts::function::help", "calls"),
        ("b.ts::function::two", "more.ts::class::Box", "calls"),
        ("use.py::function::five", "pkg/deep.py::function::work", "calls"),
        ("barrel.ts::export::Public", "named_source.ts::function::named", "imports"),
    } <= got
    assert not any(a.startswith("c.ts") or b.startswith("default_source") for a, b, _ in got)
    assert {e for e in got if e[0].startswith(("d.ts", "x.ts"))} == {("d.ts::function::four", "x.ts::export::loop", "imports"), ("x.ts::export::loop", "y.ts::export::loop", "imports")}


@pytest.mark.parametrize("n", [1, 7, 40])
def test_long_chains(spark, n):
    chain = [(f"f{i}", "n", f"f{i + 1}", "n", None if i < n - 1 else "end") for i in range(n)]
    ring = [(f"r{i}", "n", f"r{(i + 1) % 5}", "n", None) for i in range(5)] + [("in", "n", "r0", "n", None), ("lost", "n", "nowhere", "n", None)]
    step = spark.createDataFrame(chain + ring, "file_path string, name string, to_file string, to_name string, target string")
    assert {tuple(r) for r in exports.settled(step).collect()} == {(f"f{i}", "n", "end") for i in range(n)}


WORDS = ["help", "run", "load", "save", "make"]


def script(rng, path, others):
    out = []
    for o in rng.sample(others, min(len(others), rng.randrange(3))):
        module, w = "./" + o.rsplit(".", 1)[0], rng.choice(WORDS)
        out.append(rng.choice(['import {{ {w} }} from "{m}";', 'import {{ {w} as aid }} from "{m}";', 'import * as lib from "{m}";', 'import Go from "{m}";', 'export {{ {w} }} from "{m}";', 'export {{ {w} as default }} from "{m}";', 'export {{ default as {w} }} from "{m}";', 'export * from "{m}";']).format(w=w, m=module))
    for w in rng.sample(WORDS, rng.randrange(3)):
        call = rng.choice(["aid(x)", "Go(x)", f"lib.{rng.choice(WORDS)}(x)", f"{rng.choice(WORDS)}(x)", "1"])
        out.append(f"export {rng.choice(['', 'default '])}function {w}(x) {{\n  return {call};\n}}")
    return "\n".join(out) + "\n"


def module(rng, path, others):
    out = []
    for o in rng.sample(others, min(len(others), rng.randrange(3))):
        name, w = o.rsplit(".", 1)[0], rng.choice(WORDS)
        out.append(rng.choice([f"from {name} import {w}", f"from {name} import {w} as aid", f"import {name} as lib", f"from {name} import Box"]))
    if rng.random() < 0.5:
        out.append("class Box:\n" + "".join(f"  def {w}(self):\n    return self.{rng.choice(WORDS)}()\n" for w in rng.sample(WORDS, 2)))
    for w in rng.sample(WORDS, rng.randrange(3)):
        call = rng.choice(["aid(x)", f"lib.{rng.choice(WORDS)}(x)", f"{rng.choice(WORDS)}(x)", f"x.{rng.choice(WORDS)}()", f"Box().{rng.choice(WORDS)}()"])
        out.append(f"def {w}(x):\n  b = Box()\n  b.{rng.choice(WORDS)}()\n  return {call}")
    return "\n".join(out) + "\n"


def test_refreshed_equals_full_build(spark):
    """Adds, edits, deletions and renames in many small projects at once; every step's edges and nodes are those of a full build."""
    rng = random.Random(11)
    projects = {}
    names = {"ts": ["a.ts", "b.ts", "c.ts", "d.ts", "lib.js", "lib.ts"], "py": ["a.py", "b.py", "c.py", "d.py"]}
    for k in range(40):
        kind = "ts" if k % 2 else "py"
        make = script if kind == "ts" else module
        own = rng.sample(names[kind], 3)
        projects[k] = kind, {p: make(rng, p, [x for x in names[kind] if x != p]) for p in own}

    def rename(k, text):
        return text.replace("from a", f"from q{k}.a").replace("from b", f"from q{k}.b").replace("from c", f"from q{k}.c").replace("from d", f"from q{k}.d").replace("import a", f"import q{k}.a").replace("import b", f"import q{k}.b").replace("import c", f"import q{k}.c").replace("import d", f"import q{k}.d")

    def table(rows):
        return spark.createDataFrame([(f"q{k}/{p}", rename(k, t) if p.endswith("py") else t) for k, p, t in rows], "file_path string, content string")

    whole = lambda: [(k, p, t) for k, (_, files) in projects.items() for p, t in files.items()]
    files = table(whole())
    nodes, edges = graph_build.graph(files)
    for _ in range(3):
        changed, deleted = [], []
        for k, (kind, own) in projects.items():
            make = script if kind == "ts" else module
            act = rng.choice(["edit", "add", "delete", "rename", "none"])
            if act == "edit" and own:
                p = rng.choice(sorted(own))
                own[p] = make(rng, p, [x for x in names[kind] if x != p])
                changed.append((k, p, own[p]))
            elif act == "add" and len(own) < len(names[kind]):
                p = rng.choice([x for x in names[kind] if x not in own])
                own[p] = make(rng, p, [x for x in names[kind] if x != p])
                changed.append((k, p, own[p]))
            elif act in ("delete", "rename") and own:
                p = rng.choice(sorted(own))
                text = own.pop(p)
                deleted.append((k, p))
                free = [x for x in names[kind] if x not in own and x != p]
                if act == "rename" and free:
                    own[free[0]] = text
                    changed.append((k, free[0], text))
        gone = spark.createDataFrame([(f"q{k}/{p}",) for k, p in deleted], "file_path string")
        nodes, edges = graph_build.refreshed(files, table(changed), nodes, edges, gone)
        files = table(whole())
        want_nodes, want = graph_build.graph(files)
        for a, b in ((edges, want), (nodes.select("id", "content_hash"), want_nodes.select("id", "content_hash"))):
            got, full = sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
            assert got == full, (set(got) ^ set(full))
    assert len(full) > 50


def test_export_edge_stays_after_a_comment(spark):
    before = {"lib/util.ts": "export function help(a) {\n  return a;\n}\n", "app.ts": 'export { help as assist } from "./lib/util";\n'}
    files = spark.createDataFrame(list(before.items()), "file_path string, content string")
    nodes, edges = graph_build.graph(files)
    changed = spark.createDataFrame([("app.ts", "// note\n" + before["app.ts"])], "file_path string, content string")
    _, after = graph_build.refreshed(files, changed, nodes, edges)
    assert [tuple(r)[:2] for r in after.collect()] == [("app.ts::export::assist", "lib/util.ts::function::help")]


def test_go_packages(spark):
    files = {
        "cmd/main.go": 'package main\n\nimport (\n\t"fmt"\n\tu "example.com/proj/internal/util"\n\t"example.com/proj/store/v2"\n)\n\nfunc Run() {\n\tu.Help()\n\tu.hidden()\n\tstore.Open()\n\tfmt.Println(local())\n}\n',
        "cmd/other.go": "package main\n\nfunc local() int {\n\treturn 1\n}\n",
        "internal/util/a.go": "package util\n\nfunc Help() {\n\thidden()\n}\n",
        "internal/util/b.go": "package util\n\nfunc hidden() {\n}\n",
        "util/c.go": "package util\n\nfunc Help() {\n}\n",
        "store/v2/s.go": "package store\n\nfunc Open() {\n}\n",
    }
    want = {("cmd/main.go::function::Run", x, "calls") for x in ("internal/util/a.go::function::Help", "store/v2/s.go::function::Open", "cmd/other.go::function::local")} | {("internal/util/a.go::function::Help", "internal/util/b.go::function::hidden", "calls")}
    assert edges_of(spark, files) == want
    d = spark.createDataFrame(sorted(files.items()), "file_path string, content string")
    nodes, edges = graph_build.graph(d)
    changed = spark.createDataFrame([("proj/internal/util/d.go", "package util\n\nfunc Help() {\n}\n"), ("cmd/other.go", "package main\n")], "file_path string, content string")
    after = graph_build.refreshed(d, changed, nodes, edges)[1]
    full = {**files, "proj/internal/util/d.go": "package util\n\nfunc Help() {\n}\n", "cmd/other.go": "package main\n"}
    assert {tuple(r) for r in after.collect()} == edges_of(spark, full)


def test_files_are_dealt_and_read_once(spark, tmp_path):
    """One block of many small files is read in several tasks; what is kept of it reads no file again."""
    spark.range(2000).selectExpr("concat('d', id, '.py') file_path", "'def run():\n  return load()\n' content").coalesce(1).write.parquet(str(tmp_path / "in"))
    known = graph_build.facts(spark.read.parquet(str(tmp_path / "in")))
    assert known["nodes"].selectExpr("input_file_name() f").distinct().count() > 4
    plans = [d._jdf.queryExecution().toString() for d in known.values()]
    assert not any("InPandas" in p for p in plans)
    assert known["nodes"].count() == known["references"].count() == 2000


def test_circles_cost_no_rounds(spark, monkeypatch):
    """Many pointers and a circle: rounds follow the longest way, not the number of pointers."""
    seen = []
    monkeypatch.setattr(exports, "cut", lambda df, label="step": seen.append(label) or storage.cut(df, label))
    rows = [(f"f{i}", "n", f"f{i + 1}", "n", None) for i in range(5)] + [("f5", "n", "f5", "m", "f5::m"), ("lost", "n", "f9", "n", None), ("lost2", "n", "lost", "n", None)]
    rows += [("y1", "n", "y2", "n", None), ("y2", "n", "y1", "n", None), ("in", "n", "y1", "n", None)] + [(f"z{i}", "n", f"z{i}", "m", f"z{i}::m") for i in range(4000)]
    step = spark.createDataFrame(rows, "file_path string, name string, to_file string, to_name string, target string")
    got = {r["file_path"]: r["target"] for r in exports.settled(step).collect()}
    assert got == {f"f{i}": "f5::m" for i in range(6)} | {f"z{i}": f"z{i}::m" for i in range(4000)}
    assert len(seen) <= 5


def test_a_rebuild_reads_each_file_once(spark, monkeypatch, tmp_path):
    seen = []

    def cut(df, label="step", by=None):
        out = storage.cut(df, label, by)
        if label == "texts":
            seen.append(out.count())
        return out

    monkeypatch.setattr(graph_build, "cut", cut)
    files = {f"c{i}/{x}.py": t for i in range(9) for x, t in (("a", "def help(x):\n  return x\n"), ("b", f"from c{i}.a import help\n\ndef start(y):\n  return help(y)\n"))}
    new, gone = {"c1/a.py": "def other(x):\n  return x\n", "c2/c.py": "from c3.a import help\n\ndef far(y):\n  return help(y)\n"}, ["c4/a.py", "c5/b.py"]
    table = lambda d: spark.createDataFrame(sorted(d.items()), "file_path string, content string")
    nodes, edges = graph_build.rebuilt(table(files), table(new), spark.createDataFrame([(g,) for g in gone], "file_path string"))
    assert seen == [18, 2]
    full = {k: v for k, v in (files | new).items() if k not in gone}
    assert {tuple(r) for r in edges.collect()} == edges_of(spark, full)
    assert {r["id"] for r in nodes.collect()} == {r["id"] for r in graph_build.facts(table(full))["nodes"].collect()}
