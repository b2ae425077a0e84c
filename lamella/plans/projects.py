"""Queries over projects of files that are made from the rows of large tables: names, imports and calls come from the keys.

The SQL never sees a file: it says from the keys what must follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.operators import graph_build, lineage, scopes
from lamella.plans.registry import query, table


def _text(*parts) -> Column:
    return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])


def _files(d: DataFrame, *files: Column) -> DataFrame:
    """``file_path, content`` of the structs ``files`` (``p, t``); null ones are left out."""
    listed = F.filter(F.array(*files), lambda x: x["p"].isNotNull())
    return d.select(F.inline(listed)).toDF("file_path", "content")


def _file(path: Column, text: Column, where: Column | None = None) -> Column:
    return F.struct((path if where is None else F.when(where, path)).alias("p"), text.alias("t"))


# Exports ------------------------------------------------------------------------
# Customer k has util.ts, k % 6 barrels that hand its function on under names of their own, app.ts that calls the last one's, a
# default export that goes through the barrels too, and for every eleventh a circle of two exports.


def _barrels(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("k"), (k % 6).alias("n"), (k % 11 == 0).alias("ring"), k.alias("key"))


def _scripts(d: DataFrame, helper: str = "help") -> DataFrame:
    at = _text("c", F.col("k"), "/")
    util = _text("export function ", helper, F.col("k"), "(a) {\n  return a;\n}\nexport default function main", F.col("k"), "() {\n  return 1;\n}\n")
    source = lambda i: F.when(i == 1, _text("help", F.col("k"))).otherwise(_text("h", (i - 1).cast("string")))
    module = lambda i: F.when(i == 1, F.lit("util")).otherwise(_text("b", (i - 1).cast("string")))
    barrel = lambda i: F.struct(_text(at, "b", i.cast("string"), ".ts").alias("p"), _text("export { ", source(i), " as h", i.cast("string"), ' } from "./', module(i), '";\nexport { default } from "./', module(i), '";\n').alias("t"))
    last = F.col("n") + 1
    app = _text("import Run, { ", source(last), ' as aid } from "./', module(last), '";\nexport function start(x) {\n  return aid(x);\n}\nexport function begin() {\n  return Run();\n}\n')
    ring = lambda a, b: _file(_text(at, a, ".ts"), _text('export { loop } from "./', b, '";\n'), F.col("ring"))
    one = F.array(_file(_text(at, "util.ts"), util), _file(_text(at, "app.ts"), app), ring("y1", "y2"), ring("y2", "y1"))
    chain = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), barrel)).otherwise(F.array().cast("array<struct<p:string,t:string>>"))
    return d.select(F.inline(F.filter(F.concat(one, chain), lambda x: x["p"].isNotNull()))).toDF("file_path", "content")


_CHAIN = """WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey % 6 AS n FROM customer),
b AS (SELECT k, u.i AS i, CASE WHEN u.i = 1 THEN 'c' || k || '/util.ts::function::help' || k ELSE 'c' || k || '/b' || (u.i - 1) || '.ts::export::h' || (u.i - 1) END AS next FROM c, unnest(range(1, n + 1)) AS u(i)),
f AS (SELECT k, i, next FROM b UNION SELECT f.k, f.i, b.next FROM f JOIN b ON b.k = f.k AND f.next = 'c' || b.k || '/b' || b.i || '.ts::export::h' || b.i),
e AS (SELECT k, CASE WHEN n = 0 THEN 'c' || k || '/util.ts::function::help' || k ELSE (SELECT f.next FROM f WHERE f.k = c.k AND f.i = c.n AND f.next LIKE '%::function::%') END AS goal FROM c),
g AS (
SELECT 'c' || k || '/app.ts::function::start' AS from_entity, goal AS to_entity, 'calls' AS ref_type, k, 0 AS i FROM e
UNION ALL SELECT 'c' || k || '/app.ts::function::begin', 'c' || k || '/util.ts::function::main' || k, 'calls', k, 0 FROM c
UNION ALL SELECT 'c' || k || '/app.ts::function::start', 'c' || k || '/b' || n || '.ts::export::h' || n, 'imports', k, 0 FROM c WHERE n > 0
UNION ALL SELECT 'c' || k || '/app.ts::function::begin', 'c' || k || '/b' || n || '.ts::export::default', 'imports', k, 0 FROM c WHERE n > 0
UNION ALL SELECT 'c' || k || '/b' || i || '.ts::export::h' || i, next, 'imports', k, i FROM b
UNION ALL SELECT 'c' || k || '/b' || i || '.ts::export::default', CASE WHEN i = 1 THEN 'c' || k || '/util.ts::function::main' || k ELSE 'c' || k || '/b' || (i - 1) || '.ts::export::default' END, 'imports', k, i FROM b
UNION ALL SELECT 'c' || k || '/y1.ts::export::loop', 'c' || k || '/y2.ts::export::loop', 'imports', k, 0 FROM c WHERE k % 11 = 0
UNION ALL SELECT 'c' || k || '/y2.ts::export::loop', 'c' || k || '/y1.ts::export::loop', 'imports', k, 0 FROM c WHERE k % 11 = 0)
"""


@query(_CHAIN + "SELECT from_entity, to_entity, ref_type FROM g")
def barrel_calls(spark, sf_dir):
    return graph_build.graph(_scripts(_barrels(spark, sf_dir)))[1]


def _after(spark, sf_dir):
    """Files of the customers, and what changes: of four customers one renames its function, one loses its first barrel, one imports from util itself."""
    d = _barrels(spark, sf_dir)
    at = _text("c", F.col("k"), "/")
    of = lambda r: d.filter(F.col("key") % 4 == r)
    renamed = _scripts(of(1), "aid").filter("file_path like '%/util.ts'")
    direct = of(3).select(_text(at, "app.ts").alias("file_path"), _text("import { help", F.col("k"), ' as aid } from "./util";\nexport function start(x) {\n  return aid(x);\n}\n').alias("content"))
    gone = of(2).filter("n > 0").select(_text(at, "b1.ts").alias("file_path"))
    return _scripts(d), renamed.union(direct), gone


_CHANGED = _CHAIN + """, x AS (
SELECT from_entity, to_entity, ref_type FROM g WHERE k % 4 = 0
UNION ALL SELECT from_entity, to_entity, ref_type FROM g WHERE k % 4 = 1 AND to_entity NOT LIKE '%::function::help%'
UNION ALL SELECT from_entity, to_entity, ref_type FROM g WHERE k % 4 = 2 AND (k % 6 = 0 OR (from_entity NOT LIKE '%/b1.ts%' AND to_entity NOT LIKE '%/b1.ts%' AND NOT (from_entity LIKE '%/app.ts%' AND to_entity LIKE '%/util.ts%')))
UNION ALL SELECT from_entity, to_entity, ref_type FROM g WHERE k % 4 = 3 AND from_entity NOT LIKE '%/app.ts%'
UNION ALL SELECT 'c' || k || '/app.ts::function::start', 'c' || k || '/util.ts::function::help' || k, 'calls' FROM c WHERE k % 4 = 3)
"""


@query(_CHANGED + "SELECT * FROM x")
def incremental_exports(spark, sf_dir):
    files, changed, gone = _after(spark, sf_dir)
    return graph_build.rebuilt(files, changed, gone)[1]


# Scopes and types ---------------------------------------------------------------
# Customer k has two classes with a method of one name, a function that makes one of them and k % 4 others that hand its result on; the
# classes meet in one function for every seventh.  A name is bound again as a parameter, in a class or not at all.

_CLASSES = "class A:\n  def save(self):\n    return 1\n\nclass B:\n  def save(self):\n    return 2\n"


def _modules(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    d = table(spark, sf_dir, "customer").select(k.cast("string").alias("k"), (k % 4).cast("int").alias("n"), k.alias("key"))
    at, mod = _text("p", F.col("k"), "/"), _text("p", F.col("k"), ".")
    made = F.when(F.col("key") % 7 == 0, F.lit("  if flag:\n    return A()\n  return B()\n")).when(F.col("key") % 2 == 0, F.lit("  return A()\n")).otherwise(F.lit("  x = B()\n  return x\n"))
    step = lambda i: _text("def make", i.cast("string"), "(flag):\n  y = make", (i - 1).cast("string"), "(flag)\n  return y\n")
    steps = F.when(F.col("n") > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), step), "")).otherwise(F.lit(""))
    factory = _text("from ", mod, "s import A, B\n\ndef make0(flag):\n", made, steps)
    n = F.col("n").cast("string")
    user = _text("from ", mod, "f import make", n, " as build\nfrom ", mod, "s import A\n\nclass Job:\n  def __init__(self, store):\n    self.store = store\n  def run(self):\n    return self.store.save()\n\ndef start():\n  Job(A())\n  return build(1).save()\n")
    inner = F.when(F.col("key") % 3 == 0, F.lit("  def deep(g):\n    return g()\n")).when(F.col("key") % 3 == 1, F.lit("  class C:\n    def g(self):\n      return 1\n    def deep(self):\n      return g()\n")).otherwise(F.lit("  def other():\n    g = 1\n  def deep():\n    return [g() for _ in [1]]\n"))
    shadow = _text("def g():\n  return 1\n\ndef outer():\n", inner, "  return 1\n")
    return _files(d, _file(_text(at, "s.py"), F.lit(_CLASSES)), _file(_text(at, "f.py"), factory), _file(_text(at, "u.py"), user), _file(_text(at, "w.py"), shadow))


@query("""WITH c AS (SELECT c_custkey AS k, 'p' || c_custkey || '/' AS p FROM customer)
SELECT p || 'u.py::function::start' AS from_entity, p || 's.py::class::' || CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END || '::save' AS to_entity FROM c WHERE k % 7 <> 0
UNION ALL SELECT p || 'u.py::class::Job::run', p || 's.py::class::A::save' FROM c
UNION ALL SELECT p || 'w.py::function::outer', p || 'w.py::function::g' FROM c WHERE k % 3 <> 0""")
def scoped_calls(spark, sf_dir):
    files = _modules(spark, sf_dir)
    known = graph_build.facts(files, "nodes", "imports", "exports", "scopes")
    links = graph_build.linking(known)
    return scopes.calls(files, known["nodes"], links["imports"], links["offered"], known["scopes"]).filter("to_entity like '%::save' or from_entity like '%/w.py%'")


# History ------------------------------------------------------------------------
# Part k is an entity of eight versions: every third is renamed, every fifth moves to another file, the body changes with the version
# and the key, and for every seventh a name and the structure change at once, which ends its line and begins another.

VERSIONS = 8


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k, v = F.col("p_partkey"), F.col("version")
    d = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(VERSIONS).cast("long"))).alias("version"))
    cut = F.when((k % 7 == 0) & (v >= 5), 1).otherwise(0)
    names = F.when(k % 3 == 0, F.floor((v + k % 4) / 3)).otherwise(F.lit(0)) + cut * 100
    file = _text("f", ((k + F.when(k % 5 == 0, F.floor(v / 4)).otherwise(F.lit(0))) % 40).cast("string"), ".py")
    name = _text("n", k.cast("string"), "_", names.cast("string"))
    body = _text("c", k.cast("string"), "_", F.floor((v + k % 2) / 2).cast("string"), "_", cut.cast("string"))
    rows = d.select("version", file.alias("file_path"), _text(file, "::function::", name).alias("id"), name.alias("name"), F.lit(None).cast("string").alias("parent_id"), body.alias("content_hash"), _text("s", k.cast("string"), "_", cut.cast("string")).alias("structural_hash"), k.alias("start_line"))
    files = d.select("version").distinct().withColumn("file_path", F.explode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: _text("f", i.cast("string"), ".py"))))
    return rows, files


@query(f"""WITH RECURSIVE r AS (
  SELECT p_partkey AS k, v, CASE WHEN p_partkey % 7 = 0 AND v >= 5 THEN 1 ELSE 0 END AS cut FROM part, unnest(range(1, {VERSIONS + 1})) AS u(v)
), s AS (
  SELECT k, v, cut, (CASE WHEN k % 3 = 0 THEN (v + k % 4) // 3 ELSE 0 END) + 100 * cut AS nm, 'f' || ((k + CASE WHEN k % 5 = 0 THEN v // 4 ELSE 0 END) % 40) || '.py' AS f, ((v + k % 2) // 2) || '_' || cut AS c FROM r
), e AS (SELECT *, f || '::function::n' || k || '_' || nm AS id FROM s
), t AS (
  SELECT k, v, cut, id, f, nm, c, v AS first_version, id AS first_id, CAST(NULL AS VARCHAR) AS old_id, 'added' AS change FROM e WHERE v = 1
  UNION ALL
  SELECT e.k, e.v, e.cut, e.id, e.f, e.nm, e.c, CASE WHEN e.cut <> t.cut THEN e.v ELSE t.first_version END, CASE WHEN e.cut <> t.cut THEN e.id ELSE t.first_id END, CASE WHEN e.cut = t.cut THEN t.id END,
         CASE WHEN e.cut <> t.cut THEN 'added' WHEN e.f <> t.f THEN 'moved' WHEN e.nm <> t.nm THEN 'renamed' WHEN e.c <> t.c THEN 'modified' END
  FROM t JOIN e ON e.k = t.k AND e.v = t.v + 1
)
SELECT first_version, first_id, v AS version, id, old_id, change FROM t WHERE change IS NOT NULL
UNION ALL SELECT t.first_version, t.first_id, 5, t.id, t.id, 'deleted' FROM t WHERE t.k % 7 = 0 AND t.v = 4""")
def entity_lines(spark, sf_dir):
    rows, files = _versions(spark, sf_dir)
    return lineage.histories(rows, files).select("first_version", "first_id", "version", "id", "old_id", "change")
