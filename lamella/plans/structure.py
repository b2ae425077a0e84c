"""Queries over structured files: a small file of each format for every nation, with the nation's key in its text.

The SQL lists, by hand, the entities that each file has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.operators import extract, graph_build
from lamella.operators import search
from lamella.plans.registry import query, table
from lamella.sinks import documents as sinks

#: Format to (path, text, entities as (id after the path, type, first line, last line, parent after the path)).
FILES: dict[str, tuple[str, str, tuple]] = {
    "csv": ("t{k}.csv", 'id,"na,me"\n\nk{k},"x ""q"""\n,z\n', (("::row::row[k{k}]", "row", 2, 2, None), ("::row::row[row_2]", "row", 3, 3, None))),
    "tsv": ("t{k}.tsv", "id\tn\n{k}\ta,b\n", (("::row::row[{k}]", "row", 2, 2, None),)),
    "json": ("t{k}.json", '{\n "a": {"k{k}": 1, "l": [1, 2]},\n "b/c~": "x",\n "e": {}\n}', (("::/a", "object", 2, 2, None), ("::/a/k{k}", "property", 2, 2, "::/a"), ("::/a/l", "property", 2, 2, "::/a"), ("::/b~1c~0", "property", 3, 3, None), ("::/e", "object", 4, 4, None))),
    "json_array": ("u{k}.json", '[{"a": {k}},\n 2]', (("::/0", "object", 1, 1, None), ("::/0/a", "property", 1, 1, "::/0"), ("::/1", "element", 2, 2, None))),
    "yaml": ("t{k}.yaml", '# hi\nx: {k}\nsec{k}:\n  a: 1\nlst:\n- 1\n\n"q k": |\n  txt\n', (("::chunk::(preamble)", "chunk", 1, 1, None), ("::property::x", "property", 2, 2, None), ("::section::sec{k}", "section", 3, 4, None), ("::section::lst", "section", 5, 6, None), ("::property::q k", "property", 8, 9, None))),
    "toml": ("t{k}.toml", "a = {k}\nb = [\n 1,\n 2]\n[s{k}]\nk = 1\n[[t]]\nn = 1\n[[t]]\nn = 2\n", (("::property::a", "property", 1, 1, None), ("::property::b", "property", 2, 4, None), ("::section::s{k}", "section", 5, 6, None), ("::section::t/0", "section", 7, 8, None), ("::section::t/1", "section", 9, 10, None))),
    "markdown": ("t{k}.md", "intro\n\n# A{k}\n```\n# no\n```\n## B\n# A{k}\n", (("::preamble::(preamble)", "preamble", 1, 1, None), ("::heading::A{k}@L3", "heading", 3, 7, None), ("::heading::A{k}@L3::B", "heading", 7, 7, "::heading::A{k}@L3"), ("::heading::A{k}@L8", "heading", 8, 8, None))),
    "latex": ("t{k}.tex", "\\newcommand{\\foo}{x}\n\\begin{document}\n\\section{One{k}}\ntext\n\\subsection{Two}\n\\begin{figure}\n\\label{fig:{k}}\n\\end{figure}\n\\section{Three}\n\\end{document}\n", (("::preamble::(preamble)", "preamble", 1, 1, None), ("::command::foo", "command", 1, 1, None), ("::section::One{k}", "section", 3, 8, None), ("::section::One{k}::Two", "subsection", 5, 8, "::section::One{k}"), ("::section::One{k}::Two::fig:{k}", "figure", 6, 8, "::section::One{k}::Two"), ("::section::Three", "section", 9, 10, None))),
    "vue": ("t{k}.vue", '<template>\n <div/>\n</template>\n<script setup lang="ts">\nfunction f{k}() {\n  return 1\n}\nclass A {\n  m(x) {\n  }\n}\n</script>\n', (("::sfc_block::template", "sfc_block", 1, 3, None), ("::sfc_block::script setup", "sfc_block", 4, 12, None), ("::sfc_block::script setup::f{k}", "function", 5, 7, "::sfc_block::script setup"), ("::sfc_block::script setup::A", "class", 8, 11, "::sfc_block::script setup"), ("::sfc_block::script setup::A::m", "method", 9, 10, "::sfc_block::script setup::A"))),
    "svelte": ("t{k}.svelte", "<script>\n function f{k}() {}\n</script>\n{#if a{k}}\n {#each xs as x}\n {/each}\n{/if}\n", (("::svelte_instance_script::script", "svelte_instance_script", 1, 3, None), ("::svelte_instance_script::script::f{k}", "function", 2, 2, "::svelte_instance_script::script"), ("::svelte_if::if a{k}", "svelte_if", 4, 7, None), ("::svelte_if::if a{k}::each xs as x", "svelte_each", 5, 6, "::svelte_if::if a{k}"))),
    "erb": ("t{k}.html.erb", "<h1><%= title{k} %></h1>\n<% items.each do |i| %>\n <%= i %>\n<% end %>\n", (("::template::t{k}", "template", 1, 4, None), ("::template::t{k}::title{k}", "erb_expression", 1, 1, "::template::t{k}"), ("::template::t{k}::items.each do |i|", "erb_block", 2, 4, "::template::t{k}"), ("::template::t{k}::items.each do |i|::i", "erb_expression", 3, 3, "::template::t{k}::items.each do |i|"))),
    "python": ("t{k}.py", "@d\ndef f{k}():\n  def g(): pass\nclass A:\n  def m(self): return 1\n", (("::function::f{k}", "function", 1, 3, None), ("::class::A", "class", 4, 5, None), ("::class::A::m", "method", 5, 5, "::class::A"))),
    "typescript": ("t{k}.ts", 'export { a as b, c } from "./d";\nexport class K{k} extends L {\n  async run(x: number): Promise<void> {\n    if (x) { y(); }\n  }\n}\nfunction over(a) {}\nfunction over(b) {}\ndescribe("s{k}", () => {\n  it("does", () => {});\n});\n', (("::export::b", "export", 1, 1, None), ("::export::c", "export", 1, 1, None), ("::class::K{k}", "class", 2, 6, None), ("::class::K{k}::run", "method", 3, 5, "::class::K{k}"), ("::function::over@L7", "function", 7, 7, None), ("::function::over@L8", "function", 8, 8, None), ("::test_suite::s{k}", "test_suite", 9, 11, None), ("::test_suite::s{k}::does", "test", 10, 10, "::test_suite::s{k}"))),
    "go": ("t{k}.go", "package m\ntype S{k} struct {\n a int\n}\nfunc (s *S{k}) Do() {\n}\nfunc Free() {\n}\n", (("::struct::S{k}", "struct", 2, 4, None), ("::struct::S{k}::Do", "method", 5, 6, "::struct::S{k}"), ("::function::Free", "function", 7, 8, None))),
    "rust": ("t{k}.rs", "pub struct P{k} { a: i32 }\nimpl P{k} {\n  pub fn new() -> Self {\n  }\n}\nfn main() {}\n", (("::struct::P{k}", "struct", 1, 1, None), ("::impl::P{k}", "impl", 2, 5, None), ("::impl::P{k}::new", "method", 3, 4, "::impl::P{k}"), ("::function::main", "function", 6, 6, None))),
    "java": ("M{k}.java", "public class M{k} {\n  private int a;\n  public int get(int b) {\n    return a;\n  }\n  interface J { void f(); }\n}\n", (("::class::M{k}", "class", 1, 7, None), ("::class::M{k}::get", "method", 3, 5, "::class::M{k}"), ("::class::M{k}::J", "interface", 6, 6, "::class::M{k}"))),
    "c": ("t{k}.c", "struct s{k} { int a; };\nstatic int f(int a) {\n  return g(a);\n}\n", (("::struct::s{k}", "struct", 1, 1, None), ("::function::f", "function", 2, 4, None))),
    "ruby": ("t{k}.rb", "module A{k}\n  class B\n    def c\n      1\n    end\n  end\nend\n", (("::module::A{k}", "module", 1, 7, None), ("::module::A{k}::B", "class", 2, 6, "::module::A{k}"), ("::module::A{k}::B::c", "method", 3, 5, "::module::A{k}::B"))),
    "shell": ("t{k}.sh", 'foo{k}() {\n echo "}"\n}\n', (("::function::foo{k}", "function", 1, 3, None),)),
}


def files_of(spark, sf_dir, *formats: str):
    """``file_path, content`` of the formats' files."""
    key = F.col("n_nationkey").cast("string")
    texts = F.array(*[F.struct(F.lit(FILES[f][0]).alias("p"), F.lit(FILES[f][1]).alias("t")) for f in formats])
    d = table(spark, sf_dir, "nation").select(key.alias("k"), F.inline(texts))
    put = lambda c: F.replace(F.col(c), F.lit("{k}"), F.col("k"))
    return d.select(put("p").alias("file_path"), put("t").alias("content"))


def _quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _expected(fmt: str) -> str:
    path, _, rows = FILES[fmt]
    listed = ", ".join("(" + ", ".join(_quoted(v) for v in r) + ")" for r in rows)
    put = lambda c: f"replace('{path}' || {c}, '{{k}}', CAST(n_nationkey AS VARCHAR))"
    return f"SELECT {put('i')} AS id, t AS entity_type, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line, CASE WHEN p IS NULL THEN NULL ELSE {put('p')} END AS parent_id FROM nation, (VALUES {listed}) AS v(i, t, a, b, p)"


def _extract(fmt: str):
    def run(spark, sf_dir):
        e = extract.extracted(files_of(spark, sf_dir, fmt))
        return (extract.with_receivers(e) if fmt == "go" else e).select("id", "entity_type", "start_line", "end_line", "parent_id")

    run.__name__ = f"extract_{fmt}"
    return run


for _fmt in FILES:
    query(_expected(_fmt))(_extract(_fmt))


@query("SELECT " + ", ".join(f"{n} AS {f}" for f, n in (("csv", 2), ("json", 5), ("yaml", 5))) + " FROM (SELECT 1)")
def entity_listing_json(spark, sf_dir):
    def count(fmt):
        one = extract.extracted(files_of(spark, sf_dir, fmt)).filter(F.col("file_path").contains("t7."))
        return sinks.entities_json(one).select(F.size(F.from_json("json", "array<struct<name:string>>")).alias(fmt))

    return count("csv").crossJoin(count("json")).crossJoin(count("yaml"))


@query("SELECT 't' || n_nationkey || '.go::struct::S' || n_nationkey || '::Do' AS id, CAST(n_nationkey AS VARCHAR) AS k FROM nation")
def go_method_parents(spark, sf_dir):
    e = extract.with_receivers(extract.extracted(files_of(spark, sf_dir, "go")))
    return e.filter("entity_type = 'method'").select("id", F.regexp_extract("id", r"t(\d+)\.go", 1).alias("k"))


# Graph from text -----------------------------------------------------------------

_MODELS = "class Item:\n  def total(self):\n    return self.price()\n  def price(self):\n    return {k}\ndef make():\n  return Item()\n"
_SERVICE = "from m{k}.models import Item, make as build\nimport m{k}.util as util\n\ndef run(x):\n  item = build()\n  # Other is only named here\n  print('Item')\n  return util.helper(item)\n\ndef test_run():\n  assert run(1)\n"
_UTIL = "def helper(x):\n  return inner(x)\ndef inner(make):\n  return make\n"
_EDGES = (
    ("models.py::class::Item::total", "models.py::class::Item::price", "calls"),
    ("models.py::function::make", "models.py::class::Item", "calls"),
    ("service.py::function::run", "models.py::function::make", "calls"),
    ("service.py::function::run", "util.py::function::helper", "calls"),
    ("service.py::function::test_run", "service.py::function::run", "calls"),
    ("util.py::function::helper", "util.py::function::inner", "calls"),
)


def project(spark, sf_dir):
    """Three Python files for every nation, with edges inside a file, over imports and to a class's own methods."""
    files = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t).alias("t")) for p, t in (("m{k}/models.py", _MODELS), ("m{k}/service.py", _SERVICE), ("m{k}/util.py", _UTIL))])
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.inline(files))
    put = lambda c: F.replace(F.col(c), F.lit("{k}"), F.col("k"))
    return d.select(put("p").alias("file_path"), put("t").alias("content"))


_LISTED = ", ".join(f"('{a}', '{b}', '{t}')" for a, b, t in _EDGES)
_PROJECT = f"WITH g AS (SELECT 'm' || n_nationkey || '/' || a AS from_entity, 'm' || n_nationkey || '/' || b AS to_entity, t AS ref_type FROM nation, (VALUES {_LISTED}) AS v(a, b, t)) "


def project_graph(spark, sf_dir):
    return graph_build.graph(project(spark, sf_dir))


@query(_PROJECT + "SELECT * FROM g")
def graph_build_edges(spark, sf_dir):
    return project_graph(spark, sf_dir)[1]


@query("SELECT 8 * count(*) AS entity_count, 6 * count(*) AS edge_count FROM nation")
def graph_counts(spark, sf_dir):
    nodes, edges = project_graph(spark, sf_dir)
    return graph_build.counts(nodes, edges)


@query("SELECT 8 * count(*) AS entities, 6 * count(*) AS edges FROM nation")
def graph_document(spark, sf_dir):
    doc = sinks.graph_json(*project_graph(spark, sf_dir))
    j = F.from_json("json", "stats struct<entityCount:long,edgeCount:long>")
    return doc.select(j["stats"]["entityCount"].alias("entities"), j["stats"]["edgeCount"].alias("edges"))


@query("SELECT 'm' || n_nationkey || '/service.py' AS importing_file, 'm' || n_nationkey || f AS imported_file FROM nation, (VALUES ('/models.py'), ('/util.py')) AS v(f)")
def file_imports(spark, sf_dir):
    return graph_build.file_imports(project(spark, sf_dir))


@query("""SELECT 'm' || n_nationkey || '/service.py' AS file_path, l AS local, 'm' || n_nationkey || '/' || t AS target, n AS name FROM nation, (VALUES ('Item', 'models.py', 'Item'), ('build', 'models.py', 'make'), ('util', 'util.py', NULL)) AS v(l, t, n)""")
def import_table(spark, sf_dir):
    return graph_build.import_table(project(spark, sf_dir))


@query("SELECT 'm' || n_nationkey || '/service.py::function::test_run' AS id FROM nation")
def graph_tests(spark, sf_dir):
    nodes, _ = project_graph(spark, sf_dir)
    return nodes.filter(graph_build.is_test()).select("id")


@query("SELECT 'm3/' || i AS id, CAST(d AS INTEGER) AS depth, t AS is_test FROM (VALUES ('util.py::function::helper', 1, false), ('service.py::function::run', 2, false), ('service.py::function::test_run', 3, true)) AS v(i, d, t)")
def combined_impact(spark, sf_dir):
    nodes, edges = project_graph(spark, sf_dir)
    return graph_build.impact(nodes, edges, "m3/util.py::function::inner", depth=0)["impact"].select("id", "depth", "is_test")


@query("SELECT 'm3/' || i AS id FROM (VALUES ('service.py::function::run'), ('util.py::function::helper'), ('util.py::function::inner'), ('service.py::function::test_run'), ('models.py::function::make')) AS v(i)")
def k_hop_subgraph(spark, sf_dir):
    nodes, edges = project_graph(spark, sf_dir)
    return graph_build.k_hops(nodes, edges, "m3/util.py::function::helper", 2).select("id")


@query(_PROJECT + "SELECT from_entity, to_entity FROM g WHERE from_entity LIKE '%run'")
def direct_dependency_build(spark, sf_dir):
    files = project(spark, sf_dir)
    nodes = extract.extracted(files)
    return graph_build.graph(files, only=nodes.filter(F.col("name").endswith("run")).select("id"))[1].select("from_entity", "to_entity")


@query(_PROJECT + "SELECT from_entity, to_entity FROM g WHERE to_entity NOT LIKE '%helper' AND from_entity NOT LIKE '%helper' UNION ALL SELECT 'm' || n_nationkey || '/util.py::function::helped', 'm' || n_nationkey || '/util.py::function::inner' FROM nation")
def incremental_graph(spark, sf_dir):
    files = project(spark, sf_dir)
    changed = files.filter("file_path like '%/util.py'").withColumn("content", F.replace("content", F.lit("helper"), F.lit("helped")))
    before = graph_build.graph(files)
    return graph_build.refreshed(files, changed, *before)[1].select("from_entity", "to_entity")


@query("SELECT 'm' || n_nationkey || '/models.py::class::Item::price' AS id FROM nation WHERE n_nationkey = 4")
def entity_lookup(spark, sf_dir):
    nodes, _ = project_graph(spark, sf_dir)
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    n = nodes.filter("file_path like 'm4/%'").join(parents, "parent_id", "left")
    return n.filter(search.matches_query("Item.price", F.col("name"), F.col("entity_type"), F.col("parent_name"))).select("id")


_STORE = "class Store:\n  def save(self):\n    return {k}\n  def load(self):\n    return 1\n"
_USE = "from s{k}.store import Store\n\nclass Job:\n  def __init__(self):\n    self.store = Store()\n  def run(self):\n    self.store.save()\n    return self.other.save()\n\ndef once(store: Store, odd):\n  mine = Store()\n  mine.load()\n  odd.save_all()\n  return store.save()\n\ndef save():\n  return 1\n"
_TYPED = (("Job::__init__", "store.py::class::Store"), ("Job::run", "store.py::class::Store::save"), ("once", "store.py::class::Store"), ("once", "store.py::class::Store::load"), ("once", "store.py::class::Store::save"))


@query("SELECT 's' || n_nationkey || '/use.py::' || CASE WHEN a LIKE 'Job%' THEN 'class::' ELSE 'function::' END || a AS from_entity, 's' || n_nationkey || '/' || b AS to_entity FROM nation, (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TYPED) + ") AS v(a, b)")
def typed_calls(spark, sf_dir):
    files = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t).alias("t")) for p, t in (("s{k}/store.py", _STORE), ("s{k}/use.py", _USE))])
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.inline(files))
    put = lambda c: F.replace(F.col(c), F.lit("{k}"), F.col("k"))
    return graph_build.graph(d.select(put("p").alias("file_path"), put("t").alias("content")))[1].select("from_entity", "to_entity")


@query("SELECT 'w' || n_nationkey || '/' || a AS from_entity, 'w' || n_nationkey || '/' || b AS to_entity, t AS ref_type FROM nation, (VALUES ('app.ts::function::main', 'lib/util.ts::function::help', 'calls'), ('app.ts::function::main', 'lib/index.ts::function::deep', 'calls'), ('app.ts::export::assist', 'lib/util.ts::function::help', 'imports')) AS v(a, b, t)")
def script_graph(spark, sf_dir):
    app = 'import { help as aid } from "./lib/util";\nimport * as lib from "./lib";\nexport { help as assist } from "./lib/util";\nexport function main(x) {\n  aid(x);\n  return lib.deep("help", x);\n}\n'
    parts = (("w{k}/app.ts", app), ("w{k}/lib/util.ts", "export function help(a) {\n  return a;\n}\n"), ("w{k}/lib/index.ts", "export function deep(a) {\n  return {k};\n}\n"))
    files = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t).alias("t")) for p, t in parts])
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.inline(files))
    put = lambda c: F.replace(F.col(c), F.lit("{k}"), F.col("k"))
    return graph_build.graph(d.select(put("p").alias("file_path"), put("t").alias("content")))[1]
