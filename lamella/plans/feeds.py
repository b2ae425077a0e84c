"""Queries of the text sources, of replies and refreshes, and of joins between entities, files and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.functions import pieces
from lamella.operators import extract, graph_build, search
from lamella.plans.registry import query, table
from lamella.plans.structure import project, project_graph
from lamella.sinks import documents as sinks
from lamella.sources import git_text
from lamella.streaming import upkeep


def _put(text: str, key):
    return F.replace(F.lit(text), F.lit("{k}"), key)


_PATCH = 'diff --git a/x{k}.txt b/y{k}.txt\nsimilarity index 90%\nrename from x{k}.txt\nrename to y{k}.txt\n--- a/x{k}.txt\n+++ b/y{k}.txt\n@@ -1,2 +1,2 @@\n one\n-two\n+{k}\ndiff --git a/n{k} b/n{k}\nnew file mode 100644\n--- /dev/null\n+++ b/n{k}\n@@ -0,0 +1 @@\n+hi\n\\ No newline at end of file\ndiff --git a/p.png b/p.png\nBinary files a/p.png and b/p.png differ\n'


@query("""SELECT n_nationkey AS k, replace(p, '{k}', CAST(n_nationkey AS VARCHAR)) AS file_path, s AS status, replace(o, '{k}', CAST(n_nationkey AS VARCHAR)) AS old_file_path, b AS before_content, replace(a, '{k}', CAST(n_nationkey AS VARCHAR)) AS after_content
FROM nation, (VALUES ('y{k}.txt', 'renamed', 'x{k}.txt', 'one' || chr(10) || 'two' || chr(10), 'one' || chr(10) || '{k}' || chr(10)), ('n{k}', 'added', NULL, NULL, 'hi'), ('p.png', 'modified', NULL, NULL, NULL)) AS v(p, s, o, b, a)""")
def patch_files(spark, sf_dir):
    k = F.col("n_nationkey").cast("string")
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), _put(_PATCH, k).alias("t"))
    return git_text.patches(d, "t", keep=["k"])


@query("SELECT n_nationkey AS k, replace(p, '{k}', CAST(n_nationkey AS VARCHAR)) AS file_path, s AS status, replace(o, '{k}', CAST(n_nationkey AS VARCHAR)) AS old_file_path FROM nation, (VALUES ('a{k}', 'modified', NULL), ('c c', 'renamed', 'b{k}'), ('d', 'deleted', NULL), ('e', 'added', NULL)) AS v(p, s, o)")
def name_status_rows(spark, sf_dir):
    k = F.col("n_nationkey").cast("string")
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), _put("M\0a{k}\0R087\0b{k}\0c c\0D\0d\0A\0e\0", k).alias("t"))
    return git_text.name_statuses(d, "t", keep=["k"])


@query("SELECT n_nationkey AS k, CAST(l AS BIGINT) AS line_number, c AS commit_sha, w AS author, CAST(t AS BIGINT) AS author_time FROM nation, (VALUES (1, repeat('a', 40), 'Ann', 12), (2, NULL, 'Not Committed Yet', NULL)) AS v(l, c, w, t)")
def blame_lines(spark, sf_dir):
    text = f"{'a' * 40} 1 1 1\nauthor Ann\nauthor-time 12\nsummary first {{k}}\n\tline\n{'0' * 40} 2 2\nauthor Not Committed Yet\nauthor-time 99\nsummary x\n\tmore"
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), _put(text, F.col("n_nationkey").cast("string")).alias("t"))
    return git_text.blames(d, "t", keep=["k"]).select("k", "line_number", "commit_sha", "author", "author_time")


@query("SELECT 'f' || n_nationkey AS file_path, 'modified' AS status, CAST(NULL AS VARCHAR) AS old_file_path, n_name AS before_content, upper(n_name) || '!' AS after_content FROM nation")
def json_file_changes(spark, sf_dir):
    d = table(spark, sf_dir, "nation")
    one = F.struct(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("filePath"), F.lit("modified").alias("status"), F.col("n_name").alias("beforeContent"), F.concat(F.upper("n_name"), F.lit("!")).alias("afterContent"))
    return git_text.file_changes_json(d.select(F.to_json(F.array(one)).alias("j")), "j")


_BODIES = "SELECT user_id, event_id, event_type, ts, 'head' || chr(10) || (event_id % 2) || chr(10) || 'tail' AS body FROM events"


@query(f"""WITH b AS ({_BODIES}), l AS (SELECT *, lag(body) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old FROM b)
SELECT event_id, CASE WHEN old IS NULL THEN 'first' WHEN old = body THEN 'unchanged' ELSE 'delta' END AS kind, CASE WHEN old IS NULL THEN body WHEN old = body THEN '' ELSE '-' || (1 - event_id % 2) || chr(10) || '+' || event_id % 2 END AS told FROM l""")
def session_replies(spark, sf_dir):
    d = table(spark, sf_dir, "events").withColumn("body", F.concat_ws("\n", F.lit("head"), (F.col("event_id") % 2).cast("string"), F.lit("tail")))
    return upkeep.replies(d, "user_id", "event_type", ["ts", "event_id"], "body").select("event_id", "kind", "told")


def _listings(spark, sf_dir):
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(k, k.cast("string").alias("file_path"))
    old = d.filter(k % 5 != 0).select("file_path", F.lit(1).alias("mtime"), F.md5("file_path").alias("content_hash"))
    new = d.filter(k % 7 != 0).select("file_path", F.when(k % 2 == 0, 1).otherwise(2).alias("mtime"), F.when(k % 3 == 0, F.md5(F.concat("file_path", F.lit("x")))).otherwise(F.md5("file_path")).alias("content_hash"))
    return old, new


_LISTED = "SELECT CAST(o_orderkey AS VARCHAR) AS file_path, CASE WHEN o_orderkey % 5 = 0 THEN 'created' WHEN o_orderkey % 7 = 0 THEN 'removed' WHEN o_orderkey % 3 = 0 THEN 'content' WHEN o_orderkey % 2 = 1 THEN 'touched' END AS change FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0)"


@query(f"SELECT * FROM ({_LISTED}) WHERE change IS NOT NULL")
def listing_changes(spark, sf_dir):
    return upkeep.changes(*_listings(spark, sf_dir))


@query(f"SELECT 'walk' AS action, count(*) FILTER (change IN ('created', 'removed')) AS structural, count(*) FILTER (change = 'content') AS content FROM ({_LISTED})")
def refresh_plan(spark, sf_dir):
    return upkeep.plan(upkeep.changes(*_listings(spark, sf_dir)))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, coalesce(a.change, 'touched') = 'touched' AND coalesce(b.change, 'touched') = 'touched' AS fresh FROM orders LEFT JOIN ({_LISTED}) a ON a.file_path = CAST(o_orderkey AS VARCHAR) LEFT JOIN ({_LISTED}) b ON b.file_path = CAST(o_orderkey + 1 AS VARCHAR)")
def dependency_freshness(spark, sf_dir):
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(k.cast("string").alias("id"), k.cast("string").alias("file_path"))
    i = table(spark, sf_dir, "orders").select(k.cast("string").alias("importing_file"), (k + 1).cast("string").alias("imported_file"))
    return upkeep.dependency_fresh(upkeep.changes(*_listings(spark, sf_dir)), i, e)


# Entities, files and changes ------------------------------------------------------------


@query("SELECT 'm' || n_nationkey || '/' || i AS id, t AS content FROM nation, (VALUES ('models.py::class::Item::total', '  def total(self):' || chr(10) || '    return self.price()'), ('util.py::function::inner', 'def inner(make):' || chr(10) || '  return make')) AS v(i, t)")
def content_reconstruction(spark, sf_dir):
    files = project(spark, sf_dir)
    brief = extract.extracted(files, brief=True).filter(F.col("name").isin("total", "inner"))
    return search.reconstructed(brief, files).select("id", "content")


@query("SELECT 'm' || n_nationkey || '/service.py' AS file_path, CAST(l AS BIGINT) AS line, 'm' || n_nationkey || '/service.py::function::' || f AS id FROM nation, (VALUES (4, 'run'), (8, 'run'), (10, 'test_run'), (11, 'test_run')) AS v(l, f)")
def line_to_entity(spark, sf_dir):
    files = project(spark, sf_dir).filter("file_path like '%service.py'")
    points = files.select("file_path", F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 4, 8, 9, 10, 11)])).alias("line"))
    return search.innermost(points, extract.extracted(files, brief=True)).select("file_path", "line", "id")


@query("SELECT * FROM (VALUES ('ambiguous', 25), ('found', 1), ('not found', 1), ('not in file', 1)) AS v(status, n)")
def lookup_statuses(spark, sf_dir):
    nodes, _ = project_graph(spark, sf_dir)
    asked = (("run", None), ("run", "m2/service.py"), ("nobody", None), ("run", "m2/util.py"))
    out = None
    for name, file in asked:
        one = search.lookup(nodes, name, file).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT 'm' || n_nationkey || '/service.py::function::test_run' AS id FROM nation WHERE n_nationkey = 5")
def lexical_tests(spark, sf_dir):
    nodes, edges = project_graph(spark, sf_dir)
    return graph_build.tests_of(nodes.filter("file_path like 'm5/%'"), edges.limit(0), "m5/service.py::function::run").select("id")


@query("SELECT 'm' || n_nationkey || '/util.py::function::helper' AS entity_id, r AS direction, 'm' || n_nationkey || '/' || i AS id, d AS in_diff FROM nation, (VALUES ('caller', 'service.py::function::run', false), ('callee', 'util.py::function::inner', true)) AS v(r, i, d)")
def changed_relations(spark, sf_dir):
    nodes, edges = project_graph(spark, sf_dir)
    changed = nodes.filter("file_path like '%util.py'").select(F.col("id").alias("entity_id"))
    return graph_build.relations(changed, edges).filter(F.col("entity_id").endswith("helper"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'before' ELSE 'after' END AS name FROM customer")
def combined_map(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    before, after = c.withColumn("name", F.lit("before")), c.filter("id % 3 <> 0").withColumn("name", F.lit("after"))
    return graph_build.combined(before, after)


@query("SELECT 'm1/util.py::function::inner: 1 direct, 3 in all, 1 tests' AS text")
def impact_text(spark, sf_dir):
    nodes, edges = project_graph(spark, sf_dir)
    return sinks.impact_line("m1/util.py::function::inner", graph_build.impact(nodes, edges, "m1/util.py::function::inner", depth=0))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'ts' WHEN 1 THEN 'py' WHEN 2 THEN '' WHEN 3 THEN 'zz' ELSE 'rs' END AS suffix, CASE o_orderkey % 5 WHEN 0 THEN 'TypeScript' WHEN 1 THEN 'Python' WHEN 2 THEN '' WHEN 3 THEN 'zz' ELSE 'Rust' END AS language FROM orders")
def language_by_suffix(spark, sf_dir):
    from lamella.functions import text as T

    k = F.col("o_orderkey")
    ends = F.when(k % 5 == 0, "/b.test.TS").when(k % 5 == 1, ".py").when(k % 5 == 2, "/Makefile").when(k % 5 == 3, ".d/y.zz").otherwise(".py.Rs")
    paths = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("a"), k.cast("string"), ends).alias("path"))
    return paths.select("k", T.extension(F.col("path")).alias("suffix"), pieces.display_language(T.extension(F.col("path"))).alias("language"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.go' WHEN 3 THEN '.sh' WHEN 4 THEN '.json' WHEN 5 THEN '.rs' END AS suffix FROM orders")
def language_by_content(spark, sf_dir):
    k = F.col("o_orderkey")
    key, kind = k.cast("string"), k % 8
    text = (
        F.when(kind == 0, F.concat(F.lit("#!/usr/bin/env python3\nx = "), key))
        .when(kind == 1, F.concat(F.lit("a = "), key, F.lit("\n// vim: set ft=javascript :\n")))
        .when(kind == 2, F.concat(F.lit("package m\n\nfunc f"), key, F.lit("() {}\n")))
        .when(kind == 3, F.concat(F.lit("#!/bin/bash -e\necho "), key))
        .when(kind == 4, F.concat(F.lit(' {"k'), key, F.lit('": [1]}')))
        .when(kind == 5, F.concat(F.lit("fn a"), key, F.lit("() {}\nfn b() {}\nconst x = 1")))
        .when(kind == 6, F.concat(F.lit("fn lonely"), key))
        .otherwise(F.concat(F.lit("# vim: ft=unheard"), key))
    )
    return table(spark, sf_dir, "orders").select(k.alias("k"), pieces.language_of_content(text).alias("suffix"))


@query("SELECT o_orderkey % 50 AS g, 1 AS n FROM orders GROUP BY 1")
def extracted_once(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("g")).select("g", F.concat(F.lit("f"), F.col("g").cast("string"), F.lit(".txt")).alias("file_path"), F.lit("one\ntwo").alias("content"))
    once = upkeep.extracted_once(files, extract.extracted)
    return once.groupBy(F.regexp_extract("file_path", r"f(\d+)", 1).cast("long").alias("g")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS entities, count(*) FILTER (n = 'test_run') AS tests, 1 AS marks FROM nation, (VALUES ('Item'), ('total'), ('price'), ('make'), ('run'), ('test_run'), ('helper'), ('inner')) AS v(n)")
def test_flag_table(spark, sf_dir):
    flags = upkeep.test_flags(project_graph(spark, sf_dir)[0], graph_build.is_test())
    return flags.agg(F.count("entity_id").alias("entities"), F.count_if("is_test").alias("tests"), F.count_if(F.col("entity_id").isNull()).alias("marks"))
