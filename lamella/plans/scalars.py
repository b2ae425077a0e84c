"""Queries of the scalar functions, predicates, orders and context packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.functions import pieces
from lamella.functions import predicates as P
from lamella.functions import text as T
from lamella.operators import context, history
from lamella.plans.registry import _CHANGES, key_edges, order_changes, query, table
from lamella.sinks import documents as sinks


@query("SELECT p_partkey AS k, substr(md5(p_name), 1, 8) AS h FROM part")
def short_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), pieces.short_hash(F.col("p_name")).alias("h"))


@query("""SELECT p_partkey AS k, md5(CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '#!/bin/x ' || p_name WHEN 2 THEN p_name || ' end' ELSE p_name END) AS h FROM part""")
def raw_structural_hash(spark, sf_dir):
    d = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("# "), "p_name", F.lit("\n  // x"))).when(k == 1, F.concat(F.lit("#!/bin/x\n"), "p_name")).when(k == 2, F.concat("p_name", F.lit("\n# gone\n\tend"))).otherwise(F.concat(F.lit("  "), "p_name"))
    return d.select(F.col("p_partkey").alias("k"), pieces.structural_hash(text).alias("h"))


@query("""WITH l AS (SELECT conv_id, turn, unnest(range(1, 9)) AS i FROM conversations WHERE turn = 0), t AS (SELECT conv_id, string_agg('line ' || i || ' of text', chr(10) ORDER BY i) AS head, i_max FROM l JOIN (SELECT unnest(range(1, 8)) AS i_max) ON i <= i_max GROUP BY conv_id, i_max),
e AS (SELECT *, head || chr(10) || '… truncated: ' || (8 - i_max) || ' more lines' AS whole FROM t), f AS (SELECT conv_id, whole, i_max, greatest(len(string_split_regex(whole, '[ \\n]+')) * 13 // 10, length(whole) // 4) AS tokens FROM e)
SELECT conv_id, max_by(whole, i_max) AS head FROM f WHERE tokens <= 25 GROUP BY conv_id""".replace("\\\\n", "\\n"))
def head_truncation(spark, sf_dir):
    text = "\n".join(f"line {i} of text" for i in range(1, 9))
    return table(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", pieces.head(F.lit(text), 25).alias("head"))


@query("SELECT n_nationkey AS k, 'a' || n_nationkey AS object, 'run' AS member FROM nation UNION ALL SELECT n_nationkey, 'x_1', 'y' FROM nation")
def dot_chain_pairs(spark, sf_dir):
    text = F.concat(F.lit("call a"), F.col("n_nationkey").cast("string"), F.lit(".run(3.14) + x_1.y"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.inline(pieces.dot_chains(text)))


@query("SELECT o_orderkey AS k, format('{:,}', CAST(o_orderkey * 1000 AS BIGINT)) AS n, CASE WHEN o_orderkey < 1024 THEN o_orderkey || ' B' ELSE printf('%.1f', o_orderkey / 1024.0) || ' KB' END AS size FROM orders WHERE o_orderkey < 1000000")
def number_formats(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").filter("o_orderkey < 1000000").select(k.alias("k"), pieces.thousands(k * 1000).alias("n"), pieces.byte_size(k).alias("size"))


@query("SELECT doc_id, CAST(length(substr(text, 1, 100)) - length(replace(substr(text, 1, 100), chr(10), '')) + 1 AS BIGINT) AS line, instr(text || chr(10), chr(10)) AS second FROM documents")
def line_places(spark, sf_dir):
    text = F.col("text")
    starts = pieces.line_starts(F.concat_ws("\n", F.substring_index(text, "\n", 1), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", pieces.line_of_char(text, F.lit(100)).alias("line"), F.get(starts, F.lit(1)).cast("long").alias("second"))


@query("SELECT n_nationkey AS k, 'keep [old' || n_nationkey || '] tail' AS a, 'keep [new' || n_nationkey || ' more] tail' AS b FROM nation")
def inline_diffs(spark, sf_dir):
    k = F.col("n_nationkey").cast("string")
    a, b = F.concat(F.lit("keep old"), k, F.lit(" tail")), F.concat(F.lit("keep new"), k, F.lit(" more tail"))
    x, y = pieces.inline_diff(a, b)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), x.alias("a"), y.alias("b"))


@query("SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'A::B' WHEN 1 THEN 'mod.K' END AS parent, 'n' || n_nationkey AS name FROM nation")
def qualified_names(spark, sf_dir):
    k = F.col("n_nationkey")
    name = F.concat(F.when(k % 3 == 0, "A::B::").when(k % 3 == 1, "mod.K.").otherwise(""), F.lit("n"), k.cast("string"))
    parent, own = pieces.qualified(name)
    return table(spark, sf_dir, "nation").select(k.alias("k"), parent.alias("parent"), own.alias("name"))


@query("SELECT n_nationkey AS k, 'a/c' || n_nationkey || '.ts' AS path, 'ts' AS extension, 'c' || n_nationkey AS stem FROM nation")
def path_parts(spark, sf_dir):
    k = F.col("n_nationkey")
    path = pieces.normalised_path(F.concat(F.lit("./a\\b//../c"), k.cast("string"), F.lit(".ts")))
    return table(spark, sf_dir, "nation").select(k.alias("k"), path.alias("path"), T.extension(path).alias("extension"), T.file_stem(path).alias("stem"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'host.org/a/n' ELSE 'git.host.org/b' END || n_nationkey AS url FROM nation")
def remote_urls(spark, sf_dir):
    k = F.col("n_nationkey")
    url = F.concat(F.when(k % 2 == 0, "git@Host.org:a/n").otherwise("https://user@Git.Host.org/b"), k.cast("string"), F.when(k % 2 == 0, ".git").otherwise("/"))
    return table(spark, sf_dir, "nation").select(k.alias("k"), T.remote_url(url).alias("url"))


@query("SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def civil_days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), T.day(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("day"))


@query("SELECT p_partkey AS k, CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 9) || '…' ELSE p_name END AS t FROM part")
def truncations(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), T.truncated(F.col("p_name"), 10).alias("t"))


@query("SELECT n_nationkey AS k, n_nationkey % 2 = 0 AS hit FROM nation")
def whole_words(spark, sf_dir):
    k = F.col("n_nationkey")
    body = F.when(k % 2 == 0, "x = run(1)").otherwise("x = rerun(run_2)")
    return table(spark, sf_dir, "nation").select(k.alias("k"), T.has_word(body, F.lit("run")).alias("hit"))


@query("SELECT n_nationkey AS k, n_nationkey % 5 IN (0, 3) AS binary_change FROM nation")
def undiffable_changes(spark, sf_dir):
    k = F.col("n_nationkey") % 5
    status = F.when(k == 0, "added").when(k == 1, "added").when(k == 2, "deleted").otherwise("modified")
    before, after = F.when(k.isin(2, 4), "x"), F.when(k.isin(1, 3, 4), "y")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), pieces.undiffable(status, before, after).alias("binary_change"))


@query("SELECT n_nationkey AS k, n_nationkey % 4 = 1 OR n_nationkey % 4 = 3 AS binary_content FROM nation")
def binary_contents(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    raw = F.when(k == 0, F.unhex(F.lit("C3A4300A"))).when(k == 1, F.unhex(F.lit("410042"))).when(k == 2, F.unhex(F.lit("5000"[:2] + "0a"))).otherwise(F.unhex(F.lit("41FF42")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), pieces.binary_content(raw).alias("binary_content"))


_MARKED = (
    "SELECT o_orderkey AS k, o_orderkey % 2 = 1 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 IN (0, 1) AS is_test, "
    "o_orderkey % 7 = 0 OR o_orderkey % 13 = 0 AS stub FROM orders"
)


@query(_MARKED)
def packer_tests(spark, sf_dir):
    """Names, paths and texts by the order's key: a name, a folder, an attribute or a file's ending marks a test."""
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 2 == 1, "test_").otherwise("latest_"), k.cast("string"))
    path = F.concat(F.when(k % 5 == 0, "pkg/tests/").otherwise("src/contests/"), F.lit("a"), k.cast("string"), F.when(k % 11 == 0, "_test.go").when(k % 11 == 1, ".spec.ts").otherwise(".rs"))
    text = F.when(k % 7 == 0, F.lit("  #[test]\nfn a()")).when(k % 13 == 0, F.lit("// a\nfn a()")).otherwise(F.lit("fn a() // #[test]"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), pieces.packer_test(name, path, text).alias("is_test"), pieces.stub_signature(text).alias("stub"))


@query("SELECT n_nationkey AS k, n_nationkey % 4 = 0 AS manifest, n_nationkey % 4 IN (1, 2) AS noise FROM nation")
def watched_paths(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    path = F.when(k == 0, "a/Package.json").when(k == 1, "x/.git/index").when(k == 2, "node_modules/a.js").otherwise("src/.github/a.js")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), pieces.manifest_file(path).alias("manifest"), pieces.noise_path(path, P.default_excluded(path)).alias("noise"))


@query("SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM benchmark) WHERE regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*') AND length(w) >= CASE WHEN regexp_matches(w, '^[a-z]') THEN 3 ELSE 2 END AND w NOT IN ('the', 'and')")
def reference_words(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.identifiers(F.col("text"))).alias("word")).distinct()
    return words.filter(pieces.reference_word(F.col("word"), ("the", "and")))


@query("SELECT n_nationkey AS k, 'load_cfg' || n_nationkey || ' parseFile' AS names FROM nation")
def prompt_identifiers(spark, sf_dir):
    k = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("why does load_cfg"), k, F.lit(" fail when this class calls Tool.parseFile or runAgain?"))
    names = pieces.prompt_names(F.replace(text, F.concat(F.lit("load_cfg"), k), F.concat(F.lit("`load_cfg"), k, F.lit("`"))))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.array_join(names, " ").alias("names"))


@query("SELECT p_partkey AS k, regexp_matches('src/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '/deep' ELSE '' END || '/x.' || CASE WHEN p_partkey % 2 = 0 THEN 'py' ELSE 'md' END, '^src/(.*/)?[^/]*[.]py$') AS hit FROM part")
def pathspec_globs(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.concat(F.lit("src/"), k.cast("string"), F.when(k % 3 == 0, "/deep").otherwise(""), F.lit("/x."), F.when(k % 2 == 0, "py").otherwise("md"))
    return table(spark, sf_dir, "part").select(k.alias("k"), path.rlike(P.glob_regex("src/**/*.py")).alias("hit"))


@query("SELECT p_type AS entity_type, count(*) AS n FROM part WHERE p_size % 5 = 0 GROUP BY 1")
def code_kinds(spark, sf_dir):
    kinds = F.when(F.col("p_size") % 5 == 0, "function").when(F.col("p_size") % 5 == 1, "heading").otherwise("property")
    return table(spark, sf_dir, "part").withColumn("kind", kinds).filter(P.code_kind(F.col("kind"))).groupBy(F.col("p_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


# Ranges, orders and limits ----------------------------------------------------------


@query("SELECT l_orderkey AS k, l_linenumber AS line, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS last FROM lineitem WHERE l_orderkey % 50 = 0")
def next_boundary(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").filter("l_orderkey % 50 = 0")
    return history.next_boundary(d, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_linenumber").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), "last")


@query("SELECT n_nationkey AS k, '1 4 8 9 10' AS own, '2-3 5-7' AS spans FROM nation")
def range_arithmetic(spark, sf_dir):
    span = lambda a, b: F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
    merged = pieces.merged_ranges(F.array(span(5, 6), span(2, 3), span(6, 7)))
    spans = F.transform(merged, lambda s: F.struct(s["a"].alias("start_line"), s["b"].alias("end_line")))
    own = pieces.free_lines(F.lit(1).cast("long"), F.lit(10).cast("long"), spans)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.array_join(F.transform(own, lambda x: x.cast("string")), " ").alias("own"), F.array_join(F.transform(merged, lambda s: F.concat_ws("-", s["a"].cast("string"), s["b"].cast("string"))), " ").alias("spans"))


@query(f"WITH {_CHANGES}, h AS (SELECT entity, count(*) AS commits FROM c GROUP BY entity) SELECT entity, commits FROM h ORDER BY commits DESC, entity LIMIT 15")
def hotspots_top15(spark, sf_dir):
    return history.top(history.hotspots(order_changes(spark, sf_dir)).select("entity", "commits"), 15, ["commits"], ["entity"])


@query(f"WITH {_CHANGES}, s AS (SELECT c.* FROM c JOIN (SELECT sha FROM c GROUP BY sha HAVING count(*) <= 50) USING (sha)), p AS (SELECT x.entity AS a, y.entity AS b, count(*) AS together FROM s x JOIN s y ON x.sha = y.sha AND x.entity < y.entity GROUP BY ALL HAVING count(*) >= 2) SELECT a, b, together FROM p ORDER BY together DESC, a, b LIMIT 12")
def pairs_top12(spark, sf_dir):
    return history.top(history.co_changes(order_changes(spark, sf_dir)).select("a", "b", "together"), 12, ["together"], ["a", "b"])


@query("SELECT o_orderkey AS sha FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51")
def commit_window(spark, sf_dir):
    commits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("committed_at"))
    return history.newest(commits, 50).select("sha")


@query("SELECT doc_id AS file_path, CAST(i AS BIGINT) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i) WHERE contains(l[i], 'License') ORDER BY 1, 2 LIMIT 50".replace("\\\\", "\\"))
def text_hits_first50(spark, sf_dir):
    from lamella.operators import search

    return search.first_hits(table(spark, sf_dir, "documents"), "doc_id", "text", "License", 50)


@query("SELECT path, rank, row_number() OVER (ORDER BY rank, path) AS place FROM (SELECT 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' ELSE '.md' END AS path, CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS rank FROM pages)")
def extension_order(spark, sf_dir):
    """All pages as files with their place by extension, then by path, in that order."""
    k = F.col("page_id")
    d = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), k.cast("string"), F.when(k % 3 == 0, ".js").when(k % 3 == 1, ".ts").otherwise(".md")).alias("path"))
    return history.placed(d.withColumn("rank", pieces.extension_rank(F.col("path"), [".ts", ".js"])), ["rank", "path"]).orderBy("place")


@query("SELECT lang, language, count(*) AS n FROM (SELECT lang, CASE lang WHEN 'en' THEN 'Python' WHEN 'fr' THEN 'Rust' ELSE lang END AS language FROM documents) GROUP BY ALL")
def language_histogram(spark, sf_dir):
    suffix = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "fr", "rs").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("lang", pieces.display_language(suffix).alias("language")).groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


# History ------------------------------------------------------------------------------


@query("SELECT l_partkey AS id, count(*) AS change_count FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1")
def legacy_hotspots(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 2).cast("string").alias("file_path"))
    return history.change_counts(rows, ["id"], file_path="0").select("id", "change_count")


@query("""WITH o AS (SELECT o_orderkey AS sha, o_custkey, o_orderkey % 7 = 0 AS merge, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders), w AS (SELECT * FROM o WHERE k <= 101), b AS (SELECT max(k) AS last FROM w)
SELECT l_partkey AS entity, count(DISTINCT w.sha) AS commits FROM w, b, lineitem WHERE l_orderkey = w.sha AND NOT merge AND k < last GROUP BY 1""")
def stored_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("committed_at"), (F.col("o_orderkey") % 7 == 0).alias("is_merge"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("entity"))
    return history.stored(rows, o, limit=100)["hotspots"].select("entity", "commits")


@query("""SELECT user_id, event_id, CASE WHEN k = 1 THEN 'added' WHEN moved THEN 'moved' WHEN renamed THEN 'renamed' ELSE 'modified' END AS change, NOT coalesce(moved, false) AND NOT coalesce(renamed, false) AND k > 1 AND structural AS logic FROM (
SELECT user_id, event_id, row_number() OVER w AS k, event_type <> lag(event_type) OVER w AS moved, event_id % 3 <> lag(event_id % 3) OVER w AS renamed, props <> lag(props) OVER w AS content, md5(props) <> lag(md5(props)) OVER w AS structural FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k = 1 OR moved OR renamed OR content""")
def history_trace(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("file_path"), F.lit(None).cast("string").alias("parent_id"), (F.col("event_id") % 3).cast("string").alias("name"), F.md5("props").alias("content_hash"), F.md5("props").alias("structural_hash"))
    return history.trace(d, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "change", "logic")


@query("SELECT md5(string_agg(o_orderkey || ':' || epoch_us(o_orderdate), '|' ORDER BY o_orderkey) || '#' || count(*)) AS hash FROM orders")
def manifest_hash(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("mtime"))
    return history.manifest_hash(f)


# Context --------------------------------------------------------------------------------

_NODES = (
    ("t", "src/a.py", "def t():\n  one two three four five six seven eight nine ten"),
    ("d1", "src/b.py", "def d1():\n  small"),
    ("d2", "src/b.py", "def d2():\n" + "  many words here again and again\n" * 12),
    ("u1", "src/c.py", "def u1():\n  call t"),
    ("test_u", "src/c.py", "def test_u():\n  t()"),
    ("far", "src/d.py", "def far():\n  d1()"),
    ("stub", "src/d.py", "@decorated\ndef stub(): d1()"),
    ("up", "src/e.py", "def up():\n  u1()"),
)
_LINKS = (("t", "d1"), ("t", "d2"), ("u1", "t"), ("test_u", "t"), ("d1", "far"), ("d1", "stub"), ("up", "u1"))


def small_graphs(spark, sf_dir):
    """The graph above for every customer, its ids and names ending with the key, and of every third the target's text longer by 40 words."""
    k = F.col("c_custkey").cast("string")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    name = lambda x: F.concat(F.lit(x), k)
    more = F.when(F.col("c_custkey") % 3 == 0, F.lit("\n" + "  and so on\n" * 13)).otherwise(F.lit(""))
    n = F.array(*[F.struct(name(a).alias("id"), name(a).alias("name"), F.lit(b).alias("file_path"), (F.concat(F.lit(t), more) if a == "t" else F.lit(t)).alias("content")) for a, b, t in _NODES])
    e = F.array(*[F.struct(name(a).alias("from_entity"), name(b).alias("to_entity"), F.lit("calls").alias("ref_type")) for a, b in _LINKS])
    return c.select(F.inline(n)), c.select(F.inline(e)), c.select(name("t").alias("id"))


def _context(spark, sf_dir, budget, hops=0):
    return context.packed_many(*small_graphs(spark, sf_dir), budget, hops)


_PLACES = "SELECT 't' || c_custkey AS target, CAST(p AS INTEGER) AS place, e || c_custkey AS entity_id, role, form FROM customer, (VALUES {}) AS v(p, e, role, form, third) WHERE third IS NULL OR third = (c_custkey % 3 = 0)"


@query(_PLACES.format("(0, 't', 'target', 'full', NULL), (1, 'd1', 'direct_dependency', 'full', NULL), (2, 'd2', 'direct_dependency', 'signature', NULL), (3, 'u1', 'direct_dependent', 'full', NULL), (4, 'far', 'transitive_dependency', 'signature', NULL), (5, 'up', 'transitive_dependent', 'signature', NULL)"))
def context_entries(spark, sf_dir):
    return _context(spark, sf_dir, 100)["entries"].select("target", "place", "entity_id", "role", "form")


@query("SELECT 't' || c_custkey AS target, role, CAST(n AS BIGINT) AS entities, CAST(t AS BIGINT) AS tests FROM customer, (VALUES ('direct_dependent', 1, 1), ('transitive_dependency', 1, 0)) AS v(role, n, t)")
def context_omitted(spark, sf_dir):
    return _context(spark, sf_dir, 100)["omitted"]


@query(_PLACES.format("(0, 't', 'target', 'signature', NULL), (1, 'd1', 'direct_dependency', 'signature', NULL), (2, 'd2', 'direct_dependency', 'signature', NULL)"))
def context_tight(spark, sf_dir):
    return _context(spark, sf_dir, 6, hops=1)["entries"].select("target", "place", "entity_id", "role", "form")


@query("SELECT 0 AS n, count(*) AS targets FROM customer")
def context_without_room(spark, sf_dir):
    targets = small_graphs(spark, sf_dir)[2]
    n = _context(spark, sf_dir, 1)["entries"].agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.crossJoin(targets.agg(F.count(F.lit(1)).alias("targets")))


@query("SELECT 't' || c_custkey AS target, '## t' || c_custkey || ' (target)' AS first_line, 6 AS parts FROM customer")
def context_text(spark, sf_dir):
    text = context.as_text(_context(spark, sf_dir, 100)["entries"])
    return text.select("target", F.substring_index("text", "\n", 1).alias("first_line"), F.size(F.filter(F.split("text", "\n"), lambda x: x.startswith("## "))).alias("parts"))


@query("SELECT n_nationkey AS file_path, '### ' || n_nationkey || chr(10) || chr(10) || '- ~ `f` (function)' || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN '````' ELSE '```' END || 'diff' || chr(10) || '-old' || chr(10) || '+new' || CASE WHEN n_nationkey % 2 = 0 THEN ' ```' ELSE '' END || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN '````' ELSE '```' END AS markdown FROM nation")
def markdown_changes(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.cast("string").alias("file_path"), F.lit("modified").alias("change_type"), F.lit("function").alias("entity_type"), F.lit("f").alias("entity_name"), F.lit(1).alias("entity_line"), F.lit("e").alias("entity_id"), F.lit("old").alias("before_content"), F.concat(F.lit("new"), F.when(k % 2 == 0, " ```").otherwise("")).alias("after_content"))
    return sinks.markdown(rows).select(F.col("file_path").cast("int").alias("file_path"), "markdown")


@query("SELECT n_nationkey AS file_path, 3 AS line, CASE WHEN n_nationkey % 2 = 0 THEN 'r function g (from f)' ELSE '+ function g' END AS text FROM nation")
def plain_changes(spark, sf_dir):
    k = F.col("n_nationkey")
    even = k % 2 == 0
    rows = table(spark, sf_dir, "nation").select(k.alias("file_path"), F.lit(3).alias("entity_line"), F.when(even, "renamed").otherwise("added").alias("change_type"), F.lit("function").alias("entity_type"), F.lit("g").alias("entity_name"), F.when(even, "f").alias("old_entity_name"), F.lit(None).cast("string").alias("old_file_path"))
    return sinks.plain_lines(rows)


@query("SELECT 'customer:' || c_custkey AS id, CAST(2 AS BIGINT) AS depth FROM customer")
def ancestor_depth(spark, sf_dir):
    e = key_edges(spark, sf_dir).filter("from_entity not like 'orders:%' and from_entity not like 'supplier:%'")
    nodes = e.select(F.col("from_entity").alias("id"), F.col("to_entity").alias("parent_id"), F.col("from_entity").alias("name"))
    roots = e.filter("to_entity like 'region:%'").select(F.col("to_entity").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("to_entity").alias("name")).distinct()
    from lamella.operators import matching

    return matching.depths(nodes.union(roots)).filter("id like 'customer:%'")
