"""All queries of the engine, bound to the test tables, with the same questions in SQL.

Rows of the star schema stand for entities: foreign keys are dependencies,
orders are commits, and the parts of an order are the entities it changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import predicates as P
from lamella.functions import text as T
from lamella.operators import diff, entities, graph, history, search, similarity
from lamella.storage import parted
from lamella.streaming import incremental

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def keep(f):
        _found[f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _found.items() if sql}


# Entities -------------------------------------------------------------------

_LINES = "CASE WHEN string_split(t, chr(10))[-1] = '' THEN string_split(t, chr(10))[1:-2] ELSE string_split(t, chr(10)) END"
_LINED = rf"l AS (SELECT doc_id, {_LINES} AS l FROM (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents))"


@query(rf"""WITH {_LINED}, c AS (SELECT doc_id, k, l[20 * k + 1:20 * k + 20] AS p, least(20 * k + 20, len(l)) AS e FROM l, unnest(range(0, (len(l) + 19) // 20)) AS u(k))
SELECT doc_id || '::chunk::lines ' || (20 * k + 1) || '-' || e AS id, doc_id AS file_path, CAST(20 * k + 1 AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line, md5(array_to_string(p, chr(10))) AS content_hash FROM c""")
def chunk_entities(spark, sf_dir):
    return entities.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("id", "file_path", "start_line", "end_line", "content_hash")


@query("SELECT 'nation.csv::row::row[' || n_nationkey || ']' AS id, 'row[' || n_nationkey || ']' AS name, n_name AS cell_name, CAST(n_regionkey AS VARCHAR) AS cell_region, md5(n_nationkey || ',' || n_name || ',' || n_regionkey) AS content_hash FROM nation")
def csv_row_entities(spark, sf_dir):
    d = entities.row_entities(table(spark, sf_dir, "nation"), "nation.csv", "n_nationkey")
    return d.select("id", "name", F.col("metadata")["n_name"].alias("cell_name"), F.col("metadata")["n_regionkey"].alias("cell_region"), F.md5("content").alias("content_hash"))


@query("SELECT event_id || '::/' || k AS id, k AS key, json_extract_string(props, '$.' || k) AS value, md5(json_extract_string(props, '$.' || k)) AS structural_hash FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_prop_entities(spark, sf_dir):
    return entities.json_properties(table(spark, sf_dir, "events"), "event_id", "props").select("id", "key", "value", "structural_hash")


@query("SELECT page_id AS file_path, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL")
def html_tag_entities(spark, sf_dir):
    return entities.tags(table(spark, sf_dir, "pages"), "page_id", "html")


@query("""WITH e AS (SELECT 'lineitem::' || l_orderkey || '::' || l_linenumber AS id, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT CASE WHEN n = 1 THEN id ELSE id || '@L' || l_linenumber || CASE WHEN k > 1 THEN '#' || k ELSE '' END END AS unique_id FROM e""")
def id_collisions(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("::", F.lit("lineitem"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return entities.disambiguated(d, "id", "l_linenumber", ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]).select("unique_id")


# Diffs ----------------------------------------------------------------------


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as they are, and a former state: every fifth missing, every third of another segment, some of ids that are gone."""
    c = table(spark, sf_dir, "customer")
    own = lambda d, seg: d.select(F.concat(F.lit("customer::row::row["), F.col("c_custkey").cast("string"), F.lit("]")).alias("id"), F.col("c_nationkey").alias("file_path"), F.md5(F.concat_ws(",", F.col("c_name"), seg)).alias("content_hash"))
    old = c.filter("c_custkey % 5 <> 0").withColumn("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey") + 100_000_000).otherwise(F.col("c_custkey")))
    return own(old, F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))), own(c, F.col("c_mktsegment"))


_SNAP = """WITH old AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 100000000 ELSE c_custkey END AS k, * FROM customer WHERE c_custkey % 5 <> 0),
b AS (SELECT 'customer::row::row[' || k || ']' AS id, c_nationkey AS file_path, md5(c_name || ',' || CASE WHEN k % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END) AS h FROM old),
a AS (SELECT 'customer::row::row[' || c_custkey || ']' AS id, c_nationkey AS file_path, md5(c_name || ',' || c_mktsegment) AS h FROM customer),
d AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS change_type FROM b FULL OUTER JOIN a ON a.id = b.id)
"""


@query(_SNAP + "SELECT id, change_type FROM d WHERE change_type <> 'unchanged'")
def diff_changes(spark, sf_dir):
    return diff.by_id(*snapshots(spark, sf_dir)).filter("change_type <> 'unchanged'")


@query(_SNAP + "SELECT count(DISTINCT file_path) AS file_count, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'modified') AS modified, count(*) FILTER (change_type = 'deleted') AS deleted, CAST(0 AS BIGINT) AS moved, CAST(0 AS BIGINT) AS renamed, CAST(0 AS BIGINT) AS reordered, count(*) AS total FROM d WHERE change_type <> 'unchanged'")
def diff_summary(spark, sf_dir):
    before, after = snapshots(spark, sf_dir)
    paths = before.select("id", "file_path").union(after.select("id", "file_path")).groupBy("id").agg(F.min("file_path").alias("file_path"))
    changes = diff.by_id(before, after).filter("change_type <> 'unchanged'").join(paths, "id").withColumn("content_changed", F.col("change_type") == "modified")
    return diff.summary(changes)


@query("""WITH b AS (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) AS k FROM documents WHERE doc_id % 2 = 0),
a AS (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 1)
SELECT b.doc_id AS before_id, a.doc_id AS after_id, h AS digest FROM b JOIN a USING (h, k)""")
def match_by_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return diff.by_hash(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "doc_id", "digest")


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 1 OR turn % 4 = 2 THEN 'moved' WHEN turn % 4 = 3 THEN 'renamed' ELSE 'modified' END AS change_type FROM conversations""")
def classify_matches(spark, sf_dir):
    k = F.col("turn") % 4
    c = table(spark, sf_dir, "conversations").withColumn("k", k)
    side = {f"{x}_{f}": F.when(F.col("k") == n, F.lit(x)).otherwise(F.lit("same")) for x in "ab" for f, n in (("file_path", 1), ("parent_id", 2), ("name", 3))}
    side |= {f"{x}_entity_type": F.lit("turn") for x in "ab"}
    return c.withColumns(side).select("conv_id", "turn", diff.classified().alias("change_type"))


@query(r"""SELECT doc_id, doc_id % 3 <> 0 AS content_changed, doc_id % 3 = 2 AS structural_change FROM documents WHERE text LIKE '% %'""")
def cosmetic_changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text like '% %'")
    after = F.when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit(" "), F.lit(" \n "))).when(F.col("doc_id") % 3 == 2, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    return d.select("doc_id", (F.md5("text") != F.md5(after)).alias("content_changed"), diff.structural_change(F.col("text"), after).alias("structural_change"))


@query(rf"""WITH {_LINED}, x AS (SELECT doc_id, i AS line FROM l, unnest(range(1, len(l) + 1)) AS u(i)), f AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM x WHERE line % 7 NOT IN (0, 3))
SELECT doc_id AS file_path, min(line) AS start_line, max(line) AS end_line, count(*) AS n_lines FROM f GROUP BY doc_id, g""")
def orphan_segments(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path"), F.size(T.lines(F.col("text"))).alias("n")).filter("n > 0")
    lines = d.select("file_path", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("line"))
    return diff.orphan_segments(lines, lines.filter("line % 7 in (0, 3)"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS n FROM conversations),
best AS (SELECT conv_id, turn, n, 1 AS len FROM c UNION SELECT c.conv_id, c.turn, c.n, best.len + 1 FROM best JOIN c ON c.conv_id = best.conv_id AND c.turn > best.turn AND c.n >= best.n)
SELECT conv_id, count(DISTINCT turn) AS turns, count(DISTINCT turn) - max(len) AS out_of_order FROM best GROUP BY conv_id""")
def reorder_lnds(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return diff.reordered(d, "conv_id", "turn", "n").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if("reordered").alias("out_of_order"))


_WORDS = r"list_distinct(list_filter(string_split_regex(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> ''))"


_CLASSES = rf"""WITH w AS (SELECT doc_id, lang, list_sort({_WORDS}) AS w FROM documents), c AS (SELECT doc_id, lang, w, min(doc_id) OVER (PARTITION BY lang, w) AS representative FROM w WHERE len(w) > 0)"""


@query(rf"""WITH d AS (SELECT doc_id, lang, {_WORDS} AS w FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) AS both, len(a.w) AS na, len(b.w) AS nb FROM d a JOIN d b ON a.lang = b.lang AND a.doc_id < b.doc_id AND 100 * least(len(a.w), len(b.w)) >= 80 * greatest(len(a.w), len(b.w)))
SELECT a, b, CAST(both AS INTEGER) AS both_words FROM p WHERE 100 * both >= 80 * (na + nb - both)""".replace("AS both,", "AS both_,").replace("CAST(both AS", "CAST(both_ AS").replace("100 * both >=", "100 * both_ >=").replace("nb - both)", "nb - both_)"))
def fuzzy_match_candidates(spark, sf_dir):
    """All pairs alike, those of documents with the same words included."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return similarity.row_pairs(d, "doc_id", "text", "lang").select("a", "b", F.col("both").alias("both_words"))


@query(_CLASSES + " SELECT doc_id, representative FROM c")
def fuzzy_match_members(spark, sf_dir):
    return similarity.classes(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


@query(r"""WITH p AS (SELECT a.conv_id, a.turn, list_filter(string_split_regex(a.text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS x, list_filter(string_split_regex(b.text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
q AS (SELECT conv_id, turn, len(x) AS nx, len(y) AS ny, len(list_intersect(x, y)) AS i, len(list_distinct(list_concat(x, y))) AS u FROM p)
SELECT conv_id, turn, CASE WHEN least(nx, ny) / greatest(nx, ny, 1) < 0.6 OR u = 0 THEN 0.0 ELSE round(i / u, 6) END AS score FROM q""")
def similarity_scores(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.similarity(F.col("text"), F.col("next")), 6).alias("score"))


# Graph ----------------------------------------------------------------------

_KEYS = (("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("orders", "o_orderkey", "customer", "o_custkey"))


def key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as dependencies, child to parent."""
    out = None
    for child, key, parent, ref in _KEYS:
        one = table(spark, sf_dir, child).select(F.concat(F.lit(f"{child}:"), F.col(key).cast("string")).alias("from_entity"), F.concat(F.lit(f"{parent}:"), F.col(ref).cast("string")).alias("to_entity"), F.lit("typeref").alias("ref_type"))
        out = one if out is None else out.union(one)
    return out


_EDGES = "e AS (" + " UNION ALL ".join(f"SELECT '{c}:' || {k} AS f, '{p}:' || {r} AS t FROM {c}" for c, k, p, r in _KEYS) + ")"


@query(f"WITH {_EDGES} SELECT t AS id FROM e WHERE f = 'customer:1'")
def direct_deps(spark, sf_dir):
    e = key_edges(spark, sf_dir)
    return graph.neighbours(e, e.select(F.col("to_entity").alias("id")).distinct(), "customer:1")


@query(f"WITH {_EDGES} SELECT DISTINCT f AS id FROM e WHERE t = 'nation:3'")
def direct_dependents(spark, sf_dir):
    e = key_edges(spark, sf_dir)
    return graph.neighbours(e, e.select(F.col("from_entity").alias("id")).distinct(), "nation:3", reverse=True)


_REACH = f"WITH RECURSIVE {_EDGES}, r AS (SELECT 'region:0' AS id, 0 AS depth UNION SELECT e.f, r.depth + 1 FROM r JOIN e ON e.t = r.id WHERE r.depth < 9)"


def _start(spark: SparkSession, node: str) -> DataFrame:
    return spark.range(1).select(F.lit(node).alias("id"))


@query(_REACH + " SELECT id, min(depth) AS depth FROM r WHERE depth BETWEEN 1 AND 2 GROUP BY id")
def impact_depth(spark, sf_dir):
    return graph.reach(key_edges(spark, sf_dir), _start(spark, "region:0"), depth=2)


@query(_REACH + " SELECT count(DISTINCT id) AS n FROM r WHERE depth > 0")
def impact_count(spark, sf_dir):
    return graph.reach(key_edges(spark, sf_dir), _start(spark, "region:0")).agg(F.count_distinct("id").alias("n"))


@query(_REACH + " SELECT id, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY id ORDER BY depth, id LIMIT 100")
def impact_capped(spark, sf_dir):
    return graph.reach(key_edges(spark, sf_dir), _start(spark, "region:0"), most=100)


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT 'orders:1' AS id, 0 AS depth UNION SELECT e.t, r.depth + 1 FROM r JOIN e ON e.f = r.id) SELECT id, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY id")
def reach_forward(spark, sf_dir):
    return graph.reach(key_edges(spark, sf_dir), _start(spark, "orders:1"), reverse=False)


@query(_REACH + " SELECT DISTINCT id FROM r WHERE depth > 0 AND id LIKE 'customer:%5'")
def test_impact(spark, sf_dir):
    hit = graph.reach(key_edges(spark, sf_dir), _start(spark, "region:0"))
    tests = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id")).filter(F.col("id").endswith("5"))
    return hit.join(tests, "id", "left_semi").select("id")


@query(f"""WITH RECURSIVE {_EDGES}, n AS (SELECT f AS id FROM e UNION SELECT t FROM e), s AS (SELECT id FROM n WHERE CAST(split_part(id, ':', 2) AS BIGINT) % 100 = 0),
r AS (SELECT id AS start, id, 0 AS depth FROM s UNION SELECT r.start, e.f, r.depth + 1 FROM r JOIN e ON e.t = r.id WHERE r.depth < 9)
SELECT start, id, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY start, id""")
def impact_of_many(spark, sf_dir):
    e = key_edges(spark, sf_dir)
    ids = e.select(F.explode(F.array("from_entity", "to_entity")).alias("id")).distinct()
    return graph.reach_many(e, ids.filter(F.substring_index("id", ":", -1).cast("long") % 100 == 0))


@query("SELECT p_brand AS name, string_agg(CAST(p_partkey AS VARCHAR), ' ' ORDER BY p_type, p_size, p_partkey) AS ids FROM part GROUP BY p_brand")
def symbol_table(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("file_path"), F.col("p_size").alias("start_line"), F.col("p_size").alias("end_line"), F.col("p_partkey").alias("id"))
    return graph.symbol_table(n).select("name", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("""WITH e AS (SELECT l_partkey AS f, l_suppkey AS t, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'typeref' END AS r FROM lineitem)
SELECT f AS from_entity, t AS to_entity, CASE min(CASE r WHEN 'calls' THEN 0 WHEN 'imports' THEN 1 ELSE 2 END) WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' ELSE 'typeref' END AS ref_type FROM e GROUP BY f, t""")
def edge_dedupe(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "imports").otherwise("typeref")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("from_entity"), F.col("l_suppkey").alias("to_entity"), kind.alias("ref_type"))
    return graph.deduplicated(e.withColumn("p", graph.rank(F.col("ref_type"))), "p", "ref_type")


@query(f"WITH {_EDGES} SELECT f AS from_entity, t AS to_entity, 'typeref' AS ref_type FROM e WHERE f LIKE 'nation:%' AND t LIKE 'region:%'")
def induced_subgraph(spark, sf_dir):
    e = key_edges(spark, sf_dir)
    ids = e.select(F.explode(F.array("from_entity", "to_entity")).alias("id")).filter("id like 'nation:%' or id like 'region:%'").distinct()
    return graph.among(e, ids)


@query(f"WITH {_EDGES}, k AS (SELECT t, f, row_number() OVER (PARTITION BY t ORDER BY f) AS k FROM (SELECT DISTINCT f, t FROM e)) SELECT t AS to_entity, f AS from_entity, CAST(k AS INTEGER) AS k FROM k WHERE k <= 6")
def changed_relations_top6(spark, sf_dir):
    return graph.top_relations(key_edges(spark, sf_dir))


@query("SELECT 'customer:' || c_custkey AS to_entity, 'orders:' || o_orderkey AS from_entity FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 2 = 1")
def cross_repo_deps(spark, sf_dir):
    e = key_edges(spark, sf_dir).filter("from_entity like 'orders:%'")
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit(0).alias("repo"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_nationkey") % 2).alias("repo"))
    return graph.cross_repository(e, o.union(c), "repo").select("to_entity", "from_entity")


# History --------------------------------------------------------------------


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("committed_at"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("entity"))
    return parted(line, "sha").join(o, "sha")


_CHANGES = "c AS (SELECT DISTINCT o_orderkey AS sha, o_custkey AS author, o_orderdate AS ts, l_partkey AS entity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {_CHANGES}, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, sha DESC) AS k FROM c) SELECT entity, count(*) AS commits, count(DISTINCT author) AS authors, max(sha) FILTER (k = 1) AS newest FROM k GROUP BY entity")
def hotspots(spark, sf_dir):
    return history.hotspots(order_changes(spark, sf_dir))


def _pairs_sql(most: int) -> str:
    return f"""WITH {_CHANGES}, s AS (SELECT c.* FROM c JOIN (SELECT sha FROM c GROUP BY sha HAVING count(*) <= {most}) USING (sha)), n AS (SELECT entity, count(*) AS n FROM s GROUP BY entity),
p AS (SELECT x.entity AS a, y.entity AS b, count(*) AS together FROM s x JOIN s y ON x.sha = y.sha AND x.entity < y.entity GROUP BY ALL HAVING count(*) >= 2)
SELECT a, b, together, round(together / greatest(1, least(na.n, nb.n)), 6) AS confidence FROM p JOIN n na ON na.entity = a JOIN n nb ON nb.entity = b"""


@query(_pairs_sql(50))
def co_change_pairs(spark, sf_dir):
    return history.co_changes(order_changes(spark, sf_dir)).select("a", "b", "together", F.round("confidence", 6).alias("confidence"))


@query(_pairs_sql(5))
def co_change_pairs_small(spark, sf_dir):
    return history.co_changes(order_changes(spark, sf_dir), most=5).select("a", "b", "together", F.round("confidence", 6).alias("confidence"))


@query("SELECT o_orderkey AS sha, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS parent FROM orders")
def commit_neighbours(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.lead("o_orderkey").over(w).alias("parent"))


@query("""WITH l AS (SELECT l_partkey AS entity, l_orderkey AS sha, row_number() OVER (PARTITION BY l_partkey ORDER BY epoch_us(l_shipdate) DESC, l_orderkey, l_linenumber) AS k FROM lineitem) SELECT entity, sha FROM l WHERE k = 1""")
def entity_blame(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line"), F.col("l_orderkey").alias("sha"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t"))
    return history.entity_blame(d, "entity", "line", "sha", "t").select("entity", "sha")


@query("""WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS previous, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, event_type, previous, CASE WHEN k = 1 THEN 'added' ELSE 'modified' END AS change FROM e WHERE k = 1 OR event_type IS DISTINCT FROM previous""")
def entity_history(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return history.transitions(d, "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "previous", "change")


@query("""WITH r AS (SELECT l_orderkey, count(*) AS b, count(DISTINCT l_partkey) AS a, count(*) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY 1)
SELECT count(*) AS runs, CAST(sum(c) AS BIGINT) AS changes, CAST(sum(greatest(b, a)) AS BIGINT) AS entities, CAST(sum(greatest(greatest(b, a) - c, 0)) AS BIGINT) AS noise FROM r""")
def lifetime_stats(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("before"), F.count_distinct("l_partkey").alias("after"), F.count_if(F.col("l_returnflag") == "R").alias("changes"))
    return history.lifetime(r)


# Search, resolution and packing ----------------------------------------------


@query(rf"""WITH {_LINED}, h AS (SELECT doc_id, i AS line FROM l, unnest(range(1, len(l) + 1)) AS u(i) WHERE contains(l[i], 'MIT License'))
SELECT doc_id AS file_path, CAST(line AS BIGINT) AS line, doc_id || '::chunk::lines ' || (20 * ((line - 1) // 20) + 1) || '-' || least(20 * ((line - 1) // 20) + 20, len(l)) AS id FROM h JOIN l USING (doc_id)""")
def text_search_innermost(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter(F.col("text").contains("MIT License"))
    e = entities.spans(docs, "doc_id", "text")
    whole = docs.select(F.col("doc_id").alias("file_path"), F.col("doc_id").cast("string").alias("id"), F.lit(1).cast("long").alias("start_line"), (F.size(T.lines(F.col("text"))) + 1).cast("long").alias("end_line"))
    return search.innermost(search.text_hits(docs, "doc_id", "text", "MIT License"), e.unionByName(whole)).select("file_path", "line", "id")


@query("SELECT DISTINCT p_name AS name FROM part WHERE contains(lower(p_name), 'p') ORDER BY 1 LIMIT 5")
def near_names(spark, sf_dir):
    return search.near_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), "P")


@query(r"""WITH t AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM conversations), s AS (SELECT item_id, item_id % 100 AS conv_id, lower(regexp_extract(text, '[A-Za-z0-9_]+')) AS name FROM benchmark),
own AS (SELECT conv_id, name, min(item_id) AS id FROM s GROUP BY ALL), sole AS (SELECT name, min(item_id) AS id FROM s GROUP BY name HAVING count(DISTINCT item_id) = 1)
SELECT t.conv_id, token, coalesce(own.id, sole.id) AS target, CASE WHEN own.id IS NOT NULL THEN 'scope' ELSE 'unique' END AS rule FROM t LEFT JOIN own ON own.conv_id = t.conv_id AND own.name = token LEFT JOIN sole ON sole.name = token WHERE coalesce(own.id, sole.id) IS NOT NULL""")
def reference_resolution(spark, sf_dir):
    tokens = table(spark, sf_dir, "conversations").select("conv_id", F.explode(T.identifiers(F.lower("text"))).alias("token")).distinct()
    symbols = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 100).alias("conv_id"), F.lower(F.regexp_extract("text", "[A-Za-z0-9_]+", 0)).alias("name"), F.col("item_id").alias("id"))
    return search.resolved(tokens, symbols, "conv_id").select("conv_id", "token", "target", "rule")


_CASES = (("dist/x.js", True, False), ("src/dist/x.js", False, False), ("a/Vendor/b.go", True, False), ("lib/x.min.js", True, False), ("lib/Foo.framework/Foo", False, True), ("deep/down/go.sum", True, False), ("_next/static/chunks/b.js", True, False), ("src/main.rs", False, False), ("img/logo.PNG", False, True), ("vendor.go", False, False), ("a/b.generated.ts", True, False), ("pkg/data.tar.gz", False, True))


@query("""SELECT page_id, page_id % 12 IN (0, 2, 3, 5, 6, 10) AS excluded, page_id % 12 IN (4, 8, 11) AS is_binary FROM pages""")
def default_excludes(spark, sf_dir):
    path = F.get(F.array(*[F.lit(p) for p, *_ in _CASES]), (F.col("page_id") % len(_CASES)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", P.default_excluded(path).alias("excluded"), P.probably_binary(path).alias("is_binary"))


@query(r"""SELECT page_id, len(list_filter(string_split_regex(lower(url), '[/._-]'), lambda x: x IN ('test', 'tests', 'spec', 'specs'))) > 0 OR len(list_filter(string_split(lower(url), '/'), lambda x: x IN ('e2e', 'cypress', 'playwright', 'testing', 'fixtures', 'fixture', 'benchmarks', 'benchmark', '__tests__', '__mocks__', 'en'))) > 0 OR regexp_matches(string_split(lower(url), '/')[-1], '_test\.|\.test\.|_spec\.|\.spec\.') AS is_test FROM pages""")
def test_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.test_path(F.col("url"), ("en",)).alias("is_test"))


@query("SELECT event_type AS entity_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def kind_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(~F.col("event_type").isin("click", "view")).groupBy(F.col("event_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT conv_id, turn, CAST(greatest(len(list_filter(string_split_regex(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '')) * 13 // 10, length(text) // 4) AS BIGINT) AS tokens, string_split(text, chr(10))[1] AS signature FROM conversations")
def token_budget(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"), T.signature(F.col("text")).alias("signature"))


@query(r"""WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k, CAST(greatest(len(list_filter(string_split_regex(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '')) * 13 // 10, length(text) // 4) AS BIGINT) AS tokens,
  CAST(greatest(len(list_filter(string_split_regex(string_split(text, chr(10))[1], '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '')) * 13 // 10, length(string_split(text, chr(10))[1]) // 4) AS BIGINT) AS short_tokens FROM conversations),
p AS (SELECT conv_id, k, CASE WHEN tokens <= 150 THEN 150 - tokens WHEN short_tokens <= 150 THEN 150 - short_tokens ELSE 150 END AS room, CASE WHEN tokens <= 150 THEN 'full' WHEN short_tokens <= 150 THEN 'signature' END AS form FROM t WHERE k = 1
  UNION ALL SELECT t.conv_id, t.k, CASE WHEN tokens <= room THEN room - tokens WHEN short_tokens <= room THEN room - short_tokens ELSE room END, CASE WHEN tokens <= room THEN 'full' WHEN short_tokens <= room THEN 'signature' END FROM p JOIN t ON t.conv_id = p.conv_id AND t.k = p.k + 1)
SELECT conv_id, turn, tokens, short_tokens, form IS NOT NULL AS included, form FROM p JOIN t USING (conv_id, k)""")
def context_pack(spark, sf_dir):
    sizes = T.token_estimate(F.col("text")).alias("tokens"), T.token_estimate(T.signature(F.col("text"))).alias("short_tokens")
    return search.packed(table(spark, sf_dir, "conversations").select("conv_id", "turn", *sizes), "conv_id", "turn", "tokens", 150, "short_tokens")


@query(rf"""WITH {_LINED}, n AS (SELECT doc_id, len(l) AS n FROM l WHERE len(l) > 8) SELECT doc_id AS file_path, CAST(a AS BIGINT) AS gap_start, CAST(b AS BIGINT) AS gap_end FROM (SELECT doc_id, 1 AS a, 1 AS b FROM n UNION ALL SELECT doc_id, 5, 6 FROM n UNION ALL SELECT doc_id, 9, n FROM n)""")
def plugin_gaps(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path"), F.size(T.lines(F.col("text"))).cast("long").alias("total")).filter("total > 8")
    spans = d.select("file_path", "total", F.inline(F.array(*[F.struct(F.lit(a).cast("long").alias("start_line"), F.lit(b).cast("long").alias("end_line")) for a, b in ((2, 4), (3, 4), (7, 8))])))
    return search.gaps(spans, "file_path", "start_line", "end_line", "total")


# Incremental ------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 3 = 0")
def incremental_merge(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    delta = base.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X"))
    return incremental.merged(base, delta, "o_orderkey", base.filter("o_orderkey % 11 = 0"))


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'new' WHEN o_orderkey % 2 = 0 THEN 'fresh' WHEN o_orderkey % 3 = 0 THEN 'touched' ELSE 'stale' END AS state, count(*) AS n FROM orders GROUP BY 1")
def file_freshness(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("mtime"), F.md5(F.col("o_orderkey").cast("string")).alias("content_hash"))
    c = f.filter("path % 5 <> 0").select("path", F.when(F.col("path") % 2 == 0, F.col("mtime")).otherwise(F.col("mtime") - 1).alias("mtime"), F.when(F.col("path") % 3 == 0, F.col("content_hash")).otherwise("").alias("content_hash"))
    return incremental.freshness(f, c).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT event_id, md5(props) AS fp, lag(md5(props)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) SELECT event_id, CASE WHEN p IS NULL THEN 'first' WHEN p = fp THEN 'unchanged' ELSE 'changed' END AS reply FROM e""")
def session_ledger(spark, sf_dir):
    return incremental.ledger(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], "props").select("event_id", "reply")


from lamella.plans import snapshots as _snapshots  # noqa: E402, F401  (adds its queries)
from lamella.plans import structure as _structure  # noqa: E402, F401
from lamella.plans import scalars as _scalars  # noqa: E402, F401
from lamella.plans import feeds as _feeds  # noqa: E402, F401
from lamella.plans import projects as _projects  # noqa: E402, F401
