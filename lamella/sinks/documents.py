"""Results as JSON documents and as text.

One row a document: these are for results that a reader looks at.  Rows that go
into a document pass one task; write the rows themselves with
``df.write.json`` where they are many.  Nulls become JSON nulls; empty inputs
give a document with zero counts; ties are ordered by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.operators import diff
from lamella.storage import cut

#: Change columns and their names in the document.
NAMES = {"entity_id": "entityId", "change_type": "changeType", "entity_type": "entityType", "entity_name": "entityName", "entity_line": "entityLine", "start_line": "startLine", "end_line": "endLine", "old_start_line": "oldStartLine", "old_end_line": "oldEndLine", "parent_name": "parentName", "file_path": "filePath", "old_entity_name": "oldEntityName", "old_file_path": "oldFilePath", "old_parent_id": "oldParentId", "before_content": "beforeContent", "after_content": "afterContent", "structural_change": "structuralChange"}
_KEEP = {"ignoreNullFields": "false"}


def diff_json(rows: DataFrame, binaries: DataFrame | None = None) -> DataFrame:
    """``json``: summary, changes in order of file and line, and binary files (``file_path, change_type``).

    Files and total of the summary count binary files too.
    """
    rows = rows.withColumn("content_changed", F.coalesce(F.col("before_content") != F.col("after_content"), F.lit(False)))
    has = set(rows.columns)
    one = F.struct("file_path", "entity_line", "entity_id", F.struct(*[(F.col(c) if c in has else F.lit(None).cast("string")).alias(n) for c, n in NAMES.items()]).alias("row"))
    body = rows.agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["row"]).alias("changes"))
    if binaries is None:
        extra = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<filePath:string,changeType:string>>").alias("binaryChanges"))
    else:
        extra = binaries.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.col("file_path").alias("filePath"), F.col("change_type").alias("changeType")))).alias("binaryChanges"))
    s = diff.summary(rows)
    orphans = rows.agg(F.count_if(F.col("entity_type") == "orphan").alias("orphan"))
    summary = F.struct((F.col("file_count") + F.col("n")).alias("fileCount"), "added", "modified", "deleted", "moved", "renamed", "reordered", F.col("n").alias("binary"), "orphan", (F.col("total") + F.col("n")).alias("total"))
    return s.crossJoin(orphans).crossJoin(extra).crossJoin(body).select(F.to_json(F.struct(summary.alias("summary"), "changes", "binaryChanges"), _KEEP).alias("json"))


def diff_json_lines(rows: DataFrame) -> DataFrame:
    """The document of :func:`diff_json` without binary files as ``part, file_path, entity_line, entity_id, text`` lines, which no task holds as a whole.

    In the order of the first four columns the texts are the document: its summary (part 0), a change a
    line (part 1; all but the first begin with a comma) and its end (part 2).
    """
    rows = rows.withColumn("content_changed", F.coalesce(F.col("before_content") != F.col("after_content"), F.lit(False)))
    has, at = set(rows.columns), ("file_path", "entity_line", "entity_id")
    s = diff.summary(rows).crossJoin(rows.agg(F.count_if(F.col("entity_type") == "orphan").alias("orphan"), F.min(F.struct(*at)).alias("first")))
    s = cut(s, "summary")
    summary = F.struct(F.col("file_count").alias("fileCount"), "added", "modified", "deleted", "moved", "renamed", "reordered", F.lit(0).alias("binary"), "orphan", "total")
    head = s.select(F.lit(0).alias("part"), *[F.col(f"first.{c}").alias(c) for c in at], F.concat(F.lit('{"summary":'), F.to_json(summary, _KEEP), F.lit(',"changes":[')).alias("text"))
    one = F.to_json(F.struct(*[(F.col(c) if c in has else F.lit(None).cast("string")).alias(n) for c, n in NAMES.items()]), _KEEP)
    comma = F.when(F.struct(*at).eqNullSafe(F.col("first")), F.lit("")).otherwise(F.lit(","))
    body = rows.crossJoin(F.broadcast(s.select("first"))).select(F.lit(1).alias("part"), *at, F.concat(comma, one).alias("text"))
    end = s.select(F.lit(2).alias("part"), *[F.col(f"first.{c}").alias(c) for c in at], F.lit('],"binaryChanges":[]}').alias("text"))
    return head.union(body).union(end)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``json``: entities by id, edges by (from, to, type), and their counts."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "name", F.col("entity_type").alias("type"), F.col("file_path").alias("file"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")))).alias("entities"), F.count(F.lit(1)).alias("entityCount"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("from_entity").alias("from"), F.col("to_entity").alias("to"), F.col("ref_type").alias("type")))).alias("edges"), F.count(F.lit(1)).alias("edgeCount"))
    return n.crossJoin(e).select(F.to_json(F.struct("entities", "edges", F.struct("entityCount", "edgeCount").alias("stats")), _KEEP).alias("json"))


def entities_json(entities: DataFrame, with_file: bool = True) -> DataFrame:
    """``json`` of an entity listing by (file, line, id)."""
    shown = ["name", F.col("entity_type").alias("type"), "start_line", "end_line", "parent_id", *([F.col("file_path").alias("file")] if with_file else [])]
    one = F.struct("file_path", "start_line", "id", F.struct(*shown).alias("row"))
    return entities.agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["row"]), _KEEP).alias("json"))


SIGNS = {"added": "+", "deleted": "-", "modified": "~", "moved": ">", "renamed": "r", "reordered": "o"}


def _sign() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv]), F.col("change_type"))


def plain_lines(rows: DataFrame) -> DataFrame:
    """``file_path, line, text``: one line a change, ``<sign> <type> <name>``, with the former name or file where it differs."""
    was = F.coalesce(F.concat(F.lit(" (from "), F.coalesce("old_entity_name", "old_file_path"), F.lit(")")), F.lit(""))
    return rows.select("file_path", F.col("entity_line").alias("line"), F.concat(_sign(), F.lit(" "), "entity_type", F.lit(" "), "entity_name", was).alias("text"))


def fence(content: Column) -> Column:
    """Backticks for a block around ``content``: three, or one more than its longest run."""
    runs = F.transform(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit("`+"), 0), lambda x: F.length(x))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def markdown(rows: DataFrame) -> DataFrame:
    """``file_path, markdown``: a heading a file and a fenced block of removed and added lines a change."""
    lines = lambda c, sign: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), lambda x: F.concat(F.lit(sign), x))
    side = lambda c, sign: F.when(F.col(c).isNotNull(), lines(c, sign)).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat(side("before_content", "-"), side("after_content", "+")), "\n")
    mark = fence(body)
    block = F.when(F.length(body) > 0, F.concat(F.lit("\n"), mark, F.lit("diff\n"), body, F.lit("\n"), mark)).otherwise(F.lit(""))
    one = F.struct("entity_line", "entity_id", F.concat(F.lit("- "), _sign(), F.lit(" `"), "entity_name", F.lit("` ("), "entity_type", F.lit(")"), block).alias("t"))
    g = rows.groupBy("file_path").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return g.select("file_path", F.concat(F.lit("### "), "file_path", F.lit("\n\n"), F.array_join(F.transform("all", lambda x: x["t"]), "\n")).alias("markdown"))


def save_sqlite(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Write small results to one SQLite file for local readers, a partition at a time; rows written by table."""
    import sqlite3

    out = {}
    with sqlite3.connect(path) as db:
        for name, df in tables.items():
            kinds = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL"}
            columns = ", ".join(f'"{f.name}" {kinds.get(f.dataType.simpleString(), "TEXT")}' for f in df.schema)
            db.execute(f'DROP TABLE IF EXISTS "{name}"')
            db.execute(f'CREATE TABLE "{name}" ({columns})')
            put = f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(df.columns))})'
            n = 0
            for row in df.toLocalIterator():
                db.execute(put, tuple(row))
                n += 1
            out[name] = n
    return out


def impact_line(node: str, parts: dict[str, DataFrame]) -> DataFrame:
    """``text``: an impact's size in one line."""
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    sizes = n(parts["dependents"], "a").crossJoin(n(parts["impact"], "b")).crossJoin(n(parts["tests"], "c"))
    return sizes.select(F.format_string("%s: %d direct, %d in all, %d tests", F.lit(node), "a", "b", "c").alias("text"))


def impact_text(parts: dict[str, DataFrame]) -> DataFrame:
    """``depth, text``: an impact's entities, one line each, nearest first."""
    mark = F.when(F.col("is_test"), " [test]").otherwise("")
    return parts["impact"].select("depth", F.concat("entity_type", F.lit(" "), "name", F.lit(" ("), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit(")"), mark).alias("text")).orderBy("depth", "text")


def terminal_lines(rows: DataFrame) -> DataFrame:
    """:func:`plain_lines` with the colours of a terminal."""
    colour = F.when(F.col("text").startswith("+"), "32").when(F.col("text").startswith("-"), "31").otherwise("33")
    return plain_lines(rows).withColumn("text", F.concat(F.lit("\x1b["), colour, F.lit("m"), "text", F.lit("\x1b[0m")))
