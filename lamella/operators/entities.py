"""Entities from structured text, one row in and many out, in DataFrame expressions.

Defined cases: null and empty texts have no entities; null cells are empty in a
row's content; text that isn't JSON has no members; repeated rows give their
entities each; ties of :func:`disambiguated` go by the order given; an empty
table gives no rows; other columns are ignored where a path and a text are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.functions import text as T

CHUNK = 20


def chunks(files: DataFrame, path: str, content: str, size: int = CHUNK) -> DataFrame:
    """Every ``size`` lines as an entity ``lines a-b``; nothing is shuffled, a file's lines stay in its row."""
    ls = T.lines(F.col(content))
    d = files.select(F.col(path).alias("file_path"), ls.alias("_l")).filter(F.size("_l") > 0)
    d = d.select("file_path", "_l", F.explode(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / size).cast("int"))).alias("_k"))
    start, end = F.col("_k") * size + 1, F.least((F.col("_k") + 1) * size, F.size("_l"))
    body = F.array_join(F.slice("_l", start.cast("int"), size), "\n")
    name = F.concat(F.lit("lines "), start.cast("string"), F.lit("-"), end.cast("string"))
    d = d.select("file_path", F.lit("chunk").alias("entity_type"), name.alias("name"), start.cast("long").alias("start_line"), end.cast("long").alias("end_line"), body.alias("content"))
    return d.withColumns({"id": T.entity_id(F.col("file_path").cast("string"), F.col("entity_type"), F.col("name")), "content_hash": F.md5("content")})


def spans(files: DataFrame, path: str, content: str, size: int = CHUNK) -> DataFrame:
    """``file_path, id, start_line, end_line`` of :func:`chunks`, without their texts."""
    n = F.size(T.lines(F.col(content)))
    d = files.select(F.col(path).alias("file_path"), n.alias("n")).filter("n > 0")
    d = d.select("file_path", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"), F.lit(size).cast("long"))).alias("start_line"))
    d = d.withColumn("end_line", F.least(F.col("start_line") + size - 1, F.col("n").cast("long")))
    name = F.concat(F.lit("lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return d.select("file_path", T.entity_id(F.col("file_path").cast("string"), F.lit("chunk"), name).alias("id"), "start_line", "end_line")


def row_entities(table: DataFrame, path: str, key: str) -> DataFrame:
    """A table's rows as entities ``row[<key>]`` with a map from column to cell."""
    cells = [c for x in table.columns for c in (F.lit(x), F.col(x).cast("string"))]
    name = F.concat(F.lit("row["), F.col(key).cast("string"), F.lit("]"))
    return table.select(F.concat_ws("::", F.lit(path), F.lit("row"), name).alias("id"), F.lit(path).alias("file_path"), F.lit("row").alias("entity_type"), name.alias("name"), F.create_map(*cells).alias("metadata"), F.concat_ws(",", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in table.columns]).alias("content"))


def json_properties(rows: DataFrame, path: str, doc: str) -> DataFrame:
    """Top-level members of a JSON object as ``property`` entities with RFC 6901 pointers; each document is parsed once."""
    d = rows.select(F.col(path).alias("file_path"), F.explode(F.from_json(doc, "map<string,string>")).alias("key", "value"))
    pointer = F.concat(F.lit("/"), F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    return d.select("file_path", F.concat(F.col("file_path").cast("string"), F.lit("::"), pointer).alias("id"), F.lit("property").alias("entity_type"), "key", "value", F.md5("value").alias("structural_hash"))


def headings(files: DataFrame, path: str, content: str) -> DataFrame:
    """Markdown ATX headings with the nearest heading of a lower level as parent.

    One pass over a file's headings keeps the latest one of each of the six
    levels; a second one from the end keeps where the next of each level begins.
    """
    ls = F.transform(T.lines(F.col(content)), lambda x, i: F.struct((i + 1).alias("line"), F.length(F.regexp_extract(x, r"^(#{1,6})\s+\S", 1)).alias("level"), F.regexp_extract(x, r"^#{1,6}\s+(.+?)\s*$", 1).alias("title")))
    found = F.filter(ls, lambda x: x["level"] > 0)
    d = files.select(F.col(path).alias("file_path"), found.alias("_h"), F.size(ls).alias("_n"))
    d = d.select("file_path", "_n", F.posexplode("_h").alias("_i", "_x")).select("file_path", "_n", "_i", "_x.*")
    own = W.partitionBy("file_path").orderBy("_i")
    before, after = own.rowsBetween(W.unboundedPreceding, -1), own.rowsBetween(1, W.unboundedFollowing)
    at = lambda low, high, w, pick: pick(F.when(F.col("level").between(low, high), F.struct("line", "title", "level"))).over(w)
    d = d.withColumns({f"_p{k}": at(k, k, before, F.max) for k in range(1, 7)} | {f"_n{k}": at(1, k, after, F.min) for k in range(1, 7)})
    level = lambda name, k: F.col(f"_{name}{k}")
    lower = lambda k: F.greatest(*[level("p", j) for j in range(1, k)]) if k > 2 else level("p", 1) if k == 2 else F.lit(None)
    parent, ends = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k in range(1, 7):
        up = lower(k)
        parent = F.when(F.col("level") == k, up["title"] if k > 1 else F.lit(None).cast("string")).otherwise(parent)
        ends = F.when(F.col("level") == k, level("n", k)["line"] - 1).otherwise(ends)
    return d.select("file_path", F.col("title").alias("name"), "level", F.col("line").alias("start_line"), F.coalesce(ends, F.col("_n")).alias("end_line"), parent.alias("parent_name"))


def tags(pages: DataFrame, path: str, html: str) -> DataFrame:
    """Opening tags of markup by name, with counts."""
    t = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit("<([a-z][a-z0-9]*)"), 1)
    return pages.select(F.col(path).alias("file_path"), F.explode(t).alias("tag")).groupBy("file_path", "tag").agg(F.count(F.lit(1)).alias("n"))


def disambiguated(entities: DataFrame, id_col: str = "id", line: str = "start_line", order: list[str | Column] | None = None) -> DataFrame:
    """Ids used more than once get ``@L<line>``, and on the same line ``#<ordinal>`` after the first."""
    w, v = W.partitionBy(id_col), W.partitionBy(id_col, line)
    k = F.row_number().over(v.orderBy(*(order or [line])))
    new = F.when(F.count(F.lit(1)).over(w) == 1, F.col(id_col)).otherwise(F.concat(F.col(id_col), F.lit("@L"), F.col(line).cast("string"), F.when(k > 1, F.concat(F.lit("#"), k.cast("string"))).otherwise("")))
    return entities.withColumn("unique_id", new)
