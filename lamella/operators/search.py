"""Text search, range joins between lines and entities, and reference resolution by name.

Defined cases: null texts hold nothing; a line that several entities of one size
hold goes to the first by line and id; entities of very many lines are entered
under each of their line buckets; repeated hits count once; empty inputs give no
rows; a group's sorted rows are packed in their own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.functions import text as T


def text_hits(files: DataFrame, path: str, content: str, needle: str) -> DataFrame:
    """``file_path, line`` of every line that holds ``needle``; a plain filter inside each row."""
    ls = F.transform(T.lines(F.coalesce(F.col(content), F.lit(""))), lambda x, i: F.struct((i + 1).cast("long").alias("line"), x.alias("t")))
    hit = F.filter(ls, lambda x: x["t"].contains(needle))
    return files.select(F.col(path).alias("file_path"), F.explode(hit).alias("_h")).select("file_path", "_h.line")


def first_hits(files: DataFrame, path: str, content: str, needle: str, most: int = 10) -> DataFrame:
    """The first hits by (file, line), 1 to 100 of them."""
    return text_hits(files, path, content, needle).orderBy("file_path", "line").limit(min(100, max(1, most)))


def lookup(nodes: DataFrame, query: str, file_path: str | None = None) -> DataFrame:
    """``status`` and the entities that a query means, by (file, line, id): ``found``, ``ambiguous``, ``not in file`` or ``not found``."""
    parents = nodes.select(F.col("id").alias("_up"), F.col("name").alias("_up_name"))
    named = nodes.join(parents, F.col("parent_id") == F.col("_up"), "left")
    hits = named.filter(matches_query(query, F.col("name"), F.col("entity_type"), F.col("_up_name")) | (F.col("id") == query)).select(*nodes.columns)
    here = hits if file_path is None else hits.filter(F.col("file_path") == file_path)
    n = here.agg(F.count(F.lit(1)).alias("n")).crossJoin(hits.agg(F.count(F.lit(1)).alias("anywhere")))
    status = F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").when(F.col("anywhere") > 0, "not in file").otherwise("not found")
    return n.select(status.alias("status")).join(here, F.lit(True), "left").orderBy("file_path", "start_line", "id")


def innermost(points: DataFrame, entities: DataFrame, span: int = 64) -> DataFrame:
    """Each point (``file_path, line``) with the smallest entity around it.

    The range join is an equi join on (file, line bucket): an entity is entered
    under every bucket of ``span`` lines that it touches, a point under one.
    """
    e = entities.select("file_path", "id", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / span), F.floor(F.col("end_line") / span))).alias("_b"))
    p = points.withColumn("_b", F.floor(F.col("line") / span))
    j = p.join(e, ["file_path", "_b"]).filter("line between start_line and end_line")
    return j.groupBy("file_path", "line").agg(F.min_by(F.struct("id", "start_line", "end_line"), F.struct(F.col("end_line") - F.col("start_line"), "start_line", "id")).alias("_e")).select("file_path", "line", "_e.*")


def reconstructed(entities: DataFrame, files: DataFrame) -> DataFrame:
    """``entities`` with ``content`` cut from their files' (``file_path, content``) lines again."""
    text = files.select(F.col("file_path").alias("_file"), F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n").alias("_lines"))
    j = entities.drop("content").join(text, F.col("file_path") == F.col("_file"), "left")
    part = F.slice("_lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))
    return j.withColumn("content", F.array_join(part, "\n")).drop("_file", "_lines")


def near_names(nodes: DataFrame, query: str, most: int = 5) -> DataFrame:
    """The first distinct names that hold ``query``, any case."""
    return nodes.filter(F.lower("name").contains(query.lower())).select("name").distinct().orderBy("name").limit(most)


def matches_query(query: str, name: Column, kind: Column, parent: Column) -> Column:
    """``name``, ``kind name``, ``Parent.child`` or ``Parent::child``."""
    out = name == query
    if " " in query:
        k, _, n = query.partition(" ")
        out = out | ((kind == k) & (name == n))
    for mark in ("::", "."):
        if mark in query:
            p, _, n = query.rpartition(mark)
            out = out | ((parent == p) & (name == n))
    return out


def resolved(tokens: DataFrame, symbols: DataFrame, scope: str) -> DataFrame:
    """Tokens (``scope``, ``token``) to the first symbol of that name in their scope, else to the only one anywhere; ``rule`` says which."""
    own = symbols.select(F.col(scope), F.col("name").alias("token"), F.col("id").alias("local"))
    own = own.groupBy(scope, "token").agg(F.min("local").alias("local"))
    only = symbols.groupBy(F.col("name").alias("token")).agg(F.min("id").alias("only"), F.count_distinct("id").alias("_n")).filter("_n = 1").drop("_n")
    j = tokens.join(own, [scope, "token"], "left").join(only, "token", "left")
    return j.withColumn("target", F.coalesce("local", "only")).filter("target is not null").withColumn("rule", F.when(F.col("local").isNotNull(), "scope").otherwise("unique"))


def gaps(spans: DataFrame, key: str, start: str, end: str, total: str) -> DataFrame:
    """Line runs of 1..``total`` that no span covers, from the running maximum of ends."""
    w = W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    d = spans.withColumn("_to", F.coalesce(F.max(end).over(w), F.lit(0)))
    inner = d.filter(F.col(start) > F.col("_to") + 1).select(key, (F.col("_to") + 1).alias("gap_start"), (F.col(start) - 1).alias("gap_end"))
    last = spans.groupBy(key).agg(F.max(end).alias("_e"), F.max(total).alias("_t")).filter("_e < _t").select(key, (F.col("_e") + 1).alias("gap_start"), F.col("_t").alias("gap_end"))
    return inner.union(last)


def packed(rows: DataFrame, group: str, order: str, tokens: str, budget: int, short: str | None = None) -> DataFrame:
    """Greedy packing under a token budget in order, leaving out what doesn't fit and going on.

    With ``short``, the tokens of a row's signature, a row whose full text doesn't
    fit goes in by its signature if that fits; ``form`` says which, null if neither.
    One pass over a group's sorted rows (order and token counts alone), which is
    a group's result itself; ties of the order go by token count; null counts never fit.
    """
    names = [order, tokens, *([short] if short else [])]
    r = rows.select(F.col(group).alias("g"), F.struct(*[F.col(c) for c in names]).alias("x")).groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    kinds = {f.name: f.dataType for f in rows.schema}
    empty = F.struct(F.lit(budget).cast("long").alias("room"), F.array().cast("array<int>").alias("forms"))

    def step(acc, x):
        full = F.coalesce(x[tokens] <= acc["room"], F.lit(False))
        brief = F.coalesce(x[short] <= acc["room"], F.lit(False)) if short else F.lit(False)
        form = F.when(full, 2).when(brief, 1).otherwise(0)
        taken = F.when(full, x[tokens]).when(brief, x[short] if short else F.lit(0)).otherwise(F.lit(0))
        return F.struct((acc["room"] - taken).cast("long").alias("room"), F.concat(acc["forms"], F.array(form)).alias("forms"))

    forms = F.aggregate("xs", empty, step)["forms"]
    one = r.select("g", F.inline(F.arrays_zip(F.col("xs").alias("x"), forms.alias("f")))).toDF("g", "x", "f")
    out = [F.col("g").cast(kinds[group]).alias(group), *[F.col(f"x.{c}").alias(c) for c in names], (F.col("f") > 0).alias("included")]
    return one.select(*out, *([F.when(F.col("f") == 2, "full").when(F.col("f") == 1, "signature").alias("form")] if short else []))
