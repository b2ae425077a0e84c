"""Entities followed over all versions of their files, through renames and moves.

The versions of a project are sparse: a version names the files that it touched
and holds the entities of those files alone.  An entity's predecessor is looked for
among what the touched files held before: by name in its own file, by name in the
other touched files, then by structural hash in the same order.  Every step is an equi
join with one candidate a key, so a name that very many entities bear
costs no pairs.  Predecessors are pointers; following them by doubling gives
every occurrence the first one of its line in as many rounds as the longest line's
length has binary digits.

Defined cases: null names and hashes match nothing; of several candidates the first
by (file, line, id) counts; an entity that two later ones come from begins both their
lines, which then share their first occurrence; a file that a version touches and
holds no entities of was deleted or emptied; a version's order number is its
``version``; of rows that repeat (version, id) the first by (file, line) counts; empty inputs give no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.storage import cut, drop, parted, shuffles

FIELDS = ("id", "file_path", "name", "parent_id", "content_hash", "structural_hash", "start_line")


def predecessors(entities: DataFrame, touched: DataFrame) -> DataFrame:
    """``version, was, b, a``: each entity of a version with the one it comes from (null where it is new), and ones that nothing comes from (``a`` null).

    ``entities`` has ``version`` and :data:`FIELDS`, ``touched`` (``version, file_path``) the files of each version.
    """
    files = touched.select("version", "file_path").distinct()
    files = cut(files.withColumn("was", F.lag("version").over(W.partitionBy("file_path").orderBy("version"))), "touched")
    at = F.struct("file_path", "start_line")
    rows = cut(entities.select("version", *FIELDS), "entities")
    n = rows.count()
    rows = parted(rows, "version", "id", rows=n).groupBy("version", "id").agg(F.min_by(F.struct(*FIELDS), at).alias("x"))
    rows = cut(rows.select("version", F.col("x.file_path").alias("file_path"), "x"), "entities")
    with shuffles(entities.sparkSession, n):
        return _predecessors(rows, files)


def _predecessors(rows: DataFrame, files: DataFrame) -> DataFrame:
    now = cut(rows.join(files.select("version", "file_path"), ["version", "file_path"], "left_semi").select("version", F.col("x").alias("a")), "now")
    past = files.filter("was is not null").select("version", F.col("was").alias("_was"), "file_path")
    before = rows.withColumnRenamed("version", "_was").join(past, ["_was", "file_path"]).select("version", F.col("_was").alias("was"), F.col("x").alias("b"))
    before = cut(before, "before")
    n = before.count()
    first = F.struct("b.file_path", "b.start_line", "b.id")
    left, found, made = now, None, []
    for keys in (("file_path", "name"), ("name",), ("file_path", "structural_hash"), ("structural_hash",)):
        known = parted(before.filter(F.col(f"b.{keys[-1]}").isNotNull()), "version", "b.id", rows=n)
        best = known.groupBy("version", *[F.col(f"b.{k}").alias(k) for k in keys]).agg(F.min_by(F.struct("was", "b"), first).alias("best"))
        with_keys = left.select("version", "a", *[F.col(f"a.{k}").alias(k) for k in keys])
        tried = cut(with_keys.join(best, ["version", *keys], "left").select("version", "best.was", "best.b", "a"), "tried")
        made.append(tried)
        hit = tried.filter("b is not null")
        found = hit if found is None else found.union(hit)
        left = tried.filter("b is null").select("version", "a")
    none = F.lit(None).cast(before.schema["b"].dataType)
    rows = cut(found.union(left.select("version", F.lit(None).cast("long").alias("was"), none.alias("b"), "a")), "links")
    drop(*made)
    used = rows.filter("b is not null").select("version", "was", F.col("b.id").alias("_id"))
    gone = before.withColumn("_id", F.col("b.id")).join(used, ["version", "was", "_id"], "left_anti").select("version", "was", "b", none.alias("a"))
    return rows.union(cut(gone, "gone"))


def firsts(links: DataFrame) -> DataFrame:
    """``version, id, first_version, first_id`` of every occurrence, from :func:`predecessors`, by doubling."""
    with shuffles(links.sparkSession, links.count()):
        return _firsts(links)


def _firsts(links: DataFrame) -> DataFrame:
    step = links.filter("a is not null").select("version", F.col("a.id").alias("id"), F.col("was").alias("to_version"), F.col("b.id").alias("to_id"))
    open_ = F.col("to_id").isNotNull()
    step = cut(step.select("version", "id", F.when(open_, F.col("to_version")).otherwise(F.col("version")).alias("to_version"), F.when(open_, F.col("to_id")).otherwise(F.col("id")).alias("to_id"), open_.alias("open")), "lines")
    while not step.filter("open").isEmpty():
        far = step.select(F.col("version").alias("to_version"), F.col("id").alias("to_id"), F.col("to_version").alias("v2"), F.col("to_id").alias("i2"), F.col("open").alias("o2"))
        more = step.filter("open").drop("open").join(far, ["to_version", "to_id"], "left")
        more = more.select("version", "id", F.coalesce("v2", "to_version"), F.coalesce("i2", "to_id"), F.coalesce("o2", F.lit(False)))
        grown = cut(step.filter("not open").union(more), "lines")
        drop(step)
        step = grown
    return step.select("version", "id", F.col("to_version").alias("first_version"), F.col("to_id").alias("first_id"))


def change() -> Column:
    """``added``, ``deleted``, ``moved``, ``renamed``, ``modified`` or null for a row of :func:`predecessors`."""
    differs = lambda f: ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    both = F.when(differs("file_path") | differs("parent_id"), "moved").when(differs("name"), "renamed").when(differs("content_hash"), "modified")
    return F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").otherwise(both)


def histories(entities: DataFrame, touched: DataFrame) -> DataFrame:
    """One row a change: ``first_version, first_id`` (the line), ``version, id, old_id, change, logic``.

    ``logic`` says of a modification whether the structure changed, too.
    """
    links = cut(predecessors(entities, touched), "links")
    lines = firsts(links)
    own = F.coalesce(F.col("a.id"), F.col("b.id"))
    at = F.when(F.col("a").isNull(), F.col("was")).otherwise(F.col("version"))
    rows = links.select("version", at.alias("_at"), own.alias("id"), F.col("b.id").alias("old_id"), change().alias("change"), (~F.col("a.structural_hash").eqNullSafe(F.col("b.structural_hash"))).alias("_other"))
    rows = rows.filter("change is not null").withColumn("logic", (F.col("change") == "modified") & F.col("_other"))
    known = lines.withColumnRenamed("version", "_at")
    with shuffles(links.sparkSession, links.count()):
        return cut(rows.join(known, ["_at", "id"]).select("first_version", "first_id", "version", "id", "old_id", "change", "logic"), "changes")


def history_of(entities: DataFrame, touched: DataFrame, node: str) -> DataFrame:
    """The changes of the lines that an entity of this id ever stood in, oldest first."""
    rows = cut(histories(entities, touched), "histories")
    own = rows.filter(F.col("id") == node).select("first_version", "first_id").distinct()
    return rows.join(own, ["first_version", "first_id"], "left_semi").orderBy("version", "id")
