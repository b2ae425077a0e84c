"""What the name of a file's export means: re-exports, default exports and barrels, followed to the entity behind them.

An export statement is a pointer from (file, exported name) to another name, in
its own file or in the one it names.  Pointers are followed by doubling: a round
replaces each open pointer by its target's pointer, so a chain of ``n`` files
takes ``log2(n)`` rounds; what is still open when a round settles none
runs in a circle and is dropped.  A star export hands on any name, so it is
followed for the names that somebody asks for alone.

Defined cases: an export statement hides a symbol of its file of the same name,
in Python a symbol hides an import; of several statements for one name the first by (target
file, source) counts; a name that several stars offer is that of the fewest steps,
then of the first file; stars never hand on ``default``; circles, names that no
file has and files that don't exist give no target; null texts have no
statements; empty inputs give no rows; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.storage import cut

STATEMENT = "file_path string, exported string, candidates array<string>, source string"
_LIST = re.compile(r"\bexport[ \t]*(?:type[ \t]*)?\{([^}]*)\}(?:\s*from\s*['\"]([^'\"]+)['\"])?")
_STAR = re.compile(r"\bexport[ \t]*\*[ \t]*from\s*['\"]([^'\"]+)['\"]")
_DEFAULT = re.compile(r"\bexport[ \t]+default[ \t]+(?:(?:async[ \t]+)?function[ \t]*\*?[ \t]*|(?:abstract[ \t]+)?class[ \t]+)([A-Za-z_$][\w$]*)|\bexport[ \t]+default[ \t]+(?!function\b|class\b|async\b|new\b|abstract\b)([A-Za-z_$][\w$]*)[ \t]*(?:;|$|//|/\*)", re.M)


def renamed(one: str) -> tuple[str, str]:
    """The source and local name of a specifier such as ``type a as b``."""
    name, _, local = re.sub(r"^type\s+", "", one.strip()).partition(" as ")
    return name.strip(), (local or name).strip()


def script_exports(path: str, text: str, targets) -> list[tuple]:
    """(exported, candidate files or null for the own file, source) of a script's export statements; ``*`` for stars."""
    out = []
    for m in _LIST.finditer(text):
        where = targets(path, m[2]) if m[2] else None
        for one in filter(str.strip, m[1].split(",")):
            source, exported = renamed(one)
            if where is None or where:
                out.append((exported, where, source))
    for m in _STAR.finditer(text):
        if where := targets(path, m[1]):
            out.append(("*", where, m[1]))
    for m in _DEFAULT.finditer(text):
        out.append(("default", None, m[1] or m[2]))
    return out


def existing(rows: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """``keys`` with ``target``, the first of ``candidates`` that is a file."""
    there = files.select(F.col("file_path").alias("target")).distinct()
    each = rows.select(*keys, F.posexplode("candidates").alias("_i", "target"))
    return each.join(there, "target", "left_semi").groupBy(*keys).agg(F.min_by("target", "_i").alias("target"))


def pointers(statements: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """``file_path, name, to_file, to_name, target``: one step of every exported name; ``target`` where the step ends at a symbol.

    ``symbols`` has one ``target`` for each (``file_path``, ``name``), ``imports``
    the import table.
    """
    far = existing(statements.filter("candidates is not null"), files, "file_path", "exported", "source").select("file_path", F.col("exported").alias("name"), F.col("target").alias("to_file"), F.col("source").alias("to_name"))
    far = cut(far, "statements")
    own = statements.filter("candidates is null").select("file_path", F.col("exported").alias("name"), F.col("source").alias("local"))
    at_home = own.join(symbols.select("file_path", F.col("name").alias("local"), "target"), ["file_path", "local"], "left")
    here = at_home.filter("target is not null").select("file_path", "name", F.col("file_path").alias("to_file"), F.col("local").alias("to_name"), "target")
    named = imports.filter("name is not null").select("file_path", "local", F.col("target").alias("to_file"), F.col("name").alias("to_name"))
    passed = at_home.filter("target is null").drop("target").join(named, ["file_path", "local"]).select("file_path", "name", "to_file", "to_name")
    python = named.filter("file_path rlike '[.]pyi?$'").withColumnRenamed("local", "name").join(symbols.select("file_path", "name"), ["file_path", "name"], "left_anti").select("file_path", "name", "to_file", "to_name")
    step = far.filter("name <> '*'").union(passed).union(python).filter("file_path <> to_file or name <> to_name").withColumn("target", F.lit(None).cast("string")).union(here)
    first = F.struct(F.col("target").isNull(), "to_file", "to_name")
    step = cut(step.groupBy("file_path", "name").agg(F.min_by(F.struct("to_file", "to_name", "target"), first).alias("x")).select("file_path", "name", "x.*"), "pointers")
    asked = step.filter("target is null").select(F.col("to_file").alias("file_path"), F.col("to_name").alias("name")).union(named.select(F.col("to_file"), F.col("to_name")))
    stars = far.filter("name = '*'").select("file_path", "to_file").filter("file_path <> to_file").distinct()
    step = step.union(_starred(asked, stars, step, symbols))
    aliases = step.select(F.col("file_path").alias("to_file"), F.col("name").alias("to_name"), F.lit(True).alias("more"))
    ends = symbols.select(F.col("file_path").alias("to_file"), F.col("name").alias("to_name"), F.col("target").alias("end"))
    step = step.join(aliases, ["to_file", "to_name"], "left").join(ends, ["to_file", "to_name"], "left")
    return cut(step.select("file_path", "name", "to_file", "to_name", F.coalesce("target", F.when(F.col("more").isNull(), F.col("end"))).alias("target")), "pointers")


def _starred(asked: DataFrame, stars: DataFrame, step: DataFrame, symbols: DataFrame) -> DataFrame:
    """Pointers of asked names that a file has by its star exports alone."""
    has = step.select("file_path", "name").union(symbols.select("file_path", "name")).distinct()
    none = step.limit(0)
    if stars.isEmpty():
        return none
    open_ = asked.filter("name <> 'default'").distinct().join(has, ["file_path", "name"], "left_anti").join(stars.select("file_path").distinct(), "file_path", "left_semi")
    front = cut(open_.select("file_path", "name", F.col("file_path").alias("at")), "stars")
    seen, found, round_ = front, None, 0
    while not front.isEmpty():
        round_ += 1
        new = front.join(stars.select(F.col("file_path").alias("at"), F.col("to_file").alias("next")), "at").select("file_path", "name", F.col("next").alias("at")).distinct().join(seen, ["file_path", "name", "at"], "left_anti")
        new = new.join(has.select(F.col("file_path").alias("at"), "name", F.lit(True).alias("hit")), ["at", "name"], "left")
        new = cut(new.select("file_path", "name", "at", "hit", F.lit(round_).alias("steps")), "stars")
        hits = new.filter("hit").select("file_path", "name", "at", "steps")
        found = hits if found is None else found.union(hits)
        front = new.filter("hit is null").select("file_path", "name", "at")
        seen = seen.union(front)
    if found is None:
        return none
    best = found.groupBy("file_path", "name").agg(F.min_by("at", F.struct("steps", "at")).alias("to_file"))
    return best.select("file_path", "name", "to_file", F.col("name").alias("to_name"), F.lit(None).cast("string").alias("target"))


def settled(step: DataFrame) -> DataFrame:
    """``file_path, name, target`` of all pointers that end at an entity, from :func:`pointers`."""
    done, open_ = [step.filter("target is not null")], step.filter("target is null")
    left, before = open_.count(), None
    # On a way that ends there are pointers at every distance, so a round that settles and drops none leaves circles alone.
    while left and left != before:
        known = open_
        for d in done:
            known = known.union(d)
        at = known.select(F.col("file_path").alias("to_file"), F.col("name").alias("to_name"), F.col("to_file").alias("_file"), F.col("to_name").alias("_name"), "target")
        moved = cut(open_.drop("target").join(at, ["to_file", "to_name"]).select("file_path", "name", F.col("_file").alias("to_file"), F.col("_name").alias("to_name"), "target"), "pointers")
        done.append(moved.filter("target is not null"))
        open_ = moved.filter("target is null")
        left, before = open_.count(), left
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("file_path", "name", "target")


def offered(step: DataFrame, symbols: DataFrame) -> DataFrame:
    """``file_path, name, target`` of everything that can be imported by name: settled pointers, and symbols that no pointer hides."""
    hidden = step.select("file_path", "name")
    return settled(step).union(symbols.select("file_path", "name", "target").join(hidden, ["file_path", "name"], "left_anti"))

