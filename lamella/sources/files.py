"""Files of a folder as rows.

The listing and the contents come from Spark's own file reader, so any store
that Spark reads will do; ignore rules, default exclusions, hidden and binary
files are filters over the path, and contents are read for what is left.

Defined cases: an empty folder gives no rows; a file that isn't UTF-8 or holds a
NUL counts as binary and is left out; line ends of any kind become line feeds;
rows are ordered by path; of ignore rules the last one that matches counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import pieces
from lamella.functions import predicates as P
from lamella.operators import extract


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """Lines of an ignore file as (regular expression over a relative path, whether it ignores)."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        spec = line[1:] if keep else line
        folder = spec.endswith("/")
        spec = spec.rstrip("/")
        rooted = "/" in spec
        body = P.glob_regex(spec.lstrip("/"))[1:-1]
        body = re.sub(r"\(\?:/\.\*\)\?$", "", body)
        out.append(("^" + ("" if rooted else "(?:.*/)?") + body + ("/.*" if folder else "(?:/.*)?") + "$", not keep))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for rule, yes in rules:
        out = F.when(path.rlike(rule), F.lit(yes)).otherwise(out)
    return out


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``file_path`` below ``root``, ``mtime`` in microseconds, ``size`` and ``raw`` content of every file."""
    root = root.rstrip("/")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = re.sub(r"^file:/*", "/", root)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(plain) + "/", "")
    return d.select(relative.alias("file_path"), F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("content").alias("raw"))


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), default_excludes: bool = True, rules: list[tuple[str, bool]] | None = None, under: str = "") -> DataFrame:
    """``file_path, mtime, size, content`` of the text files that rules and exclusions leave, ``under`` a folder of ``root``."""
    path = F.col("file_path")
    keep = ~path.rlike(r"(^|/)\.[^/]") & ~P.probably_binary(path)
    if default_excludes:
        keep = keep & ~P.default_excluded(path)
    if rules:
        keep = keep & ~ignored(path, rules)
    if extensions:
        suffix = F.lit(False)
        for x in extensions:
            suffix = suffix | path.endswith(x if x.startswith(".") else f".{x}")
        keep = keep & suffix
    if under:
        keep = keep & path.startswith(under.rstrip("/") + "/")
    d = listing(spark, root).filter(keep).filter(~pieces.binary_content(F.col("raw")))
    return d.select("file_path", "mtime", "size", F.regexp_replace(F.col("raw").cast("string"), "\r\n?", "\n").alias("content")).orderBy("file_path")


def entities(spark: SparkSession, root: str, brief: bool = False, **options) -> DataFrame:
    """All entities of a folder's files."""
    return extract.extracted(scan(spark, root, **options), brief=brief)


def compared(path_a: str, text_a: str, path_b: str, text_b: str) -> list[tuple]:
    """Two files as changes (path, status, old path, before, after): one modification, or a deletion and an addition where their kinds differ."""
    if extract.parser_of(path_a)[0] is extract.parser_of(path_b)[0]:
        return [(path_b, "modified", path_a if path_a != path_b else None, text_a, text_b)]
    return [(path_a, "deleted", None, text_a, None), (path_b, "added", None, None, text_b)]
