"""What to do after files changed, and replies that say only what is new.

Defined cases: an empty former listing asks for a full walk; null hashes equal
nothing; a body that a session never saw is told whole; bodies over ``STORED``
bytes are not remembered, so the next reply is whole again.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DELTA_LINES, STORED = 120, 64 << 10


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``file_path, change`` between two listings (``file_path, mtime, content_hash``): created, removed, touched or content."""
    o = old.select("file_path", F.col("mtime").alias("o_mtime"), F.col("content_hash").alias("o_hash"), F.lit(True).alias("was"))
    n = new.select("file_path", "mtime", "content_hash", F.lit(True).alias("is"))
    kind = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "removed").when(F.col("content_hash") == F.col("o_hash"), F.when(F.col("mtime") != F.col("o_mtime"), "touched")).otherwise("content")
    return o.join(n, "file_path", "full_outer").select("file_path", kind.alias("change")).filter("change is not null")


def plan(found: DataFrame) -> DataFrame:
    """One row, ``action``: reuse what there is, refresh it incrementally, or walk all files again."""
    n = found.agg(F.count_if(F.col("change").isin("created", "removed")).alias("structural"), F.count_if(F.col("change") == "content").alias("content"))
    return n.select(F.when(F.col("structural") > 0, "walk").when(F.col("content") > 0, "incremental").otherwise("reuse").alias("action"), "structural", "content")


def dependency_fresh(found: DataFrame, imports: DataFrame, entities: DataFrame) -> DataFrame:
    """``id, fresh`` of entities whose own file and the files it imports did not change."""
    stale = found.filter("change <> 'touched'").select(F.col("file_path").alias("stale_file")).distinct()
    files = entities.select("id", F.col("file_path").alias("needs")).union(entities.join(imports, F.col("file_path") == F.col("importing_file")).select("id", F.col("imported_file")))
    return files.join(stale, F.col("needs") == F.col("stale_file"), "left").groupBy("id").agg((F.count("stale_file") == 0).alias("fresh"))


def test_flags(nodes: DataFrame, is_test) -> DataFrame:
    """``entity_id, is_test`` of all nodes, with a row of a null id as the mark that the flags are whole."""
    mark = nodes.sparkSession.range(1).select(F.lit(None).cast("string").alias("entity_id"), F.lit(False).alias("is_test"))
    return nodes.select(F.col("id").alias("entity_id"), is_test.alias("is_test")).union(mark)


def oracle_says_fresh(saved: tuple[str, bool] | None, now: tuple[str, bool], eligible: bool = True) -> bool:
    """Whether a graph saved at (commit, clean) may be used without looking at files; it can only decline."""
    return saved is not None and eligible and saved[0] == now[0] and saved[1] and now[1]


def line_delta(old: str, new: str) -> str | None:
    """Removed and added lines, null where they are more than ``DELTA_LINES``."""
    rows = [x for x in difflib.unified_diff(old.split("\n"), new.split("\n"), lineterm="", n=0) if not x.startswith(("---", "+++", "@@"))]
    return "\n".join(rows) if len(rows) <= DELTA_LINES else None


def replies(fills: DataFrame, session: str, entity: str, order: list[str], body: str) -> DataFrame:
    """``fills`` with ``kind`` (first, unchanged, delta or full) and ``told``: nothing new, the changed lines, or all of it."""
    w = W.partitionBy(session, entity).orderBy(*order)
    kept = F.when(F.octet_length(F.col(body)) <= STORED, F.col(body))
    d = fills.withColumns({"_old": F.lag(kept).over(w), "_hash": F.lag(F.md5(F.col(body))).over(w)})

    @F.pandas_udf("string")
    def delta(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([line_delta(a, b) if a is not None and b is not None else None for a, b in zip(old, new)], dtype=object)

    changed = ~F.md5(F.col(body)).eqNullSafe(F.col("_hash"))
    d = d.withColumn("_delta", F.when(F.col("_old").isNotNull() & changed, delta("_old", body)))
    kind = F.when(F.col("_hash").isNull(), "first").when(~changed, "unchanged").when(F.col("_delta").isNotNull(), "delta").otherwise("full")
    told = F.when(kind == "unchanged", F.lit("")).when(kind == "delta", F.col("_delta")).otherwise(F.col(body))
    return d.withColumns({"kind": kind, "told": told}).drop("_old", "_hash", "_delta")


def extracted_once(files: DataFrame, extract) -> DataFrame:
    """``extract`` over each (path, content) once, however often ``files`` repeats it."""
    return extract(files.select("file_path", "content").dropDuplicates(["file_path", "content"]))
