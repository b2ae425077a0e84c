"""Change rows between two snapshots of entities.

Defined cases: null hashes are equal to each other in :func:`by_id` and match
nothing in :func:`by_hash`; an id that one side repeats gives a row for each pair;
empty sides give only additions or deletions; ties of equal hashes go by key; a
group of :func:`reordered` is one frame in one task, its columns the two numbers.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.functions import text as T

COMPOUND = ("moved", "renamed", "reordered")


def by_id(before: DataFrame, after: DataFrame, key: str = "id", digest: str = "content_hash") -> DataFrame:
    """``key, change_type`` of every id: added, deleted, modified or unchanged; one full outer join."""
    b = before.select(F.col(key), F.col(digest).alias("_b"), F.lit(1).alias("_in_b"))
    a = after.select(F.col(key), F.col(digest).alias("_a"), F.lit(1).alias("_in_a"))
    kind = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "deleted").when(F.col("_b").eqNullSafe(F.col("_a")), "unchanged").otherwise("modified")
    return b.join(a, key, "full_outer").select(key, kind.alias("change_type"))


def by_hash(before: DataFrame, after: DataFrame, key: str, digest: str, newest_first: bool = True) -> DataFrame:
    """One-to-one pairs of entities of equal hash: the k-th of each side meet, counted from the last before row where ``newest_first``."""
    order = F.desc(key) if newest_first else F.asc(key)
    b = before.select(F.col(key).alias("before_id"), F.col(digest).alias("digest"), F.row_number().over(W.partitionBy(digest).orderBy(order)).alias("k"))
    a = after.select(F.col(key).alias("after_id"), F.col(digest).alias("digest"), F.row_number().over(W.partitionBy(digest).orderBy(key)).alias("k"))
    return b.join(a, ["digest", "k"]).select("before_id", "after_id", "digest")


def classified(b: str = "b_", a: str = "a_") -> Column:
    """Change type of a matched pair whose sides' columns have prefixes."""
    d = lambda x: ~F.col(a + x).eqNullSafe(F.col(b + x))
    return F.when(d("file_path") | d("parent_id"), "moved").when(d("entity_type") | d("name"), "renamed").otherwise("modified")


def summary(changes: DataFrame) -> DataFrame:
    """One row of counts; moved, renamed and reordered rows whose content changed count as modified too."""
    t, changed = F.col("change_type"), F.coalesce(F.col("content_changed"), F.lit(False))
    n = lambda c: F.count_if(c)
    return changes.agg(
        F.count_distinct("file_path").alias("file_count"), n(t == "added").alias("added"), n((t == "modified") | (t.isin(*COMPOUND) & changed)).alias("modified"), n(t == "deleted").alias("deleted"),
        n(t == "moved").alias("moved"), n(t == "renamed").alias("renamed"), n(t == "reordered").alias("reordered"), F.count(F.lit(1)).alias("total"),
    )


def not_cosmetic(changes: DataFrame) -> DataFrame:
    """Changes whose structure isn't known to be the same, and all compound ones."""
    return changes.filter(~F.col("structural_change").eqNullSafe(F.lit(False)) | F.col("change_type").isin(*COMPOUND))


def structural_change(before: Column, after: Column) -> Column:
    return T.structural_text(before) != T.structural_text(after)


def orphan_segments(lines: DataFrame, covered: DataFrame, path: str = "file_path", line: str = "line") -> DataFrame:
    """Runs of neighbouring lines that no entity covers, by an anti join and islands."""
    free = lines.join(covered, [path, line], "left_anti")
    free = free.withColumn("_i", F.col(line) - F.row_number().over(W.partitionBy(path).orderBy(line)))
    return free.groupBy(path, "_i").agg(F.min(line).alias("start_line"), F.max(line).alias("end_line"), F.count(F.lit(1)).alias("n_lines")).drop("_i")


def longest_non_decreasing(values: list[int]) -> set[int]:
    """Places of one longest non-decreasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_right(tails, v)
        back[i] = at[k - 1] if k else -1
        tails[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out: set[int] = set()
    i = at[-1] if at else -1
    while i >= 0:
        out.add(i)
        i = back[i]
    return out


def reordered(rows: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """Each row with whether it lies outside a longest non-decreasing run of ``value`` by ``position`` in its group."""
    schema = f"{group} {rows.schema[group].dataType.simpleString()}, {position} {rows.schema[position].dataType.simpleString()}, {value} {rows.schema[value].dataType.simpleString()}, reordered boolean"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([position, value], ignore_index=True)
        kept = longest_non_decreasing(pdf[value].tolist())
        return pdf.assign(reordered=[i not in kept for i in range(len(pdf))])

    return rows.select(group, position, value).groupBy(group).applyInPandas(work, schema)
