"""Analytics over commits and the entities they change.

Defined cases: null entities form one group; repeated (entity, commit) rows count
once; commits at one time go by sha; empty inputs give no rows (one row of nulls
from :func:`lifetime`); windows run within one key, whose rows meet in one task in
order; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.functions import text as T
from lamella.storage import cut, parted, shuffles


def hotspots(changes: DataFrame, entity: str = "entity", commit: str = "sha", author: str = "author", order: tuple[str, ...] = ("committed_at", "sha")) -> DataFrame:
    """Per entity: commits that change it, their authors, and the newest commit.

    Summed by (entity, commit), then (entity, author), then entity: every sum is
    partial before its shuffle, so an entity of very many commits needs no large
    group.  A commit's author is its least one; null authors aren't counted.
    """
    spark, at = changes.sparkSession, F.struct(*order)
    rows = cut(changes.select(*dict.fromkeys([entity, commit, author, *order])), "changes")
    n = rows.count()
    one = parted(rows, entity, commit, rows=n).groupBy(entity, commit).agg(F.min(author).alias("_author"), F.max(at).alias("_at"))
    by_author = one.groupBy(entity, "_author").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("_at", F.col(commit).alias("sha"))).alias("_last"))
    with shuffles(spark, n):
        return cut(by_author.groupBy(entity).agg(F.sum("_n").alias("commits"), F.count("_author").alias("authors"), F.max("_last")["sha"].alias("newest")), "hotspots")


def co_changes(changes: DataFrame, entity: str = "entity", commit: str = "sha", most: int = 50, least: int = 2) -> DataFrame:
    """Unordered pairs changed in the same commit at least ``least`` times, with confidence.

    Commits of over ``most`` entities are left out, which is part of the
    measure and bounds the pairs of a commit, which are made in its row.  What a task holds
    follows the counted rows and pairs.
    """
    spark = changes.sparkSession
    rows = cut(changes.select(entity, commit), "changes")
    one = parted(rows.filter(F.col(commit).isNotNull()), commit, rows=rows.count()).distinct()
    few = one.withColumn("_k", F.row_number().over(W.partitionBy(commit).orderBy(entity))).filter(F.col("_k") <= most + 1)
    sets = few.groupBy(commit).agg(F.array_sort(F.collect_list(entity)).alias("_set"), F.max("_k").alias("_n")).filter(F.col("_n") <= most)
    sets = cut(sets.select(commit, "_set"), "sets")
    size = F.size("_set").cast("long")
    kept, met = sets.agg(F.sum(size), F.sum(F.floor(size * (size - 1) / 2))).first()
    later = lambda x, i: F.transform(F.slice("_set", i + 2, F.size("_set")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = parted(sets, commit, rows=met or 0).select(F.inline(F.flatten(F.transform("_set", later))))
    with shuffles(spark, met or 0):
        pairs = cut(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= least), "pairs")
    total = parted(sets, commit, rows=kept or 0).select(F.explode("_set").alias(entity))
    with shuffles(spark, kept or 0):
        total = cut(total.groupBy(entity).agg(F.count(F.lit(1)).alias("n")), "totals")
    ta, tb = (total.select(F.col(entity).alias(x), F.col("n").alias(f"commits_{x}")) for x in "ab")
    return pairs.join(ta, "a").join(tb, "b").withColumn("confidence", T.confidence(F.col("together"), F.col("commits_a"), F.col("commits_b"))).select("a", "b", "together", "commits_a", "commits_b", "confidence")


def transitions(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows at which a key's value differs from that of its row before, the first one included."""
    w = W.partitionBy(key).orderBy(*order)
    d = rows.withColumns({"previous": F.lag(value).over(w), "_k": F.row_number().over(w)})
    return d.filter((F.col("_k") == 1) | ~F.col(value).eqNullSafe(F.col("previous"))).withColumn("change", F.when(F.col("_k") == 1, "added").otherwise("modified")).drop("_k")


def entity_blame(lines: DataFrame, entity: str, line: str, commit: str, time: str) -> DataFrame:
    """The commit of an entity's latest line; an uncommitted line goes first, ties keep the first line."""
    best = F.struct(F.col(commit).isNull().alias("u"), F.when(F.col(commit).isNull(), F.lit(0)).otherwise(F.col(time)).alias("t"), (-F.col(line)).alias("l"))
    return lines.groupBy(entity).agg(F.max_by(F.struct(F.col(commit).alias("sha"), F.col(line).alias("line")), best).alias("_b")).select(entity, "_b.sha", "_b.line")


def lifetime(runs: DataFrame) -> DataFrame:
    """Running totals: files, changes, entities seen, and entities that were not changes."""
    seen = F.greatest("before", "after")
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.sum("changes").alias("changes"), F.sum(seen).alias("entities"), F.sum(F.greatest(seen - F.col("changes"), F.lit(0))).alias("noise"))


def next_boundary(rows: DataFrame, key: str, order: list[str], line: str) -> DataFrame:
    """``last``: the line before the next row of the same key begins, null for the last one."""
    return rows.withColumn("last", F.lead(line).over(W.partitionBy(key).orderBy(*order)) - 1)


def top(rows: DataFrame, most: int, down: list[str], up: list[str]) -> DataFrame:
    """The first ``most`` rows, ``down`` columns largest first, then ``up`` ones smallest first."""
    return rows.orderBy(*[F.desc(c) for c in down], *[F.asc(c) for c in up]).limit(most)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 1, in ``order``: ranges sorted by their tasks, each begun after the counts of those before.

    Ranges are kept before they are counted, so both readings see the same ones.
    """
    ranged = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged, "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_k", own).join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_k")).drop("_range", "_k", "_before")


def newest(commits: DataFrame, limit: int = 50, order: tuple[str, ...] = ("committed_at", "sha")) -> DataFrame:
    """The newest ``limit`` commits and one before them as a baseline; 0 means all."""
    rows = commits.orderBy(*[F.desc(c) for c in order])
    return rows.limit(limit + 1) if limit else rows


def change_counts(rows: DataFrame, keys: list[str], file_path: str | None = None) -> DataFrame:
    """``change_count`` by key, of one file if it is given."""
    rows = rows if file_path is None else rows.filter(F.col("file_path") == file_path)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("change_count"))


def stored(changes: DataFrame, commits: DataFrame, limit: int = 500, most: int = 50) -> dict[str, DataFrame]:
    """``hotspots`` and ``pairs`` of the newest ``limit`` commits (``sha, author, committed_at, is_merge``).

    The oldest one taken is a baseline only, and merges contribute nothing.
    """
    window = newest(commits, limit)
    last = F.struct("committed_at", "sha")
    base = window.agg(F.min(last).alias("base"))
    kept = window.crossJoin(F.broadcast(base)).filter(last > F.col("base")).filter(~F.col("is_merge")).drop("base", "is_merge")
    rows = changes.join(kept, "sha")
    return {"hotspots": hotspots(rows), "pairs": co_changes(rows, most=most)}


def trace(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The versions of each ``key`` that differ from the one before, with ``change`` and ``logic``.

    A change of file or parent is a move, else one of the name a rename, else a
    modification; ``logic`` says of a modification whether its structure changed.
    """
    w = W.partitionBy(key).orderBy(*order)
    fields = ("file_path", "parent_id", "name", "content_hash", "structural_hash")
    d = versions.withColumns({f"_{f}": F.lag(f).over(w) for f in fields} | {"_k": F.row_number().over(w)})
    differs = lambda f: ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    moved, renamed, content = differs("file_path") | differs("parent_id"), differs("name"), differs("content_hash")
    change = F.when(F.col("_k") == 1, "added").when(moved, "moved").when(renamed, "renamed").otherwise("modified")
    logic = (F.col("_k") > 1) & ~moved & ~renamed & differs("structural_hash")
    d = d.filter((F.col("_k") == 1) | moved | renamed | content)
    return d.withColumns({"change": change, "logic": logic}).drop("_k", *[f"_{f}" for f in fields])


def manifest_hash(files: DataFrame) -> DataFrame:
    """``hash`` of all (``path, mtime``) by path and their number; paths and times meet in one row."""
    one = F.array_sort(F.collect_list(F.struct("path", "mtime")))
    listed = F.array_join(F.transform(one, lambda x: F.concat_ws(":", x["path"].cast("string"), x["mtime"].cast("string"))), "|")
    return files.agg(F.md5(F.concat(listed, F.lit("#"), F.count(F.lit(1)).cast("string"))).alias("hash"))


def as_text(rows: DataFrame, key: str) -> DataFrame:
    """One line a change of :func:`trace`, for readers."""
    return rows.select(key, F.concat_ws(" ", F.col("change"), F.col("name"), F.concat(F.lit("in "), F.col("file_path"))).alias("text"))
