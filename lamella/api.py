"""The engine's calls in one place; parameters are checked, unknown ones are errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import text as T
from lamella.operators import context, extract, graph, graph_build, history, lineage, matching, orphans, scopes, search
from lamella.project import Project
from lamella.storage import cut

CHANGE_TYPES = ("added", "modified", "deleted", "moved", "renamed", "reordered")


def entities(files: DataFrame, only: tuple[str, ...] = (), without: tuple[str, ...] = (), **options) -> DataFrame:
    """Entities of ``files`` (``file_path, content``), of some kinds or without some; a kind that none has is an error."""
    if only and without:
        raise ValueError("only and without exclude each other")
    found = extract.extracted(files, **options)
    if wanted := set(only) | set(without):
        found = cut(found, "entities")
        present = sorted(r[0] for r in found.select("entity_type").distinct().collect())
        if unknown := sorted(wanted - set(present)):
            raise ValueError(f"no entities of kind {', '.join(unknown)}; there are {', '.join(present)}")
        found = found.filter(F.col("entity_type").isin(*only) if only else ~F.col("entity_type").isin(*without))
    return found.orderBy("file_path", "start_line", "id")


def diff_files(changes: DataFrame, **options) -> DataFrame:
    """Change rows of file changes (``file_path, status, old_file_path, before_content, after_content``), lines outside entities included."""
    before = changes.filter("before_content is not null").select(F.coalesce("old_file_path", "file_path").alias("file_path"), F.col("before_content").alias("content"))
    after = changes.filter("after_content is not null").select("file_path", F.col("after_content").alias("content"))
    b, a = cut(extract.extracted(before), "before"), cut(extract.extracted(after), "after")
    rows = matching.diff(b, a, **options)
    spans = lambda e: e.groupBy("file_path").agg(F.collect_list(F.struct("start_line", "end_line")).alias("s"))
    sb = spans(b).select(F.col("file_path").alias("old"), F.col("s").alias("before_spans"))
    sa = spans(a).select("file_path", F.col("s").alias("after_spans"))
    loose = changes.filter("before_content is not null and after_content is not null").withColumn("old", F.coalesce("old_file_path", "file_path"))
    loose = orphans.orphan_changes(loose.join(sb, "old", "left").join(sa, "file_path", "left"))
    extra = loose.select(
        F.concat(F.lit("change::"), "entity_id").alias("id"), "entity_id", "change_type", F.lit("orphan").alias("entity_type"), F.lit("module-level").alias("entity_name"), F.col("start_line").alias("entity_line"), "start_line", "end_line", "old_start_line", "old_end_line", "file_path", "before_content", "after_content", (~F.coalesce("before_content", F.lit("")).eqNullSafe(F.coalesce("after_content", F.lit("")))).alias("content_changed")
    )
    return rows.unionByName(extra, allowMissingColumns=True).orderBy("file_path", "entity_line", "entity_id")


diff = matching.diff
pack_context = context.packed
pack_contexts = context.packed_many
cross_deps = graph.cross_repository
lifetime_stats = history.lifetime
trace = history.trace
lines_of_history = lineage.histories
line_of = lineage.history_of
tests_of_diff = graph_build.tests_of_many


def build_graph(files: DataFrame, only: DataFrame | None = None, types: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``files``; ``types`` adds calls in Python files that scopes and the flow of types decide."""
    if types and only is not None:
        raise ValueError("types flow through all files: only and types exclude each other")
    nodes, edges = graph_build.graph(files, only)
    if not types:
        return nodes, edges
    known = graph_build.facts(files, "imports", "exports", "scopes") | {"nodes": nodes}
    links = graph_build.linking(known)
    more = scopes.calls(files, nodes, links["imports"], links["offered"], known["scopes"])
    more = more.join(edges, ["from_entity", "to_entity"], "left_anti").withColumn("ref_type", F.lit("calls"))
    return nodes, cut(edges.unionByName(more), "edges")


def impact(nodes: DataFrame, edges: DataFrame, node: str, mode: str = "all", depth: int = 2) -> DataFrame | dict[str, DataFrame]:
    """``mode``: all, deps, dependents, impact or tests; ``depth`` 0 means no limit."""
    if mode not in ("all", "deps", "dependents", "impact", "tests"):
        raise ValueError(f"unknown mode {mode}")
    out = graph_build.impact(nodes, edges, node, depth)
    return out if mode == "all" else out[mode]


def blame(entity_rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The commit of each entity's latest line (``file_path, line_number, commit_sha, author_time``); null where no line is known."""
    points = lines.select("file_path", F.col("line_number").alias("line"), "commit_sha", "author_time")
    e = entity_rows.select("id", "file_path", "start_line", "end_line")
    inside = e.select("id", "file_path", F.explode(F.sequence("start_line", "end_line")).alias("line")).join(points, ["file_path", "line"])
    found = history.entity_blame(inside, "id", "line", "commit_sha", "author_time")
    return e.select("id", "file_path", "start_line").join(found, "id", "left").orderBy("file_path", "start_line", "id")


def history_of(changes: DataFrame, commits: DataFrame, limit: int = 500) -> dict[str, DataFrame]:
    if limit < 0:
        raise ValueError("limit must not be negative; 0 means all commits")
    return history.stored(changes, commits, limit)


def text_search(files: DataFrame, needle: str, limit: int = 10) -> DataFrame:
    """The first hits with the innermost entity around each."""
    if not needle:
        raise ValueError("nothing to search for")
    hits = search.first_hits(files, "file_path", "content", needle, limit)
    within = files.join(hits.select("file_path").distinct(), "file_path", "left_semi")
    found = search.innermost(hits, extract.extracted(within, brief=True))
    return hits.join(found, ["file_path", "line"], "left").orderBy("file_path", "line")


class Warm:
    """A graph kept for point queries: written once, refreshed with the files that changed."""

    def __init__(self, files: DataFrame) -> None:
        self.files = cut(files.select("file_path", "content"), "files")
        self.nodes, self.edges = graph_build.graph(self.files)

    def refresh(self, changed: DataFrame, deleted: DataFrame | None = None) -> None:
        self.nodes, self.edges = graph_build.refreshed(self.files, changed, self.nodes, self.edges, deleted)
        gone = changed.select("file_path") if deleted is None else changed.select("file_path").union(deleted.select("file_path"))
        self.files = cut(self.files.join(gone, "file_path", "left_anti").union(changed.select("file_path", "content")), "files")

    def context(self, name: str, budget: int = 8000, hops: int = 0) -> dict[str, DataFrame]:
        hit = search.lookup(self.nodes, name).first()
        if hit["status"] != "found":
            raise ValueError(f"{name}: {hit['status']}")
        return context.packed(self.nodes, self.edges, hit["id"], budget, hops)

    def impact(self, node: str, depth: int = 2) -> dict[str, DataFrame]:
        return graph_build.impact(self.nodes, self.edges, node, depth)

    def text(self, needle: str, limit: int = 10) -> DataFrame:
        return text_search(self.files, needle, limit)


__all__ = ["CHANGE_TYPES", "Project", "T", "Warm", "blame", "build_graph", "cross_deps", "diff", "diff_files", "entities", "history_of", "impact", "lifetime_stats", "line_of", "lines_of_history", "pack_context", "pack_contexts", "tests_of_diff", "text_search", "trace"]
