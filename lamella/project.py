"""A project's tables in versions: facts by file, links and edges, published by one rename each.

A version is a manifest that lists, for every table, the folders of its layers.  A
step writes new layers beside the old ones and then publishes its manifest under the next number;
the rename fails if that number is taken, so of two writers one wins
and the other has to look again, and a step that is killed leaves the former version as it
was.  A reader opens one manifest and sees that version whatever comes after.

Facts come in layers: a step adds the rows of the files that it read and the list of
files whose former rows count no more.  References are laid out in folders by token bucket, so the
question who mentions a name reads the buckets of the names asked for.  After
``LAYERS`` layers a table is folded into one.

Defined cases: an empty project has no rows in any table; changing no file
publishes nothing; a file that is changed and deleted at once is changed; null
contents have no facts; versions that nobody pins are removed by :meth:`Project.vacuum` alone;
further columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import extract, exports, graph_build
from lamella.operators import graph as G
from lamella.storage import cut

LAYERS = 8
SCHEMAS = {
    "files": "file_path string, content string",
    "nodes": extract.SCHEMA,
    "references": graph_build.REFERENCE + ", bucket int",
    "imports": graph_build.IMPORT,
    "exports": exports.STATEMENT,
}
LINKS = {
    "links": "file_path string, local string, target string, name string",
    "step": "file_path string, name string, to_file string, to_name string, target string",
    "offered": "file_path string, name string, target string",
    "edges": "from_entity string, to_entity string, ref_type string, file_path string",
}


class Conflict(RuntimeError):
    """Another writer published the version first."""


class Snapshot:
    """One version of a project, pinned."""

    def __init__(self, spark: SparkSession, folder: str, manifest: dict) -> None:
        self.spark, self.folder, self.manifest = spark, folder, manifest
        self.version: int = manifest["version"]

    def _read(self, schema: str, layer: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{layer}")

    def table(self, name: str) -> DataFrame:
        """A table's rows; the latest layer that names a file has its rows."""
        if name in LINKS:
            return self._read(LINKS[name], self.manifest["tables"][name][0])
        out, later = None, None
        for layer in reversed(self.manifest["tables"][name]):
            rows = self._read(SCHEMAS[name], f"{layer}/rows")
            if later is not None:
                rows = rows.join(later, "file_path", "left_anti").select(*rows.columns)
            out = rows if out is None else out.unionByName(rows)
            own = self.spark.read.schema("file_path string").parquet(f"{self.folder}/{layer}/named")
            later = own if later is None else later.union(own).distinct()
        return out

    def facts(self) -> dict[str, DataFrame]:
        return {t: self.table(t) for t in SCHEMAS} | {"files": self.table("files").select("file_path")}

    def links(self) -> dict[str, DataFrame]:
        return {"imports": self.table("links"), "step": self.table("step"), "offered": self.table("offered")}

    def nodes(self) -> DataFrame:
        return self.table("nodes")

    def edges(self) -> DataFrame:
        return self.table("edges").select(*G.EDGE)

    def mentions(self, names: list[str]) -> DataFrame:
        """``file_path, from_entity, token`` of the references to ``names``, from their buckets alone."""
        wanted = self.spark.createDataFrame([(n,) for n in names], "token string")
        buckets = [r[0] for r in wanted.select(graph_build.bucket_of(F.col("token"))).distinct().collect()]
        refs = self.table("references").filter(F.col("bucket").isin(buckets) & F.col("token").isin(names))
        return refs.select("file_path", "from_entity", "token")


class Project:
    """The versions below ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[9:]) for n in names if n.startswith("manifest-"))

    def at(self, version: int | None = None) -> Snapshot:
        """The version of that number, the last one by default."""
        if version is None:
            version = self.versions()[-1]
        text = self.spark.read.text(f"{self.folder}/manifest-{version:08d}", wholetext=True).first()[0]
        return Snapshot(self.spark, self.folder, json.loads(text))

    def _write(self, rows: DataFrame, path: str, bucketed: bool = False) -> str:
        w = rows.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket") if bucketed else rows.write
        w.parquet(f"{self.folder}/{path}")
        return path

    def _layer(self, name: str, rows: DataFrame, named: DataFrame) -> str:
        layer = f"{name}-{uuid.uuid4().hex}"
        self._write(rows.select(*[c.split(" ")[0] for c in SCHEMAS[name].split(", ")]), f"{layer}/rows", name == "references")
        named.select("file_path").distinct().write.parquet(f"{self.folder}/{layer}/named")
        return layer

    def _publish(self, version: int, tables: dict[str, list[str]]) -> Snapshot:
        """Make ``tables`` the version ``version``: one rename, which fails if that number is taken."""
        manifest = {"version": version, "tables": tables}
        staged = f"staged-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{self.folder}/{staged}")
        final = f"manifest-{version:08d}"
        won = not self._fs.exists(self._path(final)) and self._fs.rename(self._path(staged), self._path(final))
        inner = self._path(f"{final}/{staged}")
        if won and self._fs.exists(inner):  # the other's folder took this one in
            self._fs.delete(inner, True)
            won = False
        if not won:
            self._fs.delete(self._path(staged), True)
            raise Conflict(f"version {version} is another writer's")
        return Snapshot(self.spark, self.folder, manifest)

    def _links(self, links: dict[str, DataFrame], edges: DataFrame) -> dict[str, list[str]]:
        parts = {"links": links["imports"], "step": links["step"], "offered": links["offered"], "edges": edges}
        return {t: [self._write(d.select(*[c.split(" ")[0] for c in LINKS[t].split(", ")]), f"{t}-{uuid.uuid4().hex}")] for t, d in parts.items()}

    def create(self, files: DataFrame) -> Snapshot:
        """The first version, from all ``files`` (``file_path, content``)."""
        files = cut(files.select("file_path", "content"), "files")
        known = graph_build.facts(files) | {"files": files}
        tables = {t: [self._layer(t, known[t], files)] for t in SCHEMAS}
        first = Snapshot(self.spark, self.folder, {"version": 0, "tables": tables})
        facts = first.facts()
        links = graph_build.linking(facts)
        return self._publish(0, tables | self._links(links, graph_build.linked(facts, links)))

    def update(self, changed: DataFrame, deleted: DataFrame | None = None) -> Snapshot:
        """The next version: ``changed`` files (``file_path, content``) put in, ``deleted`` ones (``file_path``) left out.

        Only the changed files are read; the edges are those of a full build.
        """
        before = self.at()
        changed = cut(changed.select("file_path", "content"), "changed")
        gone = changed.select("file_path")
        gone = cut((gone if deleted is None else gone.union(deleted.select("file_path"))).distinct(), "gone")
        if gone.isEmpty():
            return before
        new = graph_build.facts(changed)
        tables = {t: [*before.manifest["tables"][t], self._layer(t, changed if t == "files" else new[t], gone)] for t in SCHEMAS}
        after = Snapshot(self.spark, self.folder, {"version": before.version + 1, "tables": tables})
        facts, old = after.facts(), before.links()
        links = graph_build.linking(facts)
        dirty = cut(graph_build.frontier(before.facts(), facts, old, links, gone), "dirty")
        edges = before.table("edges").join(dirty, "file_path", "left_anti").unionByName(graph_build.linked(facts, links, dirty))
        for t in SCHEMAS:
            if len(tables[t]) > LAYERS:
                tables[t] = [self._layer(t, after.table(t), after.table("files"))]
        return self._publish(before.version + 1, tables | self._links(links, edges))

    def renamed(self, moves: DataFrame) -> Snapshot:
        """The next version after files moved (``old_file_path, file_path``) with their contents."""
        texts = self.at().table("files").withColumnRenamed("file_path", "old_file_path")
        moved = moves.select("old_file_path", "file_path").join(texts, "old_file_path")
        return self.update(moved.select("file_path", "content"), moved.select(F.col("old_file_path").alias("file_path")))

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions and the layers that only they held; for times when no writer works."""
        listed = self.versions()
        live = [self.at(v) for v in listed[-keep:]]
        held = {x for s in live for layers in s.manifest["tables"].values() for x in layers} | {f"manifest-{s.version:08d}" for s in live}
        for s in self._fs.listStatus(self._path("")):
            if s.getPath().getName() not in held:
                self._fs.delete(s.getPath(), True)
