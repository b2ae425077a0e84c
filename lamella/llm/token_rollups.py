"""Token totals kept up to date by signed deltas, committed in idempotent batches.

A change is an insert (adds a document and its tokens), a delete (takes them
away) or a revise (adds new minus old tokens).  Changes are summed to one row a
(source, lang, version) before anything is stored; a commit writes these rows
to the ledger under the batch's name.  A batch of a name already committed is
left alone, so a retried batch counts once; the write appears by one rename, so
a failed one counts not at all.  Totals are sums over the committed batches,
and :meth:`Ledger.compact` folds them into one that keeps their names.  The folded
one appears by one rename too, and readers leave out what it names, so totals
and names are right at every moment, also after a compaction that was cut off:
what it left behind counts no more, and the next one removes it.  A reader whose
folders go while it reads fails and has to ask again.

Both hold where a rename of a folder is atomic and fails or nests if the target exists,
as in HDFS and local file systems.  On object stores without such a rename two writers of
one batch at the same time could both win; they need a committer of their own.

Defined cases: null sources, languages and versions are groups of their own;
null counts are 0; unknown changes raise when the batch runs; groups whose
documents and tokens are 0 again are left out of totals; an empty batch commits
no rows and still counts as committed; other columns are ignored.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import small_batches
from ._tokens import default_path, encoder

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, docs long, tokens long"


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, source, lang, n_words, n_tokens`` of every whole text."""
    small_batches(docs.sparkSession)
    path = path or default_path()

    def emit(batches):
        enc = encoder(path)
        for b in batches:
            texts = [t or "" for t in b.column(3).to_pylist()]
            counts = [[len(t.encode().split()) for t in texts], [len(x) for x in enc.many(texts)]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(c, pa.int64()) for c in counts]], ["doc_id", "source", "lang", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text).alias("t"))
    return rows.mapInArrow(emit, "doc_id long, source string, lang string, n_words long, n_tokens long")


def deltas(changes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Changes (``op, source, lang, version, old_tokens, new_tokens``) to signed sums by ``keys`` and group."""
    op = F.col("op")
    old, new = F.coalesce("old_tokens", F.lit(0)), F.coalesce("new_tokens", F.lit(0))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown change "), F.coalesce(op, F.lit("null")))).cast("int"))
    tokens = F.when(op == "insert", new).when(op == "delete", -old).otherwise(new - old)
    return changes.groupBy(*keys, *KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class Ledger:
    """The committed batches below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _listed(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []

    def _folded(self) -> list[str]:
        """The folded batches that no other has taken in; more than one while a compaction was cut off."""
        found = [x for x in self._listed() if x.startswith("folded-")]
        taken = {r[0] for r in self.spark.read.parquet(*[f"{self.path}/{x}/took" for x in found]).collect()} if found else set()
        return [x for x in found if x not in taken]

    def _names(self, folded: list[str]) -> DataFrame:
        return self.spark.read.schema("name string").parquet(*[f"{self.path}/{x}/names" for x in folded])

    def _open(self, folded: list[str]) -> list[str]:
        """Folders of the batches that stand for themselves."""
        found = [x for x in self._listed() if x.startswith("batch-")]
        if not folded or not found:
            return found
        listed = self.spark.createDataFrame([(unquote(x[6:]),) for x in found], "name string")
        known = {r[0] for r in listed.join(self._names(folded), "name", "left_semi").collect()}
        return [x for x in found if unquote(x[6:]) not in known]

    def batches(self) -> DataFrame:
        """``name`` of every committed batch, folded ones too."""
        folded = self._folded()
        own = self.spark.createDataFrame([(unquote(x[6:]),) for x in self._open(folded)], "name string")
        return own.union(self._names(folded)).distinct() if folded else own

    def committed(self, batch: str) -> bool:
        # A folded batch appears before the folders that it took in go, so in this order none is overlooked.
        if self._fs.exists(self._path("batch-" + quote(batch, safe=""))):
            return True
        folded = self._folded()
        return bool(folded) and not self._names(folded).filter(F.col("name") == batch).isEmpty()

    def commit(self, batch: str, sums: DataFrame) -> bool:
        """Commit :func:`deltas` under ``batch``; whether it was new."""
        if self.committed(batch):
            return False
        staged = f"staged-{uuid.uuid4().hex}"
        sums.select(*KEYS, "docs", "tokens").coalesce(1).write.parquet(f"{self.path}/{staged}")
        if not self._fs.rename(self._path(staged), self._path("batch-" + quote(batch, safe=""))):
            self._fs.delete(self._path(staged), True)
            return False
        inner = self._path("batch-" + quote(batch, safe="") + "/" + staged)
        if self._fs.exists(inner):  # another commit of the batch came first and took this one in
            self._fs.delete(inner, True)
            return False
        return True

    def _stored(self) -> DataFrame:
        folded = self._folded()
        paths = [f"{self.path}/{x}" for x in self._open(folded)] + [f"{self.path}/{x}/sums" for x in folded]
        read = self.spark.read.schema(SCHEMA)
        return read.parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def totals(self, *keys: str) -> DataFrame:
        """``docs`` and ``tokens`` by ``keys`` (by all three unless given)."""
        g = self._stored().groupBy(*(keys or KEYS)).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return g.filter("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into one; for a single maintainer at a time, who may stop or fail at any point."""
        old, folded = self._listed(), self._folded()
        own = self._open(folded)
        staged = f"staged-{uuid.uuid4().hex}"
        if own or len(folded) > 1:
            names = self.spark.createDataFrame([(unquote(x[6:]),) for x in own], "name string")
            paths = [f"{self.path}/{x}" for x in own] + [f"{self.path}/{x}/sums" for x in folded]
            sums = self.spark.read.schema(SCHEMA).parquet(*paths)
            sums.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).coalesce(1).write.parquet(f"{self.path}/{staged}/sums")
            (names.union(self._names(folded)) if folded else names).write.parquet(f"{self.path}/{staged}/names")
            self.spark.createDataFrame([(x,) for x in folded], "name string").write.parquet(f"{self.path}/{staged}/took")
            self._publish(staged)
        self._clear(old)

    def _publish(self, staged: str) -> None:
        self._fs.rename(self._path(staged), self._path("folded-" + staged[7:]))

    def _clear(self, old: list[str]) -> None:
        """Remove of the folders ``old`` what counts no more."""
        folded = self._folded()
        live = {*folded, *self._open(folded)}
        for x in old:
            if x.startswith(("batch-", "folded-")) and x not in live:
                self._fs.delete(self._path(x), True)
