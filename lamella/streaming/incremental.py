"""Incremental maintenance: merges, the commit index and the session ledger.

Defined cases: null keys of a delta replace nothing; rows of ``base`` that repeat
a key all go; unknown files are ``new``; the first fill of a session and entity
is ``first``; empty inputs give no rows; ties of an order are the caller's to
break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged(base: DataFrame, delta: DataFrame, key: str, deleted: DataFrame | None = None) -> DataFrame:
    """``base`` with the rows of ``delta``'s keys replaced and ``deleted`` keys left out."""
    gone = delta.select(key).distinct()
    if deleted is not None:
        gone = gone.union(deleted.select(key)).distinct()
    return base.join(gone, key, "left_anti").unionByName(delta)


def freshness(files: DataFrame, cached: DataFrame, path: str = "path") -> DataFrame:
    """``fresh`` for equal times, ``touched`` for equal content of another time, else ``stale``; unknown files are ``new``."""
    c = cached.select(path, F.col("mtime").alias("_m"), F.col("content_hash").alias("_h"))
    state = F.when(F.col("_m").isNull() & F.col("_h").isNull(), "new").when(F.col("mtime") == F.col("_m"), "fresh").when(F.col("content_hash") == F.col("_h"), "touched").otherwise("stale")
    return files.join(c, path, "left").withColumn("state", state).drop("_m", "_h")


#: Buckets of the commit index's keys by hash, key folders before they are folded into one, and keys looked up by value.
BUCKETS, FOLDERS, LISTED = 64, 16, 10_000


class KeyIndex:
    """The keys that a commit index holds, below ``folder``: in buckets by hash, sorted, so a batch reads its own keys' buckets.

    A batch's keys stand in a folder of their own, written anew if the batch is
    repeated.  After :data:`FOLDERS` of them all but the running batch's are folded into one, which
    appears by one rename and is from then on read instead of what it covers.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, kind: str) -> None:
        self.spark, self.folder, self.key, self.schema = spark, folder, key, f"{key} {kind}, bucket int"
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def _listed(self) -> tuple[int, list[int]]:
        """The last batch that is folded (-1: none) and those after it."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []
        of = lambda kind: [int(n.removeprefix(kind)) for n in names if n.startswith(kind)]
        folded = max(of("folded-"), default=-1)
        return folded, sorted(k for k in of("batch-") if k > folded)

    def _read(self, folded: int, batches: list[int]) -> DataFrame | None:
        paths = [f"{self.folder}/folded-{folded}"] * (folded >= 0) + [f"{self.folder}/batch-{k}" for k in batches]
        out = None
        for p in paths:
            one = self.spark.read.schema(self.schema).parquet(p)
            out = one if out is None else out.union(one)
        return out

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        b = F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int")
        return rows.select(self.key).withColumn("bucket", b).repartition("bucket").sortWithinPartitions("bucket", self.key)

    def unknown(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The rows whose keys no other batch brought."""
        folded, batches = self._listed()
        known = self._read(folded, [k for k in batches if k != batch_id])
        if known is None:
            return rows
        keys = rows.select(self.key).distinct()
        n, buckets = keys.agg(F.count(F.lit(1)), F.collect_set(F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int"))).first()
        known = known.filter(F.col("bucket").isin(buckets))
        if n <= LISTED:
            values = [r[0] for r in keys.collect()]
            known = known.filter(F.col(self.key).isin([v for v in values if v is not None]) | (F.col(self.key).isNull() if None in values else F.lit(False)))
        known = known.select(F.col(self.key).alias("_known"))
        return rows.join(known, F.col(self.key).eqNullSafe(F.col("_known")), "left_anti")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        self._bucketed(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch-{batch_id}")

    def fold(self, batch_id: int) -> None:
        """Fold the batches before ``batch_id`` if there are many; what a fold that was cut off left behind goes with the next one."""
        folded, batches = self._listed()
        done = [k for k in batches if k < batch_id]
        if len(done) < FOLDERS:
            return
        staged = f"staged-{done[-1]}"
        self._bucketed(self._read(folded, done)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{staged}")
        self._fs.rename(self._path(staged), self._path(f"folded-{done[-1]}"))
        for s in self._fs.listStatus(self._path("")):
            name = s.getPath().getName()
            kind, _, k = name.partition("-")
            if kind in ("batch", "folded") and int(k) <= done[-1] and name != f"folded-{done[-1]}":
                self._fs.delete(s.getPath(), True)


def index_commits(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "sha") -> None:
    """Append the commits of a file stream that ``target`` lacks, each key once, also when a batch is repeated.

    A batch owns the folder ``batch=<id>``, which a repeated batch writes anew: what
    that folder holds already doesn't count as known.  What other batches brought
    is looked up in a :class:`KeyIndex` beside them (``_keys``, which readers of the table pass
    over), not in their rows; a table without one gets it from its rows.  Rows of one key within a
    batch: the one of least hash is kept.  Null keys count as one key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        index = KeyIndex(session, f"{target}/_keys", key, batch.schema[key].dataType.simpleString())
        if index._listed() == (-1, []):
            path = index._hadoop.Path(target)
            had = [s.getPath().toString() for s in index._fs.listStatus(path)] if index._fs.exists(path) else []
            for x in had:
                k = x.rpartition("/batch=")[2]
                if "/batch=" in x and int(k) != batch_id:
                    index.add(session.read.schema(batch.schema).parquet(x), int(k))
        w = W.partitionBy(key).orderBy(F.xxhash64(*batch.columns))
        new = batch.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")
        index.unknown(new, batch_id).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        index.add(session.read.schema(batch.schema).parquet(f"{target}/batch={batch_id}"), batch_id)
        index.fold(batch_id)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ledger(fills: DataFrame, session: str, entity: str, order: list[str], body: str) -> DataFrame:
    """What a session is told of an entity: ``first``, ``unchanged`` or ``changed``, by the fingerprint it had last."""
    w = W.partitionBy(session, entity).orderBy(*order)
    d = fills.withColumn("fingerprint", F.md5(F.col(body))).withColumn("_p", F.lag("fingerprint").over(w))
    return d.withColumn("reply", F.when(F.col("_p").isNull(), "first").when(F.col("_p") == F.col("fingerprint"), "unchanged").otherwise("changed")).drop("_p")


def ledger_stream(fills: DataFrame, session: str, entity: str, body: str, ttl: str | None = "1 hour"):
    """:func:`ledger` as a stream with state for each (session, entity), forgotten after ``ttl`` without use.

    A query that forgets by time looks for more batches as long as it runs, so
    one that should end with its data (``availableNow``) needs ``ttl`` null.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else 0

    def reply(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for pdf in batches:
            out = []
            for fp in pdf["fingerprint"]:
                out.append("first" if last is None else "unchanged" if fp == last else "changed")
                last = fp
            yield pd.DataFrame({session: key[0], entity: key[1], "fingerprint": pdf["fingerprint"], "reply": out})
        state.update((last,))
        if ms:
            state.setTimeoutDuration(ms)

    t = {f.name: f.dataType.simpleString() for f in fills.schema}
    return fills.withColumn("fingerprint", F.md5(F.col(body))).groupBy(session, entity).applyInPandasWithState(reply, f"{session} {t[session]}, {entity} {t[entity]}, fingerprint string, reply string", "fingerprint string", "append", GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout)
