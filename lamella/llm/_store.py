"""Intermediate tables and files in the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it again, so a lost executor costs a re-read and not a recomputation.
Where that setting is absent one temporary folder is made, for a local master
only: on a cluster executors would each write to a folder of their own.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an explicitly broadcast side may have (two longs a row: 16 MB).
BROADCAST_ROWS = 1_000_000

#: Rows in an Arrow batch: bounds a Python worker's memory with long texts.
BATCH_ROWS = 256

#: Whether a statement's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[str] = []
_fallback: list[str] = []
_cleaning: dict[int, tuple[int, str]] = {}
_lock = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="lamella-"))
        base = _fallback[0]
    return base.rstrip("/") if "://" in base or not base.startswith("/") else "file://" + base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/lamella/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: a batch of long texts must fit a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def _shuffle_cleanup(spark: SparkSession):
    """The session gives up a statement's shuffle files while any write of this module runs in it."""
    key = id(spark)
    with _lock:
        n, before = _cleaning.get(key, (0, spark.conf.get(CLEANUP, "false")))
        _cleaning[key] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _cleaning[key]
            if n > 1:
                _cleaning[key] = n - 1, before
            else:
                del _cleaning[key]
                spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    The shuffle files of the write are given up when it ends: whatever follows reads the table.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with _shuffle_cleanup(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(table: DataFrame) -> None:
    """Remove a table that :func:`materialize` returned and that nothing reads any more."""
    path = table._written_at
    _delete(table.sparkSession, path)
    _made.remove(path)


@contextmanager
def scratch(spark: SparkSession):
    """Removes at its end what was written below it, but for tables that ``keep(table)``, its value, names."""
    before, kept = len(_made), []
    yield lambda table: kept.append(table._written_at)
    for path in [p for p in _made[before:] if p not in kept]:
        _delete(spark, path)
        _made.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_side(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted rows are within ``bound``; else leave the join to shuffle."""
    return F.broadcast(df) if df.count() <= bound else df


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended first
            break


atexit.register(_clean)
