"""Tables between the steps of iterative operators, in the folder that driver and executors share.

A step's rows are written below ``spark.checkpoint.dir`` and read back, so the
next step's plan stays short and a lost executor costs a re-read.  Where that
setting is absent a temporary folder is made, for a local master only.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes once they are read, that a side may have to be broadcast: the driver holds them several times over.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32_000_000

_made: list[str] = []
_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="lamella-"))
        base = _local[0]
    return base.rstrip("/") if "://" in base or not base.startswith("/") else "file://" + base.rstrip("/")


def cut(df: DataFrame, label: str = "step", by: str | None = None) -> DataFrame:
    """``df`` written and read back; with ``by`` in a folder for each value of that column, its last, so a filter on it reads its own alone."""
    path = f"{shared_folder(df.sparkSession)}/lamella-steps/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


#: Rows for which a task of :func:`dealt` is worth starting.
TASK_ROWS = 200


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A table of :func:`cut`, dealt by ``keys`` over as many tasks as shuffles have, for work that costs more than its rows are large.

    A table of short rows is one block, or few, so what reads it runs in one task however
    long a row takes; a number that is stated is not folded by adaptive execution.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(most, df.count() // TASK_ROWS)), *keys)


#: Rows that a task is to hold at once in its sorts and sums.
HELD_ROWS = 1_000_000


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // HELD_ROWS))


def parted(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` over a task for each :data:`HELD_ROWS` of its (counted) rows, and no fewer than shuffles have.

    With a number of tasks that stays as it is, what a sort or sum holds in one task grows with the input.
    """
    return df.repartition(_tasks(df.sparkSession, df.count() if rows is None else rows), *keys)


@contextmanager
def shuffles(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written inside shuffles to a task for each :data:`HELD_ROWS` of ``rows``, for sums that are partial before they are dealt."""
    key = "spark.sql.shuffle.partitions"
    was = spark.conf.get(key)
    spark.conf.set(key, str(_tasks(spark, rows)))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def drop(*tables: DataFrame) -> None:
    """Remove tables of :func:`cut` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._cut_at)
        _made.remove(t._cut_at)


def near(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A table of :func:`cut`, hinted for a broadcast if its counted rows are within ``bound`` and their bytes within :data:`BROADCAST_BYTES`, else against one.

    Sizes of compressed files say little: a million ids in a row take a few megabytes there, and
    hundreds in the driver's memory once they are broadcast.
    """
    n = df.count()
    if n > bound or n * _row_bytes(df) > BROADCAST_BYTES:
        return shuffled(df)
    long = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c, t in df.dtypes if t == "string" or "<" in t]
    texts = df.agg(F.sum(sum(long[1:], long[0]))).first()[0] or 0 if long else 0
    return F.broadcast(df) if n * _row_bytes(df) + texts <= BROADCAST_BYTES else shuffled(df)


def _row_bytes(df: DataFrame) -> int:
    """Of a row in a broadcast table, without its texts: its head, key and place, and a word or two a column."""
    return 64 + 16 * len(df.columns)


def shuffled(df: DataFrame) -> DataFrame:
    """A side that grows with the input, joined by a shuffle whatever its files' sizes say."""
    return df.hint("merge")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended first
            break


atexit.register(_clean)
