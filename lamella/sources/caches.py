"""Tables kept in one SQLite file, and rows of a JSON service.

SQLite files are read on the driver, a chunk at a time; they hold what one
reader's machine holds.  A missing table raises; nulls stay null; empty tables
give no rows with their columns.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = {"INTEGER": "long", "REAL": "double", "TEXT": "string", "BLOB": "binary"}
#: Rows handed over at a time.
CHUNK = 50_000


def sqlite_table(spark: SparkSession, path: str, name: str, columns: list[str] | None = None, where: str | None = None, args: tuple = ()) -> DataFrame:
    """A table's rows, only ``columns`` of them, filtered by SQLite."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        info = db.execute(f'PRAGMA table_info("{name}")').fetchall()
        if not info:
            raise ValueError(f"no table {name}")
        kinds = {r[1]: _KINDS.get(r[2].upper(), "string") for r in info}
        names = columns or list(kinds)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
        listed = ", ".join(f'"{c}"' for c in names)
        cur = db.execute(f'SELECT {listed} FROM "{name}"' + (f" WHERE {where}" if where else ""), args)
        out = spark.createDataFrame([], schema)
        while rows := cur.fetchmany(CHUNK):
            out = out.union(spark.createDataFrame(rows, schema))
        return out


def graph(spark: SparkSession, path: str, topology: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that :func:`lamella.sinks.documents.save_sqlite` wrote; ``topology`` leaves contents out."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [r[1] for r in db.execute('PRAGMA table_info("nodes")')]
    kept = [c for c in names if not (topology and c in ("content", "content_hash", "structural_hash", "metadata"))]
    return sqlite_table(spark, path, "nodes", kept), sqlite_table(spark, path, "edges")


def entities_under(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The listing below a path prefix, by (file, line, id)."""
    rows = sqlite_table(spark, path, "nodes", where='"file_path" >= ? AND "file_path" < ?', args=(prefix, prefix + "\U0010ffff"))
    return rows.orderBy("file_path", "start_line", "id")


def service_rows(spark: SparkSession, fetch: Callable[[str], str], path: str, schema: str, field: str | None = None) -> DataFrame:
    """Rows of a JSON answer: the list at ``field``, or the answer itself.  ``fetch`` maps a path to its text."""
    body = json.loads(fetch(path))
    rows = body if field is None else body.get(field, [])
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
    return text.select(F.from_json("j", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
