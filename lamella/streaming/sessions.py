"""The session ledger as a stream: replies that say what is new, from a bounded memory of what each session was told.

A session keeps the last body of each entity that it saw, bodies over
:data:`upkeep.STORED` bytes by their hash alone, and the order of their use.  Over ``most`` entities the one
that was not used for longest is forgotten, and is told whole when it comes again; nothing is
forgotten by time.  The state is in the store of the query's checkpoint, so a restarted
query goes on where it was.

Defined cases: as :func:`lamella.streaming.upkeep.replies`, whose replies these are
as long as no session holds over ``most`` entities; rows of a session within one batch go by ``order``,
batches one after the other; null sessions are one session, null
entities one entity; an empty stream gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lamella.streaming.upkeep import STORED, line_delta

MOST = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Memory(StatefulProcessor):
    """What one session was told last: entity to (hash, body), and entity to the number of its last use."""

    def __init__(self, most: int = MOST) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getMapState("told", "entity string", "hash string, body string")
        self.used = handle.getMapState("used", "entity string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch.sort_values([c for c in batch.columns if c.startswith("order_")], kind="stable", ignore_index=True)
        used = {k[0]: v[0] for k, v in self.used.iterator()}
        clock = max(used.values(), default=0)
        kinds, told = [], []
        for entity, body in zip(batch["of_entity"], batch["of_body"]):
            entity = "" if entity is None else f"={entity}"
            body = None if body is None or body != body else body
            digest = None if body is None else hashlib.md5(body.encode()).hexdigest()
            last, old = self.told.getValue((entity,)) if entity in used else (None, None)
            delta = line_delta(old, body) if last is not None and digest is not None and digest != last and old is not None else None
            kind = "first" if last is None else "unchanged" if last == digest else "delta" if delta is not None else "full"
            kinds.append(kind)
            told.append("" if kind == "unchanged" else delta if kind == "delta" else body)
            if kind != "unchanged":
                self.told.updateValue((entity,), (digest, body if body is not None and len(body.encode()) <= STORED else None))
            clock += 1
            used[entity] = clock
            self.used.updateValue((entity,), (clock,))
            if len(used) > self.most:
                oldest = min(used, key=used.__getitem__)
                del used[oldest]
                self.told.removeKey((oldest,))
                self.used.removeKey((oldest,))
        yield batch.drop(columns="of_body").assign(of_session=key[0], kind=kinds, told=told)[["of_session", "of_entity", *[c for c in batch.columns if c.startswith("order_")], "kind", "told"]]

    def close(self) -> None:
        pass


def replies_stream(fills: DataFrame, session: str, entity: str, order: list[str], body: str, most: int = MOST) -> DataFrame:
    """``session, entity, *order, kind, told`` of a stream of fills."""
    use_rocksdb(fills.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in fills.schema}
    names = [f"order_{i}" for i in range(len(order))]
    rows = fills.select(F.col(session).alias("of_session"), F.col(entity).cast("string").alias("of_entity"), *[F.col(c).alias(n) for c, n in zip(order, names)], F.col(body).cast("string").alias("of_body"))
    schema = ", ".join([f"of_session {kinds[session]}", "of_entity string", *[f"{n} {kinds[c]}" for c, n in zip(order, names)], "kind string", "told string"])
    out = rows.groupBy("of_session").transformWithStateInPandas(Memory(most), schema, "Append", "None")
    return out.select(F.col("of_session").alias(session), F.col("of_entity").cast(kinds[entity]).alias(entity), *[F.col(n).alias(c) for c, n in zip(order, names)], "kind", "told")


def use_rocksdb(spark: SparkSession) -> None:
    """State of several kinds needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
