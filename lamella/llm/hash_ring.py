"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard stands at ``NODES`` hashed places of a ring.  A key belongs to the
first shard clockwise from its own hash; where that shard is full, it goes on
clockwise to the first one with room.  Keys enter in a fixed order: by bucket
(high bits of a second hash), then by the arc of the ring they fall on, then by a
third hash and by key.  So the outcome of entering them one by one follows
from how many keys each cell, a bucket of an arc, holds: these counts, at most
``shards * NODES * BUCKETS`` of them whatever the input, are all that the
driver sees.  It cuts each cell into stretches for one shard each, and a row
finds its stretch by its rank in its cell.

The load is rows (``law="rows"``) or bytes (``law="bytes"``).  With ``slack`` 0
the capacities add up to the total: shares of rows are then at most one apart.
Bytes stand in a row behind one another in a cell, and a row goes where its first
byte does, so a shard is over or under its share by the rows that lie across
cuts at its ends, at most one for each cut.  A larger ``slack`` lets keys stay nearer
to their first shard, so that fewer move when a shard is added.

Defined cases: null texts have no bytes; a null key has a place of its own;
repeated rows are sharded each and are neighbours; a cell of over ``HOT_ROWS``
rows, which one key may fill, is ranked in parts by the third hash and counts
its equal rows first, with the same result; a table with fewer rows
than shards leaves some shards empty; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize

SHARDS = 40
NODES = 64
BUCKETS = 64
#: Bytes of a row beside its text.
OVERHEAD = 16
#: Rows of a cell from which equal ones are counted before they are ranked, and rows dealt at once after that.
HOT_ROWS = 2_000_000
BLOCK = 100_000
PARTS = 4096
_PLACE, _ORDER, _NODE = 11, 12, 13


class Ring:
    """The places of all shards, and for each arc the shards clockwise from it."""

    def __init__(self, shards: int = SHARDS, nodes: int = NODES) -> None:
        if shards < 1 or nodes < 1:
            raise ValueError("a ring needs a shard and a node")
        self.shards = shards
        places = sorted((xxhash.xxh64_intdigest(f"{s}/{k}", seed=_NODE) - (1 << 63), s) for s in range(shards) for k in range(nodes))
        self.places = np.array([p for p, _ in places], dtype=np.int64)
        self.owners = [s for _, s in places]

    def arcs(self, hashes: np.ndarray) -> np.ndarray:
        """The node clockwise from each hash; past the last one the first."""
        return np.searchsorted(self.places, hashes, side="left") % len(self.places)

    def clockwise(self, arc: int):
        """The shards from an arc on, each once."""
        seen = set()
        for k in range(len(self.owners)):
            s = self.owners[(arc + k) % len(self.owners)]
            if s not in seen:
                seen.add(s)
                yield s


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Loads that shards may take: their even shares, larger by ``slack``."""
    share, more = divmod(total, shards)
    even = [share + (s < more) for s in range(shards)]
    return even if slack <= 0 else [max(x, int(np.ceil(total * (1 + slack) / shards))) for x in even]


def stretches(ring: Ring, loads: dict[int, int], slack: float = 0.0) -> list[tuple[int, int, int, int]]:
    """``(cell, from, shard, before)``: where a stretch of a cell begins, its shard, and the shard's load before it.

    ``loads`` has the load of each cell, a cell being ``bucket * arcs + arc``.
    """
    room = capacities(sum(loads.values()), ring.shards, slack)
    used = [0] * ring.shards
    arcs = len(ring.owners)
    way: dict[int, list[int]] = {}
    out = []
    for cell in sorted(loads):
        left, start = loads[cell], 0
        order = way.get(cell % arcs) or way.setdefault(cell % arcs, list(ring.clockwise(cell % arcs)))
        while left > 0:
            while used[order[0]] >= room[order[0]]:
                del order[0]
            s = order[0]
            n = min(left, room[s] - used[s])
            out.append((cell, start, s, used[s]))
            used[s] += n
            start += n
            left -= n
    return out


def _cell(ring: Ring, buckets: int):
    @F.pandas_udf("int")
    def of(place: pd.Series, order: pd.Series) -> pd.Series:
        bucket = (order.to_numpy().view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return pd.Series((bucket.astype(np.int64) * len(ring.owners) + ring.arcs(place.to_numpy())).astype(np.int32))

    return of


def cells(ring: Ring, key: Column, buckets: int = BUCKETS) -> Column:
    """The cell of a long key."""
    return _cell(ring, buckets)(F.xxhash64(F.lit(_PLACE), key), F.xxhash64(F.lit(_ORDER), key))


def sharded(docs: DataFrame, shards: int = SHARDS, law: str = "rows", slack: float = 0.0, id_col: str = "doc_id", text: str = "text", nodes: int = NODES, buckets: int = BUCKETS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``; slots count a shard's rows from 0 without gaps."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"no law {law!r}")
    ring = Ring(shards, nodes)
    key, body = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    size = F.octet_length(body).cast("long") + F.lit(OVERHEAD)
    load = F.lit(1).cast("long") if law == "rows" else size
    # By rows only the keys are read here.
    sums = docs.select(key.alias("doc_id"), load.alias("load")).select(cells(ring, F.col("doc_id"), buckets).alias("cell"), "load").groupBy("cell").agg(F.sum("load").alias("load"), F.count(F.lit(1)).alias("n")).collect()
    cuts = stretches(ring, {r["cell"]: r["load"] for r in sums}, slack)
    rows = docs.select(key.alias("doc_id"), size.alias("size"), F.crc32(body).alias("text_crc32")).withColumn("cell", cells(ring, F.col("doc_id"), buckets))
    own = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    hot = [r["cell"] for r in sums if r["n"] > hot_rows]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(PARTS)))
    in_order = Window.partitionBy("cell").orderBy("part", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    up_to = Window.unboundedPreceding, Window.currentRow
    plain = rows.filter(~F.col("cell").isin(hot)) if hot else rows
    begin = F.row_number().over(in_order).cast("long") - 1 if law == "rows" else F.sum(own).over(in_order.rowsBetween(*up_to)) - own
    placed = plain.withColumn("begin", begin)
    if hot:
        counted = rows.filter(F.col("cell").isin(hot)).groupBy("cell", "part", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
        total = F.col("n") * own
        parts = counted.groupBy("cell", "part").agg(F.sum(total).alias("whole"))
        parts = parts.select("cell", "part", (F.sum("whole").over(Window.partitionBy("cell").orderBy("part").rowsBetween(*up_to)) - F.col("whole")).alias("before"))
        in_part = Window.partitionBy("cell", "part").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(*up_to)
        first = counted.withColumn("first", F.sum(total).over(in_part) - total).join(parts, ["cell", "part"])
        blocks = first.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))))
        spread = blocks.repartition("cell", "doc_id", "at").withColumn("k", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + BLOCK, F.col("n")) - 1)))
        placed = placed.unionByName(spread.select("doc_id", "size", "text_crc32", "cell", "part", (F.col("before") + F.col("first") + F.col("k") * own).alias("begin")))
    placed = _assigned(placed, cuts)
    return _slotted_by_rows(placed) if law == "rows" else _slotted_by_count(placed)


def _assigned(placed: DataFrame, cuts: list[tuple[int, int, int, int]]) -> DataFrame:
    """The stretch, shard and load before of each row by cell and load before it in its cell."""
    ends = [(c, b) for c, b, _, _ in cuts]
    shard = np.array([s for _, _, s, _ in cuts], dtype=np.int32)
    gap = np.array([before - b for _, b, _, before in cuts], dtype=np.int64)

    @F.pandas_udf("stretch int, shard int, gap long")
    def find(cell: pd.Series, begin: pd.Series) -> pd.DataFrame:
        at = np.fromiter((bisect_right(ends, x) - 1 for x in zip(cell.tolist(), begin.tolist())), dtype=np.int32, count=len(cell))
        return pd.DataFrame({"stretch": at, "shard": shard[at], "gap": gap[at]})

    return placed.withColumn("to", find("cell", "begin")).select("doc_id", "size", "text_crc32", "begin", "to.*")


def _slotted_by_rows(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("gap")).alias("slot"))


def _slotted_by_count(rows: DataFrame) -> DataFrame:
    """Slots where loads are not rows: the stretches' rows are counted first, as many counts as stretches."""
    rows = materialize(rows, "sharded")
    counts = {r["stretch"]: (r["shard"], r["n"]) for r in rows.groupBy("stretch").agg(F.first("shard").alias("shard"), F.count(F.lit(1)).alias("n")).collect()}
    used: dict[int, int] = {}
    before = np.zeros(max(counts, default=0) + 1, dtype=np.int64)
    for k in sorted(counts):
        s, n = counts[k]
        before[k] = used.get(s, 0)
        used[s] = before[k] + n

    @F.pandas_udf("long")
    def start(stretch: pd.Series) -> pd.Series:
        return pd.Series(before[stretch.to_numpy()])

    rank = F.row_number().over(Window.partitionBy("stretch").orderBy("begin")).cast("long") - 1
    return rows.withColumn("rank", rank).select("doc_id", "size", "text_crc32", "shard", (start("stretch") + F.col("rank")).alias("slot"))
