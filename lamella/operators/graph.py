"""Dependency graphs: edges (``from_entity, to_entity, ref_type``) and traversals over them.

Defined cases: edges with a null end lead nowhere; repeated edges count once;
unknown nodes have no neighbours; an empty graph gives no rows; ties go by id; a
name that very many entities bear has them all in one row of its symbol table,
which is that operator's result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.storage import cut, near, parted, shuffled

EDGE = ("from_entity", "to_entity", "ref_type")


def rank(kind: Column) -> Column:
    """Order of reference types: calls, imports, others."""
    return F.when(kind == "calls", 0).when(kind == "imports", 1).otherwise(2)


def deduplicated(edges: DataFrame, priority: str, seq: str) -> DataFrame:
    """One edge a (from, to): that of the first source by ``priority``, then ``seq``."""
    k = F.row_number().over(W.partitionBy("from_entity", "to_entity").orderBy(priority, seq))
    return edges.withColumn("_k", k).filter("_k = 1").select(*EDGE)


def neighbours(edges: DataFrame, nodes: DataFrame, node: str, reverse: bool = False) -> DataFrame:
    """Direct dependencies of ``node``, or with ``reverse`` its direct dependents, with the nodes' columns."""
    near, far = ("to_entity", "from_entity") if reverse else ("from_entity", "to_entity")
    ids = edges.filter(F.col(near) == node).select(F.col(far).alias("id")).distinct()
    return nodes.join(ids, "id", "left_semi")


def reach(edges: DataFrame, start: DataFrame, reverse: bool = True, depth: int = 0, most: int = 0) -> DataFrame:
    """``id, depth`` of all nodes within ``depth`` steps of ``start`` (column ``id``), the start left out.

    A step joins only the frontier, which is broadcast while its counted rows
    are few, with the edges, drops what was visited and writes the new frontier
    to the shared folder, so plans stay short and nothing is held in memory.
    ``depth`` 0 means no limit.  ``most`` stops after the first that many nodes
    by (depth, id).  Null ends and loops are left out; unknown starts reach
    nothing; repeated edges count once.
    """
    near_end, far = ("to_entity", "from_entity") if reverse else ("from_entity", "to_entity")
    e = edges.select(F.col(near_end).alias("id"), F.col(far).alias("next")).filter("id <> next")
    e = e if depth == 1 else cut(e, "links")
    seen = cut(start.select("id", F.lit(0).alias("depth")).filter("id is not null").distinct(), "front")
    front, step, found = seen, 0, 0
    while not depth or step < depth:
        step += 1
        new = e.join(near(front.select("id")), "id").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = cut(new.withColumn("depth", F.lit(step)), "front")
        n = front.count()
        if not n:
            break
        seen, found = seen.union(front), found + n
        if most and found > most:
            break
    out = seen.filter("depth > 0")
    return out.orderBy("depth", "id").limit(most) if most else out


def reach_many(edges: DataFrame, starts: DataFrame, reverse: bool = True, depth: int = 0) -> DataFrame:
    """``start, id, depth`` of all nodes within ``depth`` steps of each of ``starts`` (column ``id``), from one traversal.

    Starts are bits of 64-bit words: a node holds a word for each 64 starts that some of
    reach it, a step hands the words on and joins what meets at a node by OR, before the
    shuffle already, and only bits that a node did not have go on.  A step costs one pass over
    the links, however many starts there are.  ``depth`` 0 means no limit.  Null ends and loops are left out;
    unknown starts reach nothing; a start's own circle is not a row; repeated edges and starts count once.
    """
    near_end, far = ("to_entity", "from_entity") if reverse else ("from_entity", "to_entity")
    e = cut(edges.select(F.col(near_end).alias("id"), F.col(far).alias("next")).filter("id <> next"), "links")
    e = cut(parted(e, "id", "next").distinct(), "links")
    own = cut(starts.select("id").filter("id is not null").distinct(), "starts")
    own = cut(own.withColumn("n", F.monotonically_increasing_id()).select("id", F.expr("shiftright(n, 6)").alias("block"), (F.col("n") % 64).cast("int").alias("bit")), "starts")
    front = cut(own.select("id", "block", F.expr("shiftleft(1L, bit)").alias("bits"), F.lit(0).alias("depth")), "front")
    seen, found, step = front, [], 0
    while not depth or step < depth:
        step += 1
        links = e.join(near(front.select("id", "block", "bits")), "id").groupBy(F.col("next").alias("id"), "block").agg(F.bit_or("bits").alias("bits"))
        had = seen.groupBy("id", "block").agg(F.bit_or("bits").alias("had"))
        new = links.join(shuffled(had), ["id", "block"], "left").withColumn("bits", F.expr("bits & ~coalesce(had, 0L)"))
        front = cut(new.filter("bits <> 0").select("id", "block", "bits", F.lit(step).alias("depth")), "front")
        if front.isEmpty():
            break
        found.append(front)
        seen = seen.union(front)
    if not found:
        return own.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).limit(0)
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    bits = rows.select("id", "block", "depth", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) != 0)).alias("bit"))
    return bits.join(near(own).withColumnRenamed("id", "start"), ["block", "bit"]).select("start", "id", "depth")


def symbol_table(nodes: DataFrame) -> DataFrame:
    """Each name's entities ordered by file, start, end and id."""
    g = nodes.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("file_path", "start_line", "end_line", "id"))).alias("_t"))
    return g.select("name", F.transform("_t", lambda x: x["id"]).alias("ids"))


def among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges whose both ends are in ``ids``."""
    for side in ("from_entity", "to_entity"):
        edges = edges.join(ids.select(F.col("id").alias(side)), side, "left_semi")
    return edges.select(*EDGE)


def cross_repository(edges: DataFrame, nodes: DataFrame, repo: str) -> DataFrame:
    """Edges between nodes of different repositories."""
    a, b = (nodes.select(F.col("id").alias(f"{x}_entity"), F.col(repo).alias(f"{x}_repo")) for x in ("from", "to"))
    return edges.join(a, "from_entity").join(b, "to_entity").filter("from_repo <> to_repo")


def top_relations(edges: DataFrame, most: int = 6) -> DataFrame:
    """The first ``most`` callers of every node by id."""
    k = F.row_number().over(W.partitionBy("to_entity").orderBy("from_entity"))
    return edges.select("to_entity", "from_entity").distinct().withColumn("k", k).filter(F.col("k") <= most)
