"""One-to-one matching of the entities of two snapshots, and the change rows that follow.

Entities have ``id, file_path, entity_type, name, parent_id, content,
content_hash, structural_hash, start_line, end_line``.  Phases, each over what
the ones before left: equal ids; equal content hash, then equal structural hash;
equal file, type, name and ancestors; equal type, name and ancestors in another
file; similar words within a type.  What is left was deleted or added; unchanged
entities that lost their place in their file are reordered.

Where one side offers several partners the choice is greedy along a total order
of the candidate pairs.  It is made in rounds of DataFrame steps: a pair that is
the first one of both its entities is taken and pairs of taken entities leave;
what is left after a few rounds is gone through by components, one in a task.

Defined cases: of rows that repeat an id the last by (file, line, content) counts;
null hashes match nothing; null contents count as empty; null parents, names and
files equal each other; empty sides give only additions or deletions; further
columns are ignored, whatever their names; ties end at the id.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.functions import text as T
from lamella.operators import similarity
from lamella.operators.diff import COMPOUND, longest_non_decreasing
from lamella.storage import cut, drop

FIELDS = ("id", "file_path", "entity_type", "name", "parent_id", "content", "content_hash", "structural_hash", "start_line", "end_line")
SAME_FILE_LEAST = 0.3
FUZZY_PERCENT = 80
#: Kinds of entities that hold others.
CONTAINERS = ("impl", "trait", "module", "class", "interface", "protocol", "mixin", "extension", "namespace", "export", "package", "field", "variable", "svelte_instance_script", "svelte_module_script", "object")


def _open_chains(entities: DataFrame) -> DataFrame:
    """``id, names, next, at``: an entity's parent as the begin of its chain; ``at`` is null where the chain ends."""
    e = entities.select("id", "parent_id", "name")
    known = e.select(F.col("id").alias("up"), F.col("name").alias("up_name"), F.col("parent_id").alias("next"))
    has = F.col("up").isNotNull()
    return e.join(known, F.col("parent_id") == F.col("up"), "left").select("id", F.when(F.coalesce("up_name", F.lit("")) != "", F.array("up_name")).otherwise(F.array().cast("array<string>")).alias("names"), F.when(has, F.col("next")).alias("next"), F.when(has, F.col("up")).alias("at"))


def circles(entities: DataFrame) -> DataFrame:
    """``id`` of the entities that are their own ancestors.

    Whoever stands where an entity's chain is after as many steps as there are entities
    is in a circle, and every one in a circle stands there for another.
    """
    n, steps = entities.count(), 1
    at = cut(entities.select("id", F.col("parent_id").alias("at")).filter("at is not null"), "circles")
    while steps < n:
        far = at.select(F.col("id").alias("at"), F.col("at").alias("beyond"))
        grown = cut(at.join(far, "at").select("id", F.col("beyond").alias("at")), "circles")
        drop(at)
        at, steps = grown, steps * 2
        if at.isEmpty():
            break
    return at.select(F.col("at").alias("id")).distinct()


def parent_chains(entities: DataFrame) -> DataFrame:
    """``id, parent_name``: the names of the ancestors, outermost first, joined by ``::``; null without ancestors.

    Chains grow by doubling: each round joins every open chain with the chain of
    the ancestor that it ends at.  Entities in a circle count as outermost; circles are looked for when chains
    are longer than nested texts make them.
    """
    chain, steps = cut(_open_chains(entities), "chains"), 1
    while not chain.filter("at is not null").isEmpty():
        if steps == 64:
            loops = cut(circles(entities), "circles")
            if not loops.isEmpty():
                cut_off = entities.select("id", "parent_id", "name").join(loops.withColumn("loop", F.lit(True)), "id", "left")
                return parent_chains(cut(cut_off.select("id", F.when(F.col("loop").isNull(), F.col("parent_id")).alias("parent_id"), "name"), "entities"))
        far = chain.select(F.col("id").alias("far"), F.col("names").alias("more"), F.col("next").alias("beyond"), F.col("at").alias("far_at"))
        grown = chain.join(far, F.col("at") == F.col("far"), "left")
        grown = cut(grown.select("id", F.concat(F.coalesce("more", F.array().cast("array<string>")), "names").alias("names"), F.col("beyond").alias("next"), F.col("far_at").alias("at")), "chains")
        drop(chain)
        chain, steps = grown, steps * 2
    return chain.select("id", F.when(F.size("names") > 0, F.array_join("names", "::")).alias("parent_name"))


def depths(entities: DataFrame) -> DataFrame:
    """``id, depth``: how many ancestors an entity has, 0 for outermost ones."""
    names = entities.select("id", "parent_id", F.concat(F.lit("x"), F.col("id")).alias("name"))
    return parent_chains(names).select("id", F.when(F.col("parent_name").isNull(), F.lit(0)).otherwise(F.size(F.split("parent_name", "::x"))).cast("long").alias("depth"))


def _side(entities: DataFrame, x: str) -> DataFrame:
    """One row an id: ``id``, the entity as struct ``x``, its order ``x_at`` and its ancestors ``x_up``."""
    has = set(entities.columns)
    e = entities.select(*[F.col(c) if c in has else F.lit(None).cast("string").alias(c) for c in FIELDS])
    last = F.row_number().over(W.partitionBy("id").orderBy(F.desc("file_path"), F.desc("start_line"), F.desc("content")))
    e = cut(e.withColumn("k", last).filter("k = 1").drop("k"), "side")
    chains = parent_chains(e) if not e.filter("parent_id is not null").isEmpty() else e.select("id", F.lit(None).cast("string").alias("parent_name"))
    e = e.join(chains, "id", "left")
    return e.select("id", F.struct(*FIELDS).alias(x), F.struct("file_path", "start_line", "id").alias(f"{x}_at"), F.col("parent_name").alias(f"{x}_up"))


#: Rounds that take whatever is first for both sides, before what is left is put together by components.
ROUNDS = 3
#: Pairs of a component that one task goes through in order.
COMPONENT = 500_000


def greedy(pairs: DataFrame, order: list[Column]) -> DataFrame:
    """The pairs (``a_id, b_id``, ...) that going through them in ``order`` would take, each id once.

    A round takes pairs that are the first of both their ids, which settles short
    chains; a chain of pairs may take as many rounds as it is long.  So after a few rounds the
    components of what is left are found, and one task goes through a
    component's pairs in order.  Components over :data:`COMPONENT` pairs go on in rounds.
    """
    ranked = pairs.select("a_id", "b_id", F.struct(*[o.alias(f"r{i}") for i, o in enumerate(order)], "a_id", "b_id").alias("rank"))
    left, taken, rounds = cut(ranked, "pairs"), [], 0
    while not left.isEmpty():
        if rounds == ROUNDS:
            whole = cut(_components(left), "components")
            small = whole.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= COMPONENT).select("component")
            own = whole.join(small, "component", "left_semi")
            kinds = {f.name: f.dataType.simpleString() for f in left.schema}
            taken.append(cut(own.groupBy("component").applyInPandas(_in_order, f"a_id {kinds['a_id']}, b_id {kinds['b_id']}"), "won"))
            rest = cut(whole.join(small, "component", "left_anti").select("a_id", "b_id", "rank"), "pairs")
            drop(left, whole)
            left, rounds = rest, rounds + 1
            continue
        firsts = left.withColumn("fa", F.min("rank").over(W.partitionBy("a_id"))).withColumn("fb", F.min("rank").over(W.partitionBy("b_id")))
        won = cut(firsts.filter((F.col("rank") == F.col("fa")) & (F.col("rank") == F.col("fb"))).select("a_id", "b_id"), "won")
        rest = cut(left.join(won.select("a_id"), "a_id", "left_anti").join(won.select("b_id"), "b_id", "left_anti"), "pairs")
        drop(left)
        taken, left, rounds = [*taken, won], rest, rounds + 1
    if not taken:
        return pairs.select("a_id", "b_id").limit(0)
    out = taken[0]
    for won in taken[1:]:
        out = out.union(won)
    out = cut(out, "taken")
    drop(*taken)
    return out


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    order = sorted(range(len(pdf)), key=lambda i: _sortable(pdf["rank"].iat[i]))
    a_used, b_used, out = set(), set(), []
    for a, b, i in zip(pdf["a_id"].iloc[order], pdf["b_id"].iloc[order], order):
        if a not in a_used and b not in b_used:
            a_used.add(a)
            b_used.add(b)
            out.append(i)
    return pdf.iloc[out][["a_id", "b_id"]]


def _sortable(x):
    """A rank's parts in Spark's order: nulls first."""
    if isinstance(x, dict):
        x = list(x.values())
    if isinstance(x, (tuple, list)):
        return tuple(_sortable(y) for y in x)
    return (x is not None and x == x, x if x is not None and x == x else 0)


def _components(pairs: DataFrame) -> DataFrame:
    """``pairs`` with their ``component``, the least of its ids.

    In a round each id takes the least label next to it, hands that on to the id that its
    former label names, and follows its new label one step, which halves ways.
    """
    one = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).cast("string").alias("id"))
    both = cut(pairs.select("a_id", "b_id", "rank", one(0, "a_id").alias("u"), one(1, "b_id").alias("v")), "ends")
    edges = both.select("u", "v").union(both.select(F.col("v"), F.col("u")))
    labels = cut(edges.select("u", F.col("u").alias("label")).distinct(), "labels")
    while True:
        beside = edges.join(labels.select(F.col("u").alias("v"), F.col("label").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        least = cut(labels.join(beside, "u").select("u", "label", F.least("label", "other").alias("least")), "labels")
        told = least.groupBy(F.col("label").alias("u")).agg(F.min("least").alias("told"))
        known = cut(least.join(told, "u", "left").select("u", "label", F.least("least", F.coalesce("told", "least")).alias("next")), "labels")
        ahead = known.select(F.col("u").alias("next"), F.col("next").alias("then"))
        grown = cut(known.join(ahead, "next").select("u", F.col("label").alias("was"), F.col("then").alias("label")), "labels")
        settled = grown.filter("was <> label").isEmpty()
        drop(labels, least, known)
        labels = grown
        if settled:
            break
    return both.join(labels.select("u", "label"), "u").select("a_id", "b_id", "rank", F.col("label").alias("component"))


def _sides(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    return cut(_side(before, "b"), "before"), cut(_side(after, "a"), "after")


def _same_ids(b: DataFrame, a: DataFrame) -> DataFrame:
    return b.join(a, "id").select("b", "a", "b_up", "a_up", F.lit(1).alias("phase"))


def by_id(before: DataFrame, after: DataFrame) -> DataFrame:
    """The pairs of the first phase alone, as :func:`matched` has them: all that :func:`reordered_ids` looks at."""
    return _same_ids(*_sides(before, after))


def matched(before: DataFrame, after: DataFrame, score: Callable[[Column, Column], Column] = T.similarity) -> DataFrame:
    """``phase, b, a, b_up, a_up`` of every pair (phases 1 to 5), and of what has no partner (phase 0, ``b`` or ``a`` null).

    ``score`` gives the similarity of two contents, from 0 to 1.  In phase 5 it judges the
    pairs whose words are alike.
    """
    b, a = _sides(before, after)
    out = _same_ids(b, a)
    b_all, a_all = b, a
    b, a = cut(b_all.join(a_all.select("id"), "id", "left_anti")), cut(a_all.join(b_all.select("id"), "id", "left_anti"))
    found = []

    def take(pairs: DataFrame, phase: int) -> None:
        nonlocal a, b
        pairs = cut(pairs.select("a_id", "b_id").withColumn("phase", F.lit(phase)), "matched")
        found.append(pairs)
        a = cut(a.join(pairs.select(F.col("a_id").alias("id")), "id", "left_anti"))
        b = cut(b.join(pairs.select(F.col("b_id").alias("id")), "id", "left_anti"))

    def ranked(digest: str, newest: bool) -> DataFrame:
        k = lambda x, at: F.row_number().over(W.partitionBy(f"{x}.{digest}").orderBy(at))
        x = b.filter(F.col(f"b.{digest}").isNotNull()).select(F.col(f"b.{digest}").alias("h"), F.col("id").alias("b_id"), k("b", F.desc("b_at") if newest else F.asc("b_at")).alias("k"))
        y = a.filter(F.col(f"a.{digest}").isNotNull()).select(F.col(f"a.{digest}").alias("h"), F.col("id").alias("a_id"), k("a", F.asc("a_at")).alias("k"))
        return x.join(y, ["h", "k"])

    def alike(*fields: str) -> DataFrame:
        same = F.col("b_up").eqNullSafe(F.col("a_up"))
        for f in fields:
            same = same & F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}"))
        body = lambda x: F.coalesce(F.col(f"{x}.content"), F.lit(""))
        return b.withColumnRenamed("id", "b_id").join(a.withColumnRenamed("id", "a_id"), same).withColumn("score", score(body("b"), body("a")))

    take(ranked("content_hash", True), 2)
    take(ranked("structural_hash", False), 2)
    near = F.abs(F.col("b.start_line") - F.col("a.start_line"))
    take(greedy(alike("file_path", "entity_type", "name").filter(F.col("score") >= SAME_FILE_LEAST).select("a_id", "b_id", "score", near.alias("far"), "b_at", "a_at"), [-F.col("score"), F.col("far"), F.col("b_at"), F.col("a_at")]), 3)
    by_after = [F.col("a_at"), -F.col("score"), F.col("b_at")]
    other_file = alike("entity_type", "name").filter(~F.col("b.file_path").eqNullSafe(F.col("a.file_path")))
    take(greedy(other_file.select("a_id", "b_id", "score", "a_at", "b_at"), by_after), 4)
    words = b.select(F.struct(F.lit(0).alias("s"), "id").alias("k"), F.lit(0).alias("s"), "b.content", "b.entity_type").union(a.select(F.struct(F.lit(1).alias("s"), "id"), F.lit(1), "a.content", "a.entity_type"))
    if not b.isEmpty() and not a.isEmpty():
        close = similarity.candidates(words, "k", "content", "entity_type", FUZZY_PERCENT, side="s")
        close = close.select(F.col("a.id").alias("b_id"), F.col("b.id").alias("a_id"), (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("score"))
        close = close.join(b.select(F.col("id").alias("b_id"), "b_at"), "b_id").join(a.select(F.col("id").alias("a_id"), "a_at"), "a_id")
        if score is not T.similarity:
            bodies = lambda d, x: d.select(F.col("id").alias(f"{x}_id"), F.coalesce(F.col(f"{x}.content"), F.lit("")).alias(f"{x}_body"))
            close = close.drop("score").join(bodies(b, "b"), "b_id").join(bodies(a, "a"), "a_id").withColumn("score", score(F.col("b_body"), F.col("a_body"))).drop("b_body", "a_body")
            close = close.filter(F.col("score") >= FUZZY_PERCENT / 100)
        take(greedy(close, by_after), 5)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    whole = pairs.join(b_all.withColumnRenamed("id", "b_id"), "b_id").join(a_all.withColumnRenamed("id", "a_id"), "a_id").select("b", "a", "b_up", "a_up", "phase")
    none = lambda x, like: F.lit(None).cast(like.schema[x].dataType).alias(x)
    gone = b.select("b", none("a", a_all), "b_up", none("a_up", a_all), F.lit(0).alias("phase"))
    new = a.select(none("b", b_all), "a", none("b_up", b_all), "a_up", F.lit(0).alias("phase"))
    return out.union(whole).union(gone).union(new)


def reordered_ids(pairs: DataFrame) -> DataFrame:
    """``id`` of unchanged entities outside a longest run of their file that kept its order.

    A file's entities meet in one task as four columns; nothing else does.
    """
    same = pairs.filter((F.col("phase") == 1) & F.col("b.content_hash").eqNullSafe(F.col("a.content_hash")) & F.col("b.file_path").eqNullSafe(F.col("a.file_path")))
    rows = same.select(F.col("a.file_path").alias("file"), F.col("a.id").alias("id"), F.col("b.start_line").alias("was"), F.col("a.start_line").alias("now"))
    moved = rows.withColumn("least", F.max("now").over(W.partitionBy("file").orderBy("was", "id").rowsBetween(W.unboundedPreceding, -1)))
    torn = moved.filter(F.col("now") < F.col("least")).select("file").distinct()

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["was", "id"], ignore_index=True)
        kept = longest_non_decreasing(pdf["now"].tolist())
        return pdf.loc[[i for i in range(len(pdf)) if i not in kept], ["id"]]

    return rows.join(torn, "file", "left_semi").groupBy("file").applyInPandas(work, "id string")


def structural_change(b: Column, a: Column, both: Column) -> Column:
    """False for equal structure, true for another, null where it isn't known; true for one-sided rows."""
    known = b.isNotNull() & a.isNotNull()
    return F.when(~both, F.lit(True)).when(known, b != a)


CHANGE_FIELDS = ("id", "entity_id", "change_type", "entity_type", "entity_name", "entity_line", "start_line", "end_line", "old_start_line", "old_end_line", "parent_name", "file_path", "old_entity_name", "old_file_path", "old_parent_id", "before_content", "after_content", "commit_sha", "author", "structural_change")


def changes(before: DataFrame, after: DataFrame, score: Callable[[Column, Column], Column] = T.similarity, commit_sha: str | None = None, author: str | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """The change rows (:data:`CHANGE_FIELDS` and ``phase``) between two snapshots.

    Deleted rows show the former side; reordered rows carry no contents; pairs
    that differ in nothing but an id's qualifier give no row.
    """
    pairs = cut(matched(before, after, score), "pairs") if pairs is None else pairs
    moved = reordered_ids(pairs).select(F.col("id").alias("moved_id")).withColumn("reordered", F.lit(True))
    p = pairs.join(moved, F.col("a.id") == F.col("moved_id"), "left")
    differs = lambda f: ~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}"))
    kind = F.when(differs("file_path") | differs("parent_id"), "moved").when(differs("entity_type") | differs("name"), "renamed").otherwise("modified")
    same_content = ~differs("content_hash")
    bare = same_content & ~differs("name") & ~differs("file_path") & ~differs("parent_id")
    t = (
        F.when(F.col("a").isNull(), "deleted")
        .when(F.col("b").isNull(), "added")
        .when((F.col("phase") == 1) & same_content, F.when(F.col("reordered"), "reordered"))
        .when(F.col("phase") == 1, "modified")
        .when((F.col("phase") == 3) & same_content, F.lit(None))
        .when(F.col("phase").isin(2, 5) & bare, F.lit(None))
        .otherwise(kind)
    )
    p = p.withColumn("t", t).filter("t is not null")
    own = lambda f: F.when(F.col("a").isNotNull(), F.col(f"a.{f}")).otherwise(F.col(f"b.{f}"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    old = lambda f: F.when(both & differs(f), F.col(f"b.{f}"))
    bodies = F.col("t") != "reordered"
    return p.select(
        F.concat(F.lit("change::"), own("id")).alias("id"),
        own("id").alias("entity_id"),
        F.col("t").alias("change_type"),
        own("entity_type").alias("entity_type"),
        own("name").alias("entity_name"),
        own("start_line").alias("entity_line"),
        own("start_line").alias("start_line"),
        own("end_line").alias("end_line"),
        F.col("b.start_line").alias("old_start_line"),
        F.col("b.end_line").alias("old_end_line"),
        F.when(F.col("a").isNotNull(), F.col("a_up")).otherwise(F.col("b_up")).alias("parent_name"),
        own("file_path").alias("file_path"),
        old("name").alias("old_entity_name"),
        old("file_path").alias("old_file_path"),
        old("parent_id").alias("old_parent_id"),
        F.when(bodies, F.col("b.content")).alias("before_content"),
        F.when(bodies, F.col("a.content")).alias("after_content"),
        F.lit(commit_sha).cast("string").alias("commit_sha"),
        F.lit(author).cast("string").alias("author"),
        F.when(bodies, structural_change(F.col("b.structural_hash"), F.col("a.structural_hash"), both)).alias("structural_change"),
        "phase",
    )


def own_text(content: Column, start: Column, children: Column) -> Column:
    """``content`` without its children's lines (structs of ``start_line, end_line``), blank lines and indents left out."""
    ls = F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x, i: F.struct((i + start).alias("n"), F.trim(F.replace(F.replace(x, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))).alias("t")))
    free = F.filter(ls, lambda x: (x["t"] != "") & ~F.exists(F.coalesce(children, F.array()), lambda c: (x["n"] >= c["start_line"]) & (x["n"] <= c["end_line"])))
    return F.array_join(F.transform(free, lambda x: x["t"]), " ")


def suppressed(rows: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Change rows without those of containers whose changed children say all.

    Added and deleted containers with a changed child go; modified ones go if
    their own lines are the same on both sides and their type didn't change.
    The former parent of a moved child goes, and so does a child that moved
    only because its parent was renamed.
    """
    rows = cut(rows, "changes")
    changed = rows.select("entity_id").distinct()
    kid = lambda e: e.filter("parent_id is not null").select("id", F.col("parent_id").alias("pid"), "start_line", "end_line")
    touched = kid(before).union(kid(after)).join(changed, F.col("id") == F.col("entity_id"), "left_semi").select("pid").distinct()
    hold = rows.filter(F.col("change_type").isin("modified", "added", "deleted") & F.col("entity_type").isin(*CONTAINERS)).join(touched, F.col("entity_id") == F.col("pid"), "left_semi")

    def own(e: DataFrame, x: str) -> DataFrame:
        kids = kid(e).groupBy("pid").agg(F.collect_list(F.struct("start_line", "end_line")).alias("kids"))
        e = e.join(hold.select("entity_id"), F.col("id") == F.col("entity_id"), "left_semi").join(kids, F.col("id") == F.col("pid"), "left")
        return e.select(F.col("id").alias("entity_id"), F.col("entity_type").alias(f"{x}_type"), own_text(F.col("content"), F.col("start_line"), F.col("kids")).alias(f"{x}_own"))

    sides = hold.select("entity_id", "change_type").join(own(before, "b"), "entity_id", "left").join(own(after, "a"), "entity_id", "left")
    same = (F.col("b_type") == F.col("a_type")) & (F.col("b_own") == F.col("a_own"))
    silent = sides.filter((F.col("change_type") != "modified") | F.coalesce(same, F.lit(False))).select("entity_id")
    left = rows.filter("change_type = 'moved' and old_parent_id is not null").select(F.col("old_parent_id").alias("entity_id")).join(changed, "entity_id", "left_semi")
    kept = cut(rows.join(silent.union(left).distinct(), "entity_id", "left_anti").select(*rows.columns), "changes")
    renamed = kept.filter("change_type = 'renamed' and old_entity_name is not null").select("entity_id", "old_entity_name")
    now = after.select(F.col("id").alias("entity_id"), F.col("entity_type").alias("now_type"), F.col("parent_id").alias("now_parent"))
    was = renamed.join(now, "entity_id")
    same = (before["name"] == was["old_entity_name"]) & (before["entity_type"] == was["now_type"]) & before["parent_id"].eqNullSafe(was["now_parent"])
    parents = before.join(was, same, "left_semi").select(F.col("id").alias("gone_parent")).distinct()
    by_parent = kept.join(parents, kept["old_parent_id"] == parents["gone_parent"], "left")
    drop = (F.col("change_type") == "moved") & F.col("old_entity_name").isNull() & F.col("gone_parent").isNotNull()
    return by_parent.filter(~drop).select(*rows.columns)


def without_cosmetics(rows: DataFrame) -> DataFrame:
    """Change rows but for cosmetic ones; compound cosmetic rows stay without contents."""
    t, cosmetic = F.col("change_type"), F.col("structural_change").eqNullSafe(F.lit(False))
    kept = rows.filter(~cosmetic | t.isin(*COMPOUND))
    blank = lambda c: F.when(~cosmetic, F.col(c)).alias(c)
    return kept.select(*[blank(c) if c in ("before_content", "after_content") else F.col(c) for c in rows.columns])


def changed_content() -> Column:
    """Whether a row's contents differ, both known."""
    return F.coalesce(F.col("before_content") != F.col("after_content"), F.lit(False))


def diff(before: DataFrame, after: DataFrame, score: Callable[[Column, Column], Column] = T.similarity, cosmetics: bool = True, suppress: bool = True, extensions: tuple[str, ...] = (), commit_sha: str | None = None, author: str | None = None) -> DataFrame:
    """The whole comparison: match, assemble rows, drop redundant parents, filter, order by file and line.

    ``extensions`` keeps rows whose file, or former file, ends with one of them.
    """
    rows = changes(before, after, score, commit_sha, author)
    if suppress:
        rows = suppressed(rows, before, after)
    if not cosmetics:
        rows = without_cosmetics(rows)
    if extensions:
        ends = F.lit(False)
        for x in extensions:
            ends = ends | F.col("file_path").endswith(x) | F.coalesce(F.col("old_file_path").endswith(x), F.lit(False))
        rows = rows.filter(ends)
    return rows.orderBy("file_path", "entity_line", "entity_id").withColumn("content_changed", changed_content())
