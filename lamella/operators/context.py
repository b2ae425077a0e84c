"""What to show of an entity and its surroundings within a token budget.

The target comes first: whole, else its head within seven tenths of the budget,
else its signature; where not even that fits nothing is shown.  Then come direct
dependencies and dependents, whole if they cost no more than the target did (a
tenth of the budget at least) and still fit, else by signature; then what is
further away, by signature alone, 25 of either direction.  Tests are counted
instead of shown unless the target is one.

Defined cases: an unknown target gives no entries; null contents count as empty;
of several roles the first one counts; further entities come by (depth, id),
10,000 of a direction at most, the others are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamella.functions import pieces
from lamella.functions import text as T
from lamella.operators import graph as G
from lamella.storage import cut, dealt, near

ROLES = ("target", "direct_dependency", "direct_dependent", "transitive_dependency", "transitive_dependent")
TRANSITIVE, VISITED = 25, 10_000


def candidates(edges: DataFrame, targets: DataFrame, hops: int = 0) -> DataFrame:
    """``target, id, role, depth`` of each of ``targets`` (``id``) and what it reaches in either direction, each id under its first role.

    Both directions are one traversal each, however many targets there are.
    """
    own = targets.select("id").filter("id is not null").distinct()
    rows = own.select(F.col("id").alias("target"), "id", F.lit(0).alias("role"), F.lit(0).alias("depth"))
    for shift, reverse in ((1, False), (2, True)):
        reach = G.reach_many(edges, own, reverse, hops).filter("start <> id")
        nearest = reach.withColumn("k", F.row_number().over(W.partitionBy("start").orderBy("depth", "id"))).filter(F.col("k") <= VISITED)
        rows = rows.union(nearest.select(F.col("start").alias("target"), "id", F.when(F.col("depth") == 1, shift).otherwise(shift + 2), "depth"))
    first = rows.groupBy("target", "id").agg(F.min(F.struct("role", "depth")).alias("x"))
    return first.select("target", "id", "x.*")


#: What becomes of a candidate.
HEAD, FULL, SIGNATURE, NONE, OMITTED, OMITTED_TEST = 3, 2, 1, 0, -1, -2


def _forms(xs, budget: int):
    """The form of each of a target's sorted candidates: one pass over them that knows what is used up."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("cap"), F.lit(False).alias("of_test"), F.lit(False).alias("begun"), F.lit(0).alias("below"), F.lit(0).alias("above"), F.array().cast("array<int>").alias("forms"))

    def step(acc, x):
        first = x["role"] == 0
        own = F.when(x["full"] <= budget, FULL).when(x["head"].isNotNull(), HEAD).when(x["brief"] <= budget, SIGNATURE).otherwise(NONE)
        test = x["test"] & ~acc["of_test"]
        far, many = x["role"] > 2, F.when(x["role"] == 3, acc["below"]).otherwise(acc["above"]) >= TRANSITIVE
        other = (
            F.when(~acc["begun"], NONE)
            .when(test, OMITTED_TEST)
            .when(far & (many | x["stub"]), OMITTED)
            .when(~far & (x["full"] <= acc["cap"]) & (acc["used"] + x["full"] <= budget), FULL)
            .when(acc["used"] + x["brief"] <= budget, SIGNATURE)
            .otherwise(NONE)
        )
        form = F.when(first, own).otherwise(other)
        cost = F.when(form == FULL, x["full"]).when(form == HEAD, x["head"]).when(form == SIGNATURE, x["brief"]).otherwise(F.lit(0)).cast("long")
        used = acc["used"] + cost
        shown = lambda role, n: n + F.when((x["role"] == role) & (form == SIGNATURE), 1).otherwise(0)
        return F.struct(
            used.alias("used"),
            F.when(first, F.greatest(used, F.lit(budget // 10).cast("long"))).otherwise(acc["cap"]).alias("cap"),
            F.when(first, x["test"]).otherwise(acc["of_test"]).alias("of_test"),
            F.when(first, form != NONE).otherwise(acc["begun"]).alias("begun"),
            shown(3, acc["below"]).alias("below"),
            shown(4, acc["above"]).alias("above"),
            F.concat(acc["forms"], F.array(form)).alias("forms"),
        )

    return F.aggregate(xs, start, step)["forms"]


def packed_many(nodes: DataFrame, edges: DataFrame, targets: DataFrame, budget: int = 8000, hops: int = 0) -> dict[str, DataFrame]:
    """For each of ``targets`` (``id``): ``entries`` (``target, place, entity_id, role, form, tokens, content``) and ``omitted`` (``target, role, entities, tests``).

    A target's candidates, at most two times :data:`VISITED` rows of numbers and ids, are folded in
    their own row; contents join what was chosen afterwards.
    """
    if hops < 0 or budget < 0:
        raise ValueError("hops and budget must not be negative; 0 hops means no limit")
    body = F.coalesce("content", F.lit(""))
    n = cut(nodes.select("id", "name", "file_path", body.alias("content")), "nodes")
    told = dealt(n, "id").select("id", pieces.packer_test(F.col("name"), F.col("file_path"), F.col("content")).alias("test"), pieces.stub_signature(F.col("content")).alias("stub"), T.token_estimate(F.col("content")).alias("full"), T.token_estimate(T.signature(F.col("content"))).alias("brief"))
    told = cut(told, "told")
    most = F.greatest(F.lit(budget * 7 // 10), "brief")
    own = cut(targets.select("id").distinct(), "targets")
    large = cut(near(own).join(told.select("id", "full", "brief"), "id").filter(F.col("full") > budget), "large")
    heads = n.join(near(large), "id")
    heads = cut(heads.select("id", pieces.head(F.col("content"), most).alias("own_head")), "heads")
    c = near(cut(candidates(edges, targets, hops), "candidates")).join(told, "id")
    c = c.join(near(heads).select(F.col("id").alias("target"), T.token_estimate(F.col("own_head")).alias("head")), "target", "left")
    x = F.struct("role", "depth", "id", F.coalesce("test", F.lit(False)).alias("test"), "stub", "full", "brief", "head")
    rows = c.groupBy("target").agg(F.array_sort(F.collect_list(x)).alias("xs")).withColumn("forms", _forms(F.col("xs"), budget))
    rows = cut(rows.select("target", F.arrays_zip(F.col("xs").alias("x"), F.col("forms").alias("form")).alias("zs")), "context")
    role = lambda r: F.element_at(F.array(*map(F.lit, ROLES)), r + 1)
    shown = rows.select("target", F.posexplode(F.filter("zs", lambda z: z["form"] > 0)).alias("place", "z")).select("target", "place", F.col("z.x.id").alias("entity_id"), "z.x.role", "z.form", F.when(F.col("z.form") == FULL, F.col("z.x.full")).when(F.col("z.form") == HEAD, F.col("z.x.head")).otherwise(F.col("z.x.brief")).alias("tokens"))
    named = F.when(F.col("form") == FULL, "full").when(F.col("form") == HEAD, "head").otherwise("signature")
    shown = near(cut(shown, "shown")).join(n.select(F.col("id").alias("entity_id"), "content"), "entity_id").join(near(heads).withColumnRenamed("id", "entity_id"), "entity_id", "left")
    text = F.when(F.col("form") == FULL, F.col("content")).when(F.col("form") == HEAD, F.col("own_head")).otherwise(T.signature(F.col("content")))
    entries = shown.select("target", "place", "entity_id", role(F.col("role")).alias("role"), named.alias("form"), "tokens", text.alias("content"))
    tails = rows.select("target", F.inline(F.filter("zs", lambda z: z["form"] < 0))).groupBy("target", "x.role").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("form") == OMITTED_TEST).alias("tests"))
    return {"entries": entries, "omitted": tails.select("target", role(F.col("role")).alias("role"), "entities", "tests")}


def packed(nodes: DataFrame, edges: DataFrame, target: str, budget: int = 8000, hops: int = 0) -> dict[str, DataFrame]:
    """:func:`packed_many` of one target, its entries in their order."""
    one = edges.sparkSession.range(1).select(F.lit(target).alias("id"))
    got = packed_many(nodes, edges, one, budget, hops)
    return {"entries": got["entries"].drop("target").orderBy("place"), "omitted": got["omitted"].drop("target")}


def as_text(entries: DataFrame) -> DataFrame:
    """``text`` (and ``target``, if ``entries`` has it): the entries one after the other under a line that names them."""
    keys = ["target"] if "target" in entries.columns else []
    one = F.struct("place", F.concat(F.lit("## "), "entity_id", F.lit(" ("), F.replace("role", F.lit("_"), F.lit(" ")), F.lit(")\n"), "content").alias("t"))
    return entries.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n\n").alias("text"))
