r"""Conversations rebuilt from an event log and rendered for training, in DataFrame expressions only.

Events have ``conv_id, message_id, seq, kind, role, text``.  Kinds: ``open``
starts a message, ``edit`` and ``regenerate`` replace what it says so far,
``delta`` appends, ``delete`` as the last event removes it.  Events fold by
(conversation, message) first, so one long conversation is dealt out over many
tasks until its few final messages meet in its one row.

The template is ``### <role>: <text></turn>\n`` for each message.  In roles and
texts ``\``, ``#`` and ``<`` (in roles ``:`` too) are written ``\b``, ``\h``,
``\l`` (``\c``), so no marker can occur inside a text and the escape is undone
by plain replacement.

Defined cases: null texts and roles count as empty; messages sort by
``message_id`` (null first); an event delivered twice (all its columns equal)
counts once; of different events of equal ``seq`` those that start anew come
first, then they sort by kind and text, and whatever stands before the last one
that starts anew is replaced; null and unknown kinds are treated as ``delta``; an
empty log gives no rows; texts of any length are folded whole; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

END = "</turn>\n"
OPEN = "### "
AFTER_ROLE = ": "
RESETS = ("open", "edit", "regenerate")
DRAFT = 8


def escaped(c: Column, role: bool = False) -> Column:
    for raw, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), *([(":", "\\c")] if role else [])):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for raw, code in ((":", "\\c"), ("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def folded(events: DataFrame) -> DataFrame:
    """One row a message that is not deleted: ``conv_id, message_id, role, text``."""
    e = events.select("conv_id", "message_id", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    starts = F.col("kind").isin(*RESETS)
    one = F.struct("seq", F.when(starts, 0).otherwise(1).alias("rank"), "kind", "text", "role")
    g = e.groupBy("conv_id", "message_id").agg(F.array_sort(F.array_distinct(F.collect_list(one))).alias("log"))
    last = F.array_max(F.transform("log", lambda x, i: F.when(x["rank"] == 0, i).otherwise(-1)))
    g = g.filter(F.element_at("log", -1)["kind"] != "delete").withColumn("last", last)
    live = F.filter("log", lambda x, i: (i >= F.col("last")) & (x["kind"] != "delete"))
    roles = F.filter("log", lambda x: x["role"] != "")
    return g.select("conv_id", "message_id", F.coalesce(F.get(roles, F.size(roles) - 1)["role"], F.lit("")).alias("role"), F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"))


def rendered(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row a conversation: ``conv_id, formatted, loss_spans``.

    A loss span has the turn's number, the span's start in the whole text and
    in the turn, and its length, in code points, over the escaped text of one
    message of role ``trained``.
    """
    role, text = escaped(F.col("role"), role=True), escaped(F.col("text"))
    m = messages.select("conv_id", "message_id", (F.col("role") == trained).alias("loss"), F.concat(F.lit(OPEN), role, F.lit(AFTER_ROLE)).alias("head"), text.alias("body"))
    m = m.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = W.partitionBy("conv_id").orderBy("message_id").rowsBetween(W.unboundedPreceding, -1)
    m = m.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("long"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message_id", "start", "loss", F.length("head").alias("head"), F.length("body").alias("body"), "piece"))).alias("turns"))
    spans = F.transform("turns", lambda x, i: F.struct(x["loss"].alias("loss"), i.alias("turn"), (x["start"] + x["head"]).alias("start"), x["head"].alias("offset"), x["body"].alias("length")))
    return g.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["turn"], x["start"], x["offset"], x["length"])).alias("loss_spans"),
    )


def formatted(events: DataFrame, trained: str = "assistant") -> DataFrame:
    """Event log to rendered conversations."""
    return rendered(folded(events), trained)


def parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``turns`` (role, text) and ``loss_texts`` read back from the rendered text alone."""
    parts = F.split("formatted", END)
    r = rows.withColumn("_parts", F.slice(parts, 1, F.size(parts) - 1))
    at = lambda x: F.locate(AFTER_ROLE, x)
    return r.withColumns({
        "turns": F.transform("_parts", lambda x: F.struct(
            unescaped(F.substr(x, F.lit(len(OPEN) + 1), at(x) - len(OPEN) - 1)).alias("role"),
            unescaped(F.substr(x, at(x) + len(AFTER_ROLE))).alias("text"))),
        "loss_texts": F.transform("loss_spans", lambda s: unescaped(F.substr(F.get(F.col("_parts"), s["turn"]), s["offset"] + 1, s["length"]))),
    }).drop("_parts")


def log_of_turns(turns: DataFrame) -> DataFrame:
    """A table of whole turns (``conv_id, turn, role, text``) as the event log of streamed and revised messages.

    An assistant's message opens with a draft, is regenerated from the first
    half of its text and streams the rest as one delta, delivered twice; any
    other one opens with a draft that an edit replaces.  A draft is at most
    ``DRAFT`` code points of the text, upside down.  Every row is a message of
    its own, repeated rows too; rows of one turn sort by the hash of role and text.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    row = turns.select("conv_id", F.struct("turn", F.xxhash64("role", "text").alias("tie"), F.monotonically_increasing_id().alias("row")).alias("message_id"), "role", text.alias("text"), half.alias("half"))
    draft, rest = F.reverse(F.substr("text", F.lit(1), F.lit(DRAFT))), F.substr("text", F.col("half") + 1)
    event = lambda seq, kind, part: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), part.alias("part"))
    streamed = F.array(event(0, "open", draft), event(1, "regenerate", F.substr("text", F.lit(1), F.col("half"))), event(2, "delta", rest), event(2, "delta", rest))
    edited = F.array(event(0, "open", draft), event(1, "edit", F.col("text")))
    return row.select("conv_id", "message_id", "role", F.inline(F.when(F.col("role") == "assistant", streamed).otherwise(edited))).withColumnRenamed("part", "text")
