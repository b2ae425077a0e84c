"""The session ledger's stream against its batch form, over restarts, and its bound on entities."""

import random

from lamella.streaming import sessions, upkeep

SCHEMA = "s string, e string, o int, b string"


def run(spark, tmp_path, batches, **options):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for rows in batches:  # every batch is a new query on the same checkpoint
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        sessions.replies_stream(stream, "s", "e", ["o"], "b", **options).writeStream.format("parquet").option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return sorted((tuple(r) for r in spark.read.parquet(out).select("o", "s", "e", "kind", "told").collect()), key=str)


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    rng = random.Random(2)
    bodies = ["a\nb\nc", "a\nb\nd", "a\nx\nd\ne", "\n".join(map(str, range(400))), "y" * 70_000, "", None]
    rows = [(rng.choice(["s", "t", None]), rng.choice(["e", "f", None]), i, rng.choice(bodies)) for i in range(120)]
    got = run(spark, tmp_path, [rows[:40], rows[40:90], rows[90:]])
    want = upkeep.replies(spark.createDataFrame(rows, SCHEMA), "s", "e", ["o"], "b").select("o", "s", "e", "kind", "told").collect()
    assert got == sorted((tuple(r) for r in want), key=str)
    assert {r[3] for r in got} == {"first", "unchanged", "delta", "full"}


def test_least_recently_used_is_forgotten(spark, tmp_path):
    rows = [("s", e, i, "x") for i, e in enumerate("abacabd")]
    got = {r[0]: r[3] for r in run(spark, tmp_path, [rows[:3], rows[3:]], most=2)}
    assert [got[i] for i in range(7)] == ["first", "first", "unchanged", "first", "unchanged", "first", "first"]
