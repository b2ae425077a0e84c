"""The operators bound to the test tables, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, chat_format, filter_audit, fingerprints, hash_ring, jaccard_join, piece_sampling, quality_rules, rans, token_rollups, toxicity, warc_archive, word_runs
from ._store import materialize, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CONTROL = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7, rendered and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(CONTROL).alias("text")) for turn, role in enumerate(("user", "assistant"))]
    extra = spark.range(1).select(F.inline(F.array(*said)))
    rows = chat_format.parsed(chat_format.formatted(chat_format.log_of_turns(turns.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.scored(docs, toxicity.train(docs, labels))
    return out.select("doc_id", (toxicity.fold_of("doc_id") == toxicity.HELD_OUT).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "toxic_spans")


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document's whole text."""
    out = piece_sampling.sampled(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_p", "perturbed", "inclusion", "decoded_same")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four insert batches, one of them stale, its revision, an empty delete and a replay."""
    counts = token_rollups.token_counts(table(spark, sf_dir, "documents"))
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    versions = F.inline(F.array(*[F.struct(F.lit(v).alias("version"), F.col(c).alias("n")) for v, c in (("words-1", "n_words"), ("word_bpe_49k-1", "n_tokens"))]))
    rows = counts.select("source", "lang", F.coalesce(part, F.lit(0)).alias("part"), versions)
    stale = F.floor(F.col("n") / 2).cast("long")
    last = F.col("part") == 3
    change = lambda batch, op, old, new: F.struct(batch.alias("batch"), F.lit(op).alias("op"), old.cast("long").alias("old_tokens"), new.cast("long").alias("new_tokens"))
    changes = rows.select("source", "lang", "version", F.inline(F.filter(F.array(
        change(F.concat(F.lit("insert-"), F.col("part")), "insert", F.lit(None), F.when(last, stale).otherwise(F.col("n"))),
        change(F.when(last, F.lit("revise")), "revise", stale, F.col("n")),
        change(F.when(F.col("part") == 2, F.lit("delete")), "delete", F.col("n"), F.lit(None)),
        change(F.when(F.col("part") == 2, F.lit("again")), "insert", F.lit(None), F.col("n")),
    ), lambda x: x["batch"].isNotNull())))
    sums = materialize(token_rollups.deltas(changes, ("batch",)), "deltas")
    ledger = token_rollups.Ledger(spark, new_path(spark, "ledger"))
    for batch in ("insert-0", "insert-1", "insert-2", "insert-3", "insert-1", "revise", "delete", "again", "revise"):
        ledger.commit(batch, sums.filter(F.col("batch") == batch))
    return ledger.totals()


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edit, of a quarter of all hashes."""
    return fingerprints.with_next(table(spark, sf_dir, "documents"), scale=fingerprints.SCALE).drop("next_doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = quality_rules.judged(docs, keep=["doc_id"])
    return out.select("row.doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    out = warc_archive.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of direct near-duplicate links of all documents."""
    return jaccard_join.jaccard_links(table(spark, sf_dir, "documents"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed."""
    return best_fit.packed_documents(table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as rANS files and read back."""
    return rans.round_trip(table(spark, sf_dir, "documents"))


def op11_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose counts are at most one apart."""
    out = hash_ring.sharded(table(spark, sf_dir, "documents"), law="rows")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, of which a tenth by the checksum of the id is made to repeat itself from a word on."""
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(digest % 10 == 0, words).alias("words"), F.floor(digest / 10).alias("g"))
    n = F.size("words").cast("long")
    docs = docs.withColumn("a", F.when(n > 0, F.col("g") % n))
    docs = docs.withColumn("p", F.floor((n - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    turned = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    out = word_runs.periodic(docs.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(turned, " ")).alias("text")))
    # Lengths and periods are below 2^31, so products are exact.
    better = lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x)
    best = F.when(F.size("runs") > 0, F.aggregate("runs", F.get("runs", F.lit(0)), better))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.*", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all their orders."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("quality_lost", "good_lost")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_chat_formatting, op2_toxicity, op3_piece_sampling, op4_token_counts, op5_fingerprints, op6_quality_rules, op7_warc, op8_jaccard_join, op8_jaccard_links, op9_best_fit, op10_token_ids, op11_hash_ring, op12_word_runs, op13_filter_audit)
    return {f.__name__: f for f in own}


_WORDS = r"list_filter(string_split_regex(coalesce({t}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS chars,
         length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) AS role_chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
       CAST(sum(4 + role_chars + 2 + chars + 8) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, {_WORDS.format(t="text")} AS w FROM documents
), win AS (
  SELECT rid, u.i AS i, w[u.i] || ' ' || w[u.i + 1] || ' ' || w[u.i + 2] AS g
  FROM d, unnest(range(1, len(w) - 1)) AS u(i)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), l AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT d.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n_dup, 0) AS BIGINT) AS n_dup_lines, coalesce(l.n_lines, 0) AS n_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid) LEFT JOIN l USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines AS any_failed
  FROM m
), h AS (
  SELECT source, count(*) AS n, sum(CAST(any_failed AS BIGINT)) AS bad FROM f GROUP BY source
), p AS (
  SELECT count(*) AS hosts, avg(bad / n) AS mu, var_samp(bad / n) AS v FROM h
), q AS (
  SELECT mu, CASE WHEN hosts < 2 THEN 2.0 WHEN coalesce(v, 0) = 0 THEN 1e6 ELSE least(1e6, greatest(2.0, mu * (1 - mu) / v - 1)) END AS s FROM p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (h.bad + q.mu * q.s) / (h.n + q.s) <= 0.8 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, q
"""

OP7_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM r
"""

OP8_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(t="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[u.i:u.i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

OP13_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS.format(t="text")} AS w FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS bad
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), o AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || substr('ABCDE', CAST(k AS INTEGER), 1) FROM o, unnest(range(1, 6)) AS u(k) WHERE length(filter_order) < 5 AND NOT contains(filter_order, substr('ABCDE', CAST(k AS INTEGER), 1))
), s AS (
  SELECT filter_order, k AS step, ascii(filter_order[k]) - 64 AS own, [ascii(x) - 64 FOR x IN string_split(filter_order[1:k - 1], '') IF x <> ''] AS before
  FROM o, unnest(range(1, 6)) AS u(k) WHERE length(filter_order) = 5
), g AS (
  SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, bad
), r AS (
  SELECT part, filter_order, step, own, n, good, toxic, bad[own] AS fails, len(list_filter(before, lambda j: bad[j])) = 0 AS met, len(list_filter(bad, lambda x: x)) = 1 AS lone
  FROM g, s
), c AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (met AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (met AND fails), 0) AS removed,
         coalesce(sum(n) FILTER (NOT met AND fails), 0) AS redundant, coalesce(sum(n) FILTER (fails AND lone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (met AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (met AND fails), 0) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op6_quality_rules": OP6_SQL, "op7_warc": OP7_SQL, "op8_jaccard_join": OP8_SQL, "op13_filter_audit": OP13_SQL}
