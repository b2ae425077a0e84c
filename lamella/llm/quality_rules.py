"""Host-level quality rules, in DataFrame expressions only.

Each document is measured against four rules; failures are summed by host,
the failing rates are shrunk towards a beta prior fitted to all hosts by
moments, and each host's verdict is joined back to its documents.

The join is a broadcast while the counted hosts are at most ``HOSTS``; beyond
that both sides are shuffled and adaptive execution splits a hot host.

Defined cases: a null text counts as empty (no words, hence failed); null hosts
form one host of their own; an empty table gives an empty result; repeated rows
and ties are measured one by one and all kept or all not; a text of any length
is measured whole in its row; the input's columns stay in one struct, so none
of their names can clash with a measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINES_PERCENT = 50
MAX_HOST_RATE = 0.8
HOSTS = 200_000
STRENGTH = (2.0, 1e6)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, all unless given), ``host``, the measures and the rules' flags.

    Windows of three words are compared by a 64-bit hash and their position:
    the array of (hash, position) is sorted, neighbours with equal hashes are
    repeats, and the words under them are counted from the gaps between their
    positions.  Everything stays in the document's own row, so nothing is
    shuffled.  ``mark`` is a row number that filters have to read as well: without
    it the optimizer moves them below the measures and computes these for every
    word anew.
    """
    col = lambda c: F.col(f"`{c}`")
    d = docs.select(F.struct(*[col(c) for c in (docs.columns if keep is None else keep)]).alias("row"), col(host).alias("host"), F.coalesce(col(text), F.lit("")).alias("t"))
    d = d.withColumn("w", F.array_remove(F.split("t", SPACES), ""))
    n = F.size("w")
    word = lambda i: F.get(F.col("w"), i)
    d = d.withColumn("s", F.sort_array(F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, word(i + 1), word(i + 2)).alias("h"), i.alias("i")))))
    hash_at = lambda k: F.get(F.col("s"), k)["h"]
    twice = F.filter("s", lambda x, k: (x["h"] == hash_at(k - 1)) | (x["h"] == hash_at(k + 1)))
    d = d.withColumn("p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    gaps = F.zip_with(F.col("p"), F.slice("p", 2, F.size("p")), lambda a, b: F.least(F.lit(3), b - a))
    d = d.withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        "row",
        "host",
        F.monotonically_increasing_id().alias("mark"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
    )
    return d.withColumns({
        "short": F.col("n_words") < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"),
        "dup": 100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col("n_lines"),
    }).withColumns({
        "base_failed": F.col("short") | F.col("repetitive"),
        "any_failed": F.col("short") | F.col("repetitive") | F.col("symbols") | F.col("dup"),
    })


def host_table(scored: DataFrame) -> DataFrame:
    """One row a host: documents, failures of each rule and of any rule."""
    count = lambda x: F.sum(F.col(x).cast("long"))
    return scored.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *[count(x).alias(f"host_{x}") for x in ("short", "repetitive", "symbols", "dup", "any_failed")])


def beta_prior(hosts: DataFrame) -> tuple[int, float, float]:
    """Number of hosts, and the beta prior whose mean and variance are those of the hosts' rates."""
    rate = F.col("host_any_failed") / F.col("docs")
    n, mean, var = hosts.agg(F.count(F.lit(1)), F.avg(rate), F.var_samp(rate)).first()
    if not n:
        return 0, 1.0, 1.0
    low, high = STRENGTH
    strength = low if n < 2 else high if not var else min(high, max(low, mean * (1 - mean) / var - 1))
    return n, mean * strength, (1 - mean) * strength


def with_verdict(scored: DataFrame, hosts: DataFrame, max_host_rate: float) -> DataFrame:
    """``scored`` with its host's shrunk ``host_rate`` and ``kept``."""
    n, a, b = beta_prior(hosts)
    hosts = hosts.select(F.col("host").alias("own"), ((F.col("host_any_failed") + F.lit(a)) / (F.col("docs") + F.lit(a + b))).alias("host_rate"))
    if n <= HOSTS:
        hosts = F.broadcast(hosts)
    kept: Column = (F.col("mark") >= 0) & ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)
    return scored.join(hosts, F.col("host").eqNullSafe(F.col("own")), "left").withColumn("kept", kept).drop("own", "mark")


def judged(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as ``row`` (columns ``keep``, all but the text unless given), ``host``, measures, flags, ``host_rate`` and ``kept``.

    The measures are written once to the shared folder, without the text, so
    that the sums by host and the join both read them instead of measuring twice.
    """
    scored = materialize(measured(docs, text, host, [c for c in docs.columns if c != text] if keep is None else keep), "quality")
    return with_verdict(scored, host_table(scored), max_host_rate)


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``.

    Only the hosts' sums are written.  The rows themselves are read and
    measured once for the sums and once for the verdict, which costs less than
    writing every text again and leaves nothing behind.
    """
    scored = measured(docs, text, host)
    hosts = materialize(host_table(scored), "hosts")
    return with_verdict(scored, hosts, max_host_rate).filter("kept").select("row.*")
