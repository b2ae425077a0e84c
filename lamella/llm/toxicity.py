"""Toxic spans by a linear-chain conditional random field with two states.

Training (driver, numpy) takes a bounded sample of labelled documents.  Words
much more frequent in toxic documents than in others are found first, near
copies left out; they label the tokens of toxic documents, and the chain is
fitted to these labels by gradient ascent on the regularised log-likelihood.
Features of a token are its lower-case form, its first four and six
characters, and a bias; transitions have their own weights.

Scoring runs forward-backward over each whole text and gives every token's
marginal ``p``.  The document's evidence is the sum of ``-log(1 - p)`` over
tokens of at least ``FLOOR`` (each at most ``CAP``), which a logistic curve
fitted to the training documents turns into the score.  Neighbouring tokens of
at least ``TAGGED`` form the offending spans.

Defined cases: null and wordless texts have no evidence and score the curve's
least value; equal texts and repeated rows score equally; texts of any length are
scored whole; input columns may have any names; ties of the sample's order go by
id and text; without labelled documents of both
classes, or a word that tells them apart, every score is 0; an empty table gives no rows; other columns are ignored.  Labels of rows that
disagree count as toxic, null labels are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches
from ._words import mix

#: The bound of the training sample: documents, and code points of the longest one taken.
TRAIN_ROWS = 3000
TRAIN_CHARS = 12_000
THRESHOLD = 0.3
TAGGED = 0.5
FLOOR = 0.05
CAP = 8.0
STEPS = 25
L2 = 0.02
KNOWN = 300_000
SLICE = 1 << 20
FIT_TOKENS = 100_000
#: How much more often toxic documents hold a cue, at least.
RATIO = 4
HELD_OUT = 2

_WORD = re.compile(r"\w+")


def fold_of(id_col: str):
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def slices(text: str, size: int = SLICE):
    """The text in pieces of about ``size`` code points that end before a space."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + size) if at + size < len(text) else -1
        end = len(text) if end < 0 else end
        yield at, text[at:end]
        at = end


@dataclass
class Chain:
    weights: dict[str, float]
    transitions: np.ndarray  # log weights, from row to column
    start: np.ndarray
    curve: tuple[float, float] = (-6.0, 3.0)

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def emission(self, token: str) -> float:
        """Log odds of the toxic state from the token alone."""
        w, t = self.weights, token.lower()
        return w.get("b", 0.0) + w.get("w" + t, 0.0) + w.get("p" + t[:4], 0.0) + w.get("q" + t[:6], 0.0)

    def emissions(self, text: str) -> np.ndarray:
        parts = []
        for _, piece in slices(text):
            tokens = _WORD.findall(piece)
            known = self.known
            fresh = set(tokens).difference(known)
            if len(known) + len(fresh) > KNOWN:
                known.clear()
                fresh = set(tokens)
            for t in fresh:
                known[t] = self.emission(t)
            parts.append(np.fromiter(map(known.__getitem__, tokens), dtype=np.float64, count=len(tokens)))
        return np.concatenate(parts) if parts else np.empty(0)


def marginals(emission: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray, edges: bool = False):
    """Marginals of state 1 of many chains laid end to end; ``first`` marks where one begins.

    A step is a 2 x 2 matrix; one at a chain's beginning forgets what came
    before.  The steps are cut into blocks of equal length: products of all
    blocks advance together, then the blocks' ends are chained, then all
    blocks are swept forward and backward together.
    """
    m = len(emission)
    if not m:
        return (np.empty(0), np.zeros((2, 2))) if edges else np.empty(0)
    size = int(min(512, max(8, math.isqrt(m) // 2)))
    blocks = -(-m // size)
    e = np.exp(np.clip(emission, -30, 30))
    T, s = np.exp(transitions), np.exp(start)
    M = np.empty((4, blocks * size))
    for i, (same, begin) in enumerate(((T[0, 0], s[0]), (T[0, 1], s[1]), (T[1, 0], s[0]), (T[1, 1], s[1]))):
        M[i, :m] = np.where(first, begin, same)
        if i in (1, 3):
            M[i, :m] *= e
    M[:, m:] = np.array([1.0, 0.0, 0.0, 1.0])[:, None]
    M = np.ascontiguousarray(M.reshape(4, blocks, size).transpose(0, 2, 1))
    p = np.zeros((4, blocks))
    p[0] = p[3] = 1.0
    for t in range(size):
        a, b, c, d = M[:, t]
        q = np.stack([p[0] * a + p[1] * c, p[0] * b + p[1] * d, p[2] * a + p[3] * c, p[2] * b + p[3] * d])
        p = q / q.sum(axis=0)
    before, after = np.empty((2, blocks)), np.empty((2, blocks))
    v0 = v1 = 0.5
    P = p.T.tolist()
    for k, (a, b, c, d) in enumerate(P):
        before[0, k], before[1, k] = v0, v1
        v0, v1 = v0 * a + v1 * c, v0 * b + v1 * d
        z = v0 + v1
        v0, v1 = v0 / z, v1 / z
    v0 = v1 = 0.5
    for k in range(blocks - 1, -1, -1):
        after[0, k], after[1, k] = v0, v1
        a, b, c, d = P[k]
        v0, v1 = a * v0 + b * v1, c * v0 + d * v1
        z = v0 + v1
        v0, v1 = v0 / z, v1 / z
    A, B = np.empty((size, 2, blocks)), np.empty((size, 2, blocks))
    x = before
    for t in range(size):
        a, b, c, d = M[:, t]
        x = np.stack([x[0] * a + x[1] * c, x[0] * b + x[1] * d])
        x /= x.sum(axis=0)
        A[t] = x
    y = after
    for t in range(size - 1, -1, -1):
        B[t] = y
        a, b, c, d = M[:, t]
        y = np.stack([a * y[0] + b * y[1], c * y[0] + d * y[1]])
        y /= y.sum(axis=0)
    flat = lambda z: z.transpose(1, 2, 0).reshape(2, -1)[:, :m]
    A, B = flat(A), flat(B)
    joint = A * B
    post = joint[1] / joint.sum(axis=0)
    if not edges:
        return post
    inner = np.flatnonzero(~first)
    W = M.transpose(0, 2, 1).reshape(4, -1)[:, :m][:, inner]
    q = np.stack([A[i, inner - 1] * W[2 * i + j] * B[j, inner] for i in (0, 1) for j in (0, 1)])
    return post, (q / q.sum(axis=0)).sum(axis=1).reshape(2, 2)


def distinct_enough(texts: list[np.ndarray], hashes: np.ndarray) -> list[int]:
    """Places of texts (type numbers of their tokens) that are not near copies of an earlier one, by their eight least hashes of three words."""
    seen: set[int] = set()
    kept = []
    for i, x in enumerate(texts):
        h = hashes[x]
        h = mix(h[:-2] + mix(h[1:-1] + mix(h[2:]))) if len(h) > 2 else mix(h)
        low = np.unique(h)[:8].tolist()
        if sum(v in seen for v in low) * 2 < max(1, len(low)):
            kept.append(i)
            seen.update(low)
    return kept


def cues(token: str) -> tuple[str, str, str]:
    """A token, and its beginnings marked by a hyphen."""
    return token, token[:4] + "-", token[:6] + "-"


def toxic_cues(texts: list[np.ndarray], types: list[str], toxic: np.ndarray) -> set[str]:
    """Words and beginnings of words that toxic documents hold far more often, by a likelihood-ratio test that allows for the number of words tried."""
    pos, neg = Counter(), Counter()
    kept = distinct_enough(texts, np.array([hash_of(t) for t in types], dtype=np.uint64))
    for i in kept:
        (pos if toxic[i] else neg).update({c for t in np.unique(texts[i]).tolist() for c in cues(types[t])})
    n1 = int(toxic[kept].sum())
    n0 = len(kept) - n1
    least = 2 * math.log(max(2, len(pos.keys() | neg.keys())))
    part = lambda k, n, p: (k * math.log(k / (n * p)) if k else 0.0) + ((n - k) * math.log((n - k) / (n * (1 - p))) if n > k else 0.0)

    def ratio(w: str) -> float:
        p = (pos[w] + neg[w]) / (n1 + n0)
        return 2 * (part(pos[w], n1, p) + part(neg[w], n0, p)) if p < 1 else 0.0

    return {w for w, n in pos.items() if n >= 3 and n * n0 >= RATIO * neg[w] * n1 and ratio(w) > least}


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s)


def chunks_of(sizes: np.ndarray, most: int = FIT_TOKENS) -> list[tuple[int, int]]:
    """Ranges of tokens of whole texts, about ``most`` at a time or one text."""
    out, start, end = [], 0, 0
    for n in sizes.tolist():
        if end > start and end + n - start > most:
            out.append((start, end))
            start = end
        end += n
    return [*out, (start, end)] if end > start else out


def fit(texts: list[str], toxic: list[int], steps: int = STEPS, l2: float = L2) -> Chain | None:
    """Fit a chain; ``None`` where one of the classes is missing or no word tells them apart.

    Tokens are kept as type numbers, and marginals are taken of about
    ``FIT_TOKENS`` tokens at a time, which bounds the driver's memory.
    """
    flags = np.array(toxic, dtype=bool)
    index: dict[str, int] = {}
    tokens = [np.array([index.setdefault(w.lower(), len(index)) for w in _WORD.findall(t)], dtype=np.int32) for t in texts]
    types = list(index)
    words = toxic_cues(tokens, types, flags) if flags.any() and not flags.all() else set()
    if not words:
        return None
    ids: dict[str, int] = {"b": 0}
    x = np.concatenate(tokens)
    sizes = np.array([len(ts) for ts in tokens], dtype=np.int64)
    common = np.bincount(x, minlength=len(types))
    feats = np.array([[ids.setdefault(n, len(ids)) if common[i] >= 3 else 0 for n in ("w" + t, "p" + t[:4], "q" + t[:6])] for i, t in enumerate(types)], dtype=np.int64).reshape(-1, 3)
    known = (feats > 0).astype(np.float64)
    cued = np.array([not words.isdisjoint(cues(t)) for t in types])
    y = (cued[x] & np.repeat(flags, sizes)).astype(np.float64)
    first = np.zeros(len(x), dtype=bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    d = len(ids)
    parts = chunks_of(sizes)
    y_edges = np.bincount((2 * y[:-1] + y[1:]).astype(int)[~first[1:]], minlength=4).astype(np.float64)
    y_start = np.array([(1 - y[first]).sum(), y[first].sum()])
    theta = np.zeros(d + 6)
    theta[0] = -4.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    post = np.empty(len(x))
    for step in range(1, steps + 1):
        w, tr, st = theta[:d], theta[d : d + 4].reshape(2, 2), theta[d + 4 :]
        of_word = w[0] + (w[feats] * known).sum(axis=1)
        pair = np.zeros((2, 2))
        for i, j in parts:
            post[i:j], more = marginals(of_word[x[i:j]], first[i:j], tr, st, edges=True)
            pair += more
        gap = y - post
        g = np.zeros_like(theta)
        of_type = np.bincount(x, weights=gap, minlength=len(types))
        g[:d] = np.bincount(feats.ravel(), weights=(known * of_type[:, None]).ravel(), minlength=d)
        g[0] = gap.sum()
        g[d : d + 4] = y_edges - pair.ravel()
        g[d + 4 :] = y_start - np.array([(1 - post[first]).sum(), post[first].sum()])
        g -= l2 * theta
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        theta = theta + 0.5 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    weights = {n: float(theta[i]) for n, i in ids.items() if i == 0 or abs(theta[i]) > 1e-3}
    tr, st = theta[d : d + 4].reshape(2, 2), theta[d + 4 :]
    of_word = theta[0] + (theta[:d][feats] * known).sum(axis=1)
    for i, j in parts:
        post[i:j] = marginals(of_word[x[i:j]], first[i:j], tr, st)
    ends = np.cumsum([0, *sizes])
    seen = np.array([evidence(post[i:j]) for i, j in zip(ends, ends[1:])])
    return Chain(weights, tr, st, logistic(seen, flags.astype(np.float64)))


def evidence(post: np.ndarray) -> float:
    high = post[post >= FLOOR]
    return float(np.minimum(CAP, -np.log1p(-np.minimum(high, 1 - 1e-9))).sum())


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.01) -> tuple[float, float]:
    """Intercept and non-negative slope of a regularised logistic curve, by Newton steps; ``x`` is cut at ``2 * CAP``."""
    X = np.stack([np.ones_like(x), np.minimum(x, 2 * CAP)], axis=1)
    w = np.array([-3.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        h = (X * (p * (1 - p))[:, None]).T @ X + l2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, X.T @ (y - p) - l2 * w), -2, 2)
    return float(w[0]), float(max(0.0, w[1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Chain | None:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, the ones of least id hash."""
    part = labels.filter(fold_of(id_col) != HELD_OUT).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label).alias("_y")).filter("_y is not null")
    part = part.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_t")).filter(F.length("_t") <= chars)
    got = d.join(F.broadcast(part), "_id").orderBy(F.xxhash64("_id"), "_id", "_t").limit(rows).collect()
    return fit([r["_t"] for r in got], [r["_y"] for r in got])


def text_score(post: np.ndarray, curve: tuple[float, float]) -> float:
    return 1 / (1 + math.exp(-(curve[0] + curve[1] * min(2 * CAP, evidence(post)))))


def spans(text: str, post: np.ndarray, tagged: float = TAGGED) -> list[tuple[int, int]]:
    """Code-point offsets (start, end) of runs of neighbouring tagged tokens."""
    out: list[tuple[int, int]] = []
    k, joined = 0, False
    for at, piece in slices(text):
        for m in _WORD.finditer(piece):
            if post[k] >= tagged:
                start, end = at + m.start(), at + m.end()
                out[-1:] = [(out[-1][0], end)] if joined else [*out[-1:], (start, end)]
                joined = True
            else:
                joined = False
            k += 1
    return out


def scored(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, score, toxic_spans`` of every row; with ``keep``, these columns of ``docs`` instead of the id.

    Spans are written ``start-end`` and joined by commas.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = keep if keep is not None else [id_col]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("_t"))
    model = spark.sparkContext.broadcast((chain.weights, chain.transitions, chain.start, chain.curve) if chain else None)

    def emit(batches):
        c = Chain(*model.value) if model.value else None
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            scores, found = [0.0] * len(texts), [""] * len(texts)
            if c:
                parts = [c.emissions(t) for t in texts]
                sizes = [len(p) for p in parts]
                ends = np.cumsum([0, *sizes])
                first = np.zeros(ends[-1], dtype=bool)
                first[ends[:-1][np.array(sizes, dtype=int) > 0]] = True
                post = marginals(np.concatenate(parts) if parts else np.empty(0), first, c.transitions, c.start)
                for i, t in enumerate(texts):
                    own = post[ends[i] : ends[i + 1]]
                    scores[i] = text_score(own, c.curve)
                    if len(own) and own.max() >= TAGGED:
                        found[i] = ",".join(f"{s}-{e}" for s, e in spans(t, own))
            out = [b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(scores, pa.float64()), pa.array(found, pa.string())], [*[f"c{i}" for i in range(len(names))], "score", "toxic_spans"])

    schema = ", ".join([f"c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(names))] + ["score double", "toxic_spans string"])
    out = rows.mapInArrow(emit, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "score", "toxic_spans")


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    chain = train(docs, labels, id_col, text)
    columns = docs.columns
    out = scored(docs, chain, id_col, text, keep=columns)
    return out.toDF(*[f"c{i}" for i in range(len(columns))], "_score", "_spans").filter(F.col("_score") < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
