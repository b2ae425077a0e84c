"""The pipeline's four stages against plain Python over the same rows; toxicity's scores are its own operator's."""

import re
import statistics
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from lamella.llm import toxicity

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


def kept_by_rules(docs):
    base, failed, hosts = {}, {}, {}
    for d, text, host in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        base[d] = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        failed[d] = base[d] or 100 * len(re.findall(r"[#*$%&|<>]", text)) > 10 * len("".join(w)) or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)
        hosts.setdefault(host, []).append(failed[d])
    rates = [sum(x) / len(x) for x in hosts.values()]
    mean, var = statistics.mean(rates), statistics.variance(rates)
    strength = min(1e6, max(2.0, mean * (1 - mean) / var - 1)) if var else 1e6
    rate = {h: (sum(x) + mean * strength) / (len(x) + strength) for h, x in hosts.items()}
    return {d for d, _, h in docs if not base[d] and rate[h] <= 0.8}


def one_of_each(texts):
    sets = {}
    for d, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})) if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {d: low if c == high else c for d, c in comp.items()}
    return {d for d, c in comp.items() if c == d}


def test_stages(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
    docs = list(zip(table.doc_id.tolist(), table.text, table.source))
    text = {d: t for d, t, _ in docs}
    want = kept_by_rules(docs)
    left = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id in (" + ",".join(map(str, want)) + ")")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(left, toxicity.train(left, labels)).collect()}
    assert set(scores) == want and len(want) < len(docs)
    want = one_of_each({d: text[d] for d in want if scores[d] < toxicity.THRESHOLD})
    encode = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json")).encode
    pieces = set()
    for d in want:
        ids = np.array([*encode(text[d], add_special_tokens=False).ids, 1], dtype="<u4")
        pieces |= {(d, s // 4096, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(pieces)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 4096
