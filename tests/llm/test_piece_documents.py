"""Piece sampling against plain enumeration, over whole documents, and in the defined cases."""

import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from lamella.llm import piece_sampling, queries

sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def lat():
    return piece_sampling.lattice(piece_sampling.default_path())


@pytest.fixture(scope="module")
def weights(lat):
    """Piece to (id, log weight), read from the model by plain code."""
    sp = lat.library
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    out = {sp.id_to_piece(i): (i, -math.log(2 + max(0.0, -sp.get_score(i)))) for i in plain}
    raw = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
    return out, raw, -math.log(2 + n)


def every(text, weights):
    """All segmentations of a short text with their log odds."""
    pieces, raw, byte = weights
    s = ["\u2581"] + ["\u2581" if c == " " else ("own", c) if c == "\u2581" else c for c in text]
    found: dict = {}

    def walk(at, ids, w):
        if at == len(s):
            found[tuple(ids)] = w
            return
        single = False
        for end in range(at + 1, len(s) + 1):
            if any(isinstance(c, tuple) for c in s[at:end]):
                break
            hit = pieces.get("".join(s[at:end]))
            if hit:
                single = single or end == at + 1
                walk(end, [*ids, hit[0]], w + hit[1])
        if not single:
            c = s[at][1] if isinstance(s[at], tuple) else s[at]
            b = c.encode()
            walk(at + 1, [*ids, *[raw[x] for x in b]], w + byte * len(b))

    walk(0, [], 0.0)
    total = math.log(sum(math.exp(w) for w in found.values()))
    return {ids: w - total for ids, w in found.items()}


def rows_of(lat, texts, seeds, k):
    out = [[] for _ in texts]
    for live, offset, ids, lp, g, inc in piece_sampling.samples(lat, texts, seeds, k):
        for i, r in enumerate(live.tolist()):
            out[r].append((tuple(ids[offset[i] : offset[i + 1]].tolist()), lp[i], g[i], inc[i]))
    return out


@pytest.mark.parametrize("text", ["the", "of it", "a\u2581b", "\u65e5x\U0001f600", "  in", "\n1"])
def test_all_segmentations(lat, weights, text):
    want = every(text, weights)
    got = rows_of(lat, [text, text], [3, 4], len(want) + 2)
    for found in got:
        assert {ids for ids, *_ in found} == set(want) and len(found) == len(want)
        assert all(abs(lp - want[ids]) < 1e-9 and inc == 1.0 for ids, lp, _, inc in found)
        assert all(a[2] >= b[2] for a, b in zip(found, found[1:]))
        assert all(lat.decode(ids) == text for ids, *_ in found)


def test_odds_without_replacement(lat, weights):
    n = 20_000
    want = {ids: math.exp(lp) for ids, lp in every("the", weights).items()}
    got = rows_of(lat, ["the"] * n, list(range(n)), 2)
    first = Counter(f[0][0] for f in got)
    pairs = Counter((f[0][0], f[1][0]) for f in got)
    for a, p in want.items():
        assert abs(first[a] / n - p) < 0.015
        for b, q in want.items():
            assert a == b or abs(pairs[a, b] / n - p * q / (1 - p)) < 0.015
    assert abs(np.mean([sum(math.exp(lp) / inc for _, lp, _, inc in f) for f in got]) - 1) < 0.02


def test_samples_do_not_depend_on_neighbours(lat):
    texts = ["one of many words", "", "x" * 70, "another text \u65e5\u672c", "a b c d e f"]
    seeds = [5, 6, 7, 8, 9]
    together = rows_of(lat, texts, seeds, 3)
    assert together == [rows_of(lat, [t], [s], 3)[0] for t, s in zip(texts, seeds)]
    assert together[1] == [((), 0.0, together[1][0][2], 1.0)]


def test_every_document_whole(spark, sf_dir, lat):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
    got: dict = {}
    for r in queries.op3_piece_sampling(spark, sf_dir).collect():
        assert r["decoded_same"] and 0 <= r["inclusion"] <= 1
        got.setdefault(r["doc_id"], []).append((r["sample"], r["n_pieces"], r["log_p"], r["perturbed"], r["ids_hash"]))
    assert set(got) == set(docs.doc_id)
    for d, text in zip(docs.doc_id, docs.text):
        want = rows_of(lat, [text or ""], [piece_sampling.seed_of((int(d),))], piece_sampling.SAMPLES)[0]
        mine = sorted(got[d])
        assert [x[:2] for x in mine] == [(s, len(ids)) for s, (ids, *_) in enumerate(want)]
        assert np.allclose([x[2] for x in mine], [w[1] for w in want]) and np.allclose([x[3] for x in mine], [w[2] for w in want])
        assert len({x[4] for x in mine}) == len(mine)


def test_rows(spark, lat, monkeypatch):
    long = "one of many words, " * 10_000 + "\u65e5" * 5_000
    rows = [(1, "hi  you\n\u65e5 x", "k", 1), (2, None, "k", 1), (1, "hi  you\n\u65e5 x", "k", 1), (None, long, "k", 1), (4, "a\u2581 b", "k", 1)]
    d = spark.createDataFrame(rows, "id int, text string, ids string, `a.b` int")
    out = piece_sampling.sampled(d.coalesce(1), ["id"]).collect()
    assert sorted((str(r["id"]), r["sample"]) for r in out) == sorted([(str(i), s) for i in (1, 1, None, 4) for s in range(3)] + [("2", 0)])
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r["decoded_same"] and lat.decode(r["ids"]) == text[r["id"]] for r in out)
    assert len({tuple(r["ids"]) for r in out if r["id"] == 1}) == 3
    assert piece_sampling.sampled(d.limit(0), ["id"]).collect() == []


def test_samples_survive_a_full_store(lat, monkeypatch):
    r = np.random.default_rng(2)
    texts = [" ".join("".join(map(chr, r.integers(97, 123, 7))) for _ in range(5)) + " and the of it" for _ in range(60)]
    want = rows_of(lat, texts, list(range(60)), 3)
    monkeypatch.setattr(piece_sampling, "STORED", 1000)
    small = piece_sampling.Lattice(piece_sampling.default_path())
    got = [rows_of(small, [t], [i], 3)[0] for i, t in enumerate(texts)]
    assert got == want and small.store.half is not None and len(small.store.stretches) < len(lat.store.stretches)


def test_known_paths_cost_a_draw_a_stretch(sf_dir, lat, monkeypatch):
    texts = [t or "" for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    drawn, plain = [], piece_sampling.uniform
    monkeypatch.setattr(piece_sampling, "uniform", lambda key, place: drawn.append(np.broadcast(key, place).size) or plain(key, place))
    pieces = sum(len(ids) for _, _, ids, *_ in piece_sampling.samples(lat, texts, list(range(len(texts))), 3))
    assert sum(drawn) < 0.8 * pieces


@pytest.mark.parametrize("name, value", [("WIDTH", 1), ("WIDTH", 2), ("CHAIN", 1)])
def test_odds_whatever_is_drawn_at_once(weights, monkeypatch, name, value):
    n, text = 20_000, "the.\nthe"
    monkeypatch.setattr(piece_sampling, name, value)
    small = piece_sampling.Lattice(piece_sampling.default_path())
    want = {ids: math.exp(lp) for ids, lp in every(text, weights).items()}
    got = rows_of(small, [text] * n, list(range(n)), 3)
    orders = Counter(tuple(x[0] for x in f) for f in got)
    likely = sorted(want, key=want.get)[-4:]
    for a in likely:
        for b in likely:
            for c in likely:
                p, q, r = want[a], want[b], want[c]
                odds = p * q / (1 - p) * r / (1 - p - q) if len({a, b, c}) == 3 else 0.0
                assert abs(orders[a, b, c] / n - odds) < 0.015
    assert all(len({x[0] for x in f}) == 3 for f in got)
    assert abs(np.mean([sum(math.exp(lp) / inc for _, lp, _, inc in f) for f in got]) - 1) < 0.02
    few = rows_of(small, ["the of", "a▁b"], [1, 2], 5000)
    assert [{ids for ids, *_ in f} for f in few] == [set(every(t, weights)) for t in ("the of", "a▁b")]


def test_units_with_equal_hashes(lat, monkeypatch):
    texts = ["one of many words", "", "words of many.\nWords", "日本 a", "many of one", "x" * 70]
    want = rows_of(lat, texts, list(range(6)), 3)
    monkeypatch.setattr(piece_sampling, "_hashes", lambda code, start, size: (code[start] % 3).astype(np.uint64))
    weak = piece_sampling.Lattice(piece_sampling.default_path())
    assert rows_of(weak, texts, list(range(6)), 3) == want
    assert [rows_of(weak, [t], [i], 3)[0] for i, t in enumerate(texts)] == want


def test_long_stretches_are_walked_once(lat, monkeypatch):
    texts = ["the" * 2_000, "one of many words", "=" * 3_000, "and" * 1_500 + " of 日"]
    want = rows_of(lat, texts, [1, 2, 3, 4], 3)
    steps, plain = [], piece_sampling.mix
    monkeypatch.setattr(piece_sampling, "mix", lambda x: steps.append(1) or plain(x))
    assert rows_of(lat, texts, [1, 2, 3, 4], 3) == want
    assert len(steps) < 1_000
    monkeypatch.setattr(piece_sampling, "FEW", 0)
    assert rows_of(lat, texts, [1, 2, 3, 4], 3) == want
    assert all(lat.decode(ids) == t for t, f in zip(texts, want) for ids, *_ in f)
