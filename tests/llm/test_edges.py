"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import io
import zlib

import numpy as np
import pytest

from lamella.llm import best_fit, chat_format, fingerprints, jaccard_join, quality_rules, rans, token_rollups, toxicity, warc_archive

LONG = " ".join(f"w{i}" for i in range(9000))
WORDS = " ".join(f"common{i}" for i in range(80))
ROWS = [(1, WORDS, "en", "a", 1, "x"), (1, WORDS, "en", "a", 1, "x"), (2, None, None, None, None, None), (3, "", "en", "a", 0, "x"), (None, WORDS + " more", "en", "a", 5, "x"), (5, LONG, "en", "b", 9, "x"), (6, " \n\t", "en", "b", 3, "x"), (7, "a b", "en", "b", 3, "x"), (8, "A B", "en", "b", 3, "x")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string"


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(spark, request):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (2, None, None), (3, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")


def test_quality(docs):
    n = docs.count()
    out = quality_rules.judged(docs).collect()
    assert len(out) == n and all(r["kept"] is not None for r in out)
    assert quality_rules.kept_documents(docs).columns == docs.columns
    if n:
        assert {r["row"]["doc_id"]: r["n_words"] for r in out}[2] == 0


def test_toxicity(docs, labels):
    out = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.clean_documents(docs, labels).columns == docs.columns


def test_jaccard(docs):
    out = jaccard_join.jaccard_components(docs).collect()
    assert len(out) == docs.count()
    if out:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
        assert got[2] == got[2][:1] + (2,) and got[2][0] == 0 and got[3] == (0, 3) and got[1] == (76, 1) and got[None] == (77, 1) and got[7] == (1, 7) and got[8] == (1, 7)
        kept = jaccard_join.one_of_each(docs)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 5, 6, 7]


def test_packing(docs):
    out = best_fit.packed_documents(docs).collect()
    assert len({(r["doc_id"]) for r in out}) == len({r["doc_id"] for r in docs.collect()})
    assert all(r["length"] <= 4096 for r in out)


def test_token_files(docs):
    out = rans.round_trip(docs).orderBy("start").collect()
    assert len(out) == docs.count()
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]


def test_fingerprints(docs):
    out = fingerprints.with_next(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r["near_next"] <= 1
    assert fingerprints.fingerprints(docs).count() == docs.count()


def test_token_ledger(spark, docs, tmp_path):
    assert token_rollups.token_counts(docs).count() == docs.count()
    ledger = token_rollups.Ledger(spark, f"file://{tmp_path}/ledger")
    change = lambda *rows: token_rollups.deltas(spark.createDataFrame(list(rows), "op string, source string, lang string, version string, old_tokens long, new_tokens long"))
    first = change(("insert", "a", None, "1", None, 5), ("insert", "b", "x", "1", None, 7))
    assert ledger.commit("one/1", first) and not ledger.commit("one/1", first)
    assert ledger.commit("two", change(("delete", "b", "x", "1", 7, None), ("revise", "a", None, "1", 5, 9)))
    want = [("a", None, "1", 1, 9)]
    assert [tuple(r) for r in ledger.totals().collect()] == want
    ledger.compact()
    assert [tuple(r) for r in ledger.totals().collect()] == want and not ledger.commit("two", first)


class Stopped(Exception):
    pass


@pytest.mark.parametrize("where", ["_publish", "_clear", "after the first removal"])
def test_ledger_compaction_cut_off(spark, tmp_path, where):
    """Wherever a compaction stops, totals and names are right, retried batches count once, and the next one cleans up."""
    ledger = token_rollups.Ledger(spark, f"file://{tmp_path}/ledger")
    sums = lambda n: spark.createDataFrame([("a", "x", "1", 1, n)], token_rollups.SCHEMA)
    for i in range(3):
        assert ledger.commit(f"b\n{i}", sums(10**i))
    ledger.compact()
    for i in range(3, 6):
        assert ledger.commit(f"b\n{i}", sums(10**i))
    cut = token_rollups.Ledger(spark, ledger.path)

    def stop(*_):
        raise Stopped

    if where.startswith("_"):
        setattr(cut, where, stop)
    else:
        whole = cut._clear
        cut._clear = lambda old: (whole(sorted(x for x in old if x.startswith("batch-"))[:1]), stop())
    with pytest.raises(Stopped):
        cut.compact()
    for _ in range(2):
        assert [tuple(r) for r in ledger.totals().collect()] == [("a", "x", "1", 6, 111111)]
        assert sorted(r[0] for r in ledger.batches().collect()) == [f"b\n{i}" for i in range(6)]
        assert not any(ledger.commit(f"b\n{i}", sums(1)) for i in range(6))
        ledger.compact()
    assert len([x for x in ledger._listed() if x.startswith(("batch-", "folded-"))]) == 1
    assert ledger.commit("new", sums(5)) and ledger.totals().first()["tokens"] == 111116


def test_warc(spark):
    pages = [(1, "http://a\r\nX: y", "x" * 200, 1), (2, None, "x" * 200, 1), (3, "u", None, 1), (None, "u", "x" * 200, 1), (4, "u", "small", 1), (5, "u", "small", 1)]
    for rows in (pages, []):
        out = warc_archive.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, file int"))
        got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out.collect()}
        assert got == ({1: ("response", None, 200), 2: ("revisit", 1, 200), 3: ("response", None, 0), None: ("revisit", 1, 200), 4: ("response", None, 5), 5: ("response", None, 5)} if rows else {})


def test_warc_reader_rejects():
    out = io.BytesIO()
    w = warc_archive.ArchiveWriter(out, b"")
    digest = hashlib.sha256(b"abc").hexdigest()
    good = warc_archive.record(1, "u", b"abc", digest, None, False)
    w.add(good)
    assert [b for _, b in warc_archive.read_archive(io.BytesIO(out.getvalue()), 5)] == [b"abc"]
    with pytest.raises(ValueError):
        list(warc_archive.read_archive(io.BytesIO(out.getvalue()[:-3])))
    revisit = warc_archive.record(2, "u", b"abc", digest, 1, True)
    assert warc_archive.parse_record(revisit)[1] == b""
    for bad in (good.replace(b"Payload-Length: 3", b"Payload-Length: 9"), good.replace(b"WARC-Payload-Digest", b"X-Digest"), revisit.replace(b"WARC-Refers-To", b"X-Refers"), revisit.replace(b"sha256:", b"sha1:"), good.replace(b"Length: 3", b"Length: 4"), good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc_archive.parse_record(bad)


def test_warc_false_revisit(spark):
    rows = [(1, "u", "response", None, 3, "a"), (2, "u", "revisit", 1, 3, "a")]
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    assert warc_archive.verified(spark.createDataFrame(rows, schema)).count() == 2
    for false in ((2, "u", "revisit", 1, 4, "a"), (2, "u", "revisit", 1, 3, "b"), (2, "u", "revisit", 9, 3, "a")):
        with pytest.raises(Exception, match="no response holds"):
            warc_archive.verified(spark.createDataFrame([rows[0], false], schema)).collect()


def test_warc_missing_record(spark, tmp_path):
    archives = warc_archive.write_archives(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), f"file://{tmp_path}/warc")
    with pytest.raises(Exception, match="holds 1 records"):
        warc_archive.read_archives(archives.withColumn("records", archives.records + 1)).collect()


def test_chat_repeated_and_tied_events(spark):
    schema = "conv_id int, message_id int, seq int, kind string, role string, text string"
    log = [(1, 0, 1, "edit", "user", "B"), (1, 0, 1, "edit", "user", "B"), (1, 1, 1, "edit", "user", "B"), (1, 1, 1, "edit", "user", "C"), (1, 2, 0, "open", "user", "a"), (1, 2, 1, "delta", "user", "b"), (1, 2, 1, "delta", "user", "b"), (1, 2, 2, None, "user", "c"), (1, 3, 0, "open", "user", "a"), (1, 3, 2, "edit", "user", "z"), (1, 3, 2, "delta", "user", "y"), (1, 4, 0, "open", "user", "p" * 300_000)]
    got = chat_format.parsed(chat_format.formatted(spark.createDataFrame(log, schema))).first()
    assert [t["text"] for t in got["turns"]] == ["B", "C", "abc", "zy", "p" * 300_000]


def test_quality_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, text, "a", 7, 8, 9, 1)], ["doc_id", "text", "source", "w", "kept", "mark", "a.b"])
    assert quality_rules.kept_documents(d).collect() == d.collect()
    assert jaccard_join.one_of_each(d).collect() == d.collect()
    assert [r["row"]["kept"] for r in quality_rules.judged(d).collect()] == [8]


def test_short_texts_in_long_ones():
    r = np.random.default_rng(4)
    words = [f"v{i}" for i in r.integers(0, 10**6, 2000)]
    for scale, bounds in ((2, ((8, 0.9), (20, 0.999), (60, 1.0))), (4, ((8, 0.6), (20, 0.97), (60, 1.0)))):
        whole = fingerprints.sketch(" ".join(words), scale=scale)
        for n, least in bounds:
            parts = [fingerprints.sketch(" ".join(words[i : i + n]), scale=scale) for i in range(0, 1900, 10)]
            got = [fingerprints.likeness(p, whole, scale) for p in parts]
            assert set(got) <= {0.0, 1.0} and np.mean(got) >= least
            assert all(g == 1.0 or fingerprints.lone(p, scale) for g, p in zip(got, parts))


def test_chat_events(spark):
    log = [(1, 0, 0, "open", "user", "a<b"), (1, 1, 1, "open", "assistant", "dra"), (1, 1, 2, "delta", None, "ft"), (1, 1, 3, "regenerate", None, "x"), (1, 1, 4, "delta", None, "y#"), (1, 2, 5, "open", "user", "gone"), (1, 2, 6, "delete", None, None), (1, 3, 7, "open", "user", "old"), (1, 3, 8, "edit", None, "\\new</turn>\n### user: "), (2, 0, 0, "open", None, None)]
    schema = "conv_id int, message_id int, seq int, kind string, role string, text string"
    got = {r["conv_id"]: r for r in chat_format.parsed(chat_format.formatted(spark.createDataFrame(log, schema))).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "a<b"), ("assistant", "xy#"), ("user", "\\new</turn>\n### user: ")]
    assert got[1]["loss_texts"] == ["xy#"] and [tuple(t) for t in got[2]["turns"]] == [("", "")]
    s = got[1]["loss_spans"][0]
    assert got[1]["formatted"][s["start"] : s["start"] + s["length"]] == "xy\\h"
    assert chat_format.formatted(spark.createDataFrame([], schema)).count() == 0


def test_rans_blocks():
    rng = np.random.default_rng(0)
    for n in (1, 63, 5000, 300_001):
        ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
        t = rans.Table.scaled(np.bincount(ids))
        out = io.BytesIO()
        w = rans.FileWriter(out, t)
        w.add(None, ids[: n // 2])
        w.add(7, ids[n // 2 :])
        w.close()
        r = rans.FileReader(io.BytesIO(out.getvalue()), t)
        assert r.docs == [(None, n // 2), (7, n - n // 2)]
        assert np.array_equal(np.concatenate([p for _, p, _ in r.parts()]), ids)
        assert zlib.crc32(r.block(len(r.checkpoints) - 1).tobytes()) == r.checkpoints[-1][5]
        w = rans.FileWriter(many := io.BytesIO(), t)
        cuts = sorted({0, n, *rng.integers(0, n, 9).tolist()})
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            w.add(k, ids[a:b])
        w.close()
        for span in (1, 2, 100):
            r, got = rans.FileReader(io.BytesIO(many.getvalue()), t), {}
            for first in range(0, len(r.checkpoints), span):
                for doc, part, ends in r.parts(first, first + span):
                    got.setdefault(doc, []).append((part, ends))
            assert sorted(got) == list(range(len(cuts) - 1))
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                assert np.array_equal(np.concatenate([p for p, _ in got[k]]), ids[a:b]) and [e for _, e in got[k]] == [False] * (len(got[k]) - 1) + [True]
        broken = bytearray(out.getvalue())
        broken[40] ^= 1
        with pytest.raises(ValueError):
            list(rans.FileReader(io.BytesIO(bytes(broken)), t).parts())
