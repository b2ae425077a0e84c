"""Packing falls back to signatures."""

import __spark_entry__
from lamella.operators import search


def test_signature_when_full_text_does_not_fit(spark):
    d = spark.createDataFrame([(1, 1, 60, 5), (1, 2, 50, 10), (1, 3, 40, 31), (1, 4, 30, 9)], "g int, o int, n int, s int")
    got = sorted(tuple(r) for r in search.packed(d, "g", "o", "n", 100, "s").collect())
    assert got == [(1, 1, 60, 5, True, "full"), (1, 2, 50, 10, True, "signature"), (1, 3, 40, 31, False, None), (1, 4, 30, 9, True, "full")]


def test_query_has_forms(spark, sf_dir):
    for r in __spark_entry__.queries()["context_pack"](spark, sf_dir).collect():
        assert r["included"] == (r["form"] is not None)
