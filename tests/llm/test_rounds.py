"""Components are finished however many rounds they take."""

from lamella.llm import jaccard_join


def test_path_settles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1, raising=False)
    path = spark.createDataFrame([(i * 7919 % 101, (i + 1) * 7919 % 101) for i in range(100)], "a long, b long")
    assert {(r["digest"], r["comp"]) for r in jaccard_join.components(path).collect()} == {(i, 0) for i in range(101)}
