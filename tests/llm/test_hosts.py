"""A host over the rate limit loses its good documents too."""

from lamella.llm import quality_rules


def test_rejected_host(spark):
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    good = [(i, words(i), f"good{i % 4}") for i in range(80)]
    bad = [(100 + i, words(i) + " " + "#" * 60, "bad") for i in range(99)] + [(199, words(199), "bad")]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, source string")
    out = {r["row"]["doc_id"]: r for r in quality_rules.judged(rows).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert out[199]["host_rate"] > quality_rules.MAX_HOST_RATE and not out[199]["any_failed"]
    assert {d for d, r in out.items() if r["kept"]} == set(range(80))
