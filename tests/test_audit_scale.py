"""What the audit of large corpora does once, and how its grams are counted."""

from collections import Counter

from pyspark.sql import functions as F

from veilmark.operators import audit, references


def test_grams_equal_those_of_plain_counting(spark):
    texts = ["", "a", "abab", "aaaaaaa", None, "zwölf 😀😀 Boxkämpfer", "é́\n\n\t x", "日本語のテキスト" * 3]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for order in (1, 2, 4, 20):
        want = Counter(p[i : i + order] for t in texts if t for p in [" " * (order - 1) + t] for i in range(len(t)))
        got = {r["context"] + r["next"]: r["n"] for r in audit.gram_counts(rows, order).collect()}
        assert got == want


def test_pieces_and_flushes_change_no_count():
    import pyarrow as pa

    texts = [f"text number {i} 😀 {'xy' * (i % 7)}" for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    count = lambda **how: sum((Counter(dict(zip(b["g"].to_pylist(), b["n"].to_pylist(), strict=True))) for b in audit.gram_counter(4, **how)([batch])), Counter())
    assert count(piece=50, flush=20) == count() == Counter(p[i : i + 4] for t in texts for p in ["   " + t] for i in range(len(t)))


def test_look_alikes_read_the_corpus_once(spark):
    """The detection behind the values runs once, and only grammars that occur are planned."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(value):
        calls.add(1)
        return value

    rows = spark.createDataFrame([("EMAIL", "ada.b@c.io"), ("EMAIL", "x@y.org"), ("SSN", "078-05-1120"), ("OTHER", "Ab-12")], "entity_type string, value string")
    made = {(r["entity_type"], r["value"]): r["made"] for r in references.outside_corpus(rows.withColumn("value", seen("value")), 3).collect()}
    assert calls.value == 4 and all(len(m) == 3 for m in made.values()) and len(made) == 4
    whole = references.outside_corpus(rows, 3)
    assert {(r["entity_type"], r["value"]): r["made"] for r in whole.collect()} == made
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000
