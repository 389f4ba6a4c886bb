import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilmark.operators import audit, ml, provenance
from veilmark.operators.profile import FeaturePlan
from veilmark.plans import preprocess
from veilmark.sources import tables


def chosen(spark, *trials, max_gap=0.05, error=0.01):
    """Number of the chosen one of (family, score, gap) and those eligible."""
    rows = spark.createDataFrame([(f, i, float(s), error, float(g)) for i, (f, s, g) in enumerate(trials)], "family string, setting int, score double, error double, gap double")
    got = ml.ranked(rows, max_gap).collect()
    picked = [r.setting for r in got if r.chosen]
    return (picked[0] if len(picked) == 1 else picked), {r.setting for r in got if r.eligible}


def test_ranked(spark):
    assert chosen(spark, ("boosting", 0.80, 0.04), ("forest", 0.95, 0.30)) == (0, {0})
    # where all overfit, the least overfit one is taken, whatever its score
    assert chosen(spark, ("linear", 0.9, 0.2), ("forest", 0.7, 0.1)) == (1, {1})
    assert chosen(spark, ("boosting", 0.80, 0), ("linear", 0.795, 0)) == (1, {0, 1})
    assert chosen(spark, ("boosting", 0.80, 0), ("linear", 0.78, 0)) == (0, {0, 1})
    # within a family the better setting; ties go to the simpler family, then the earlier setting
    assert chosen(spark, ("linear", 0.791, 0), ("linear", 0.795, 0), ("boosting", 0.80, 0))[0] == 1
    assert chosen(spark, ("forest", 0.8, 0), ("boosting", 0.8, 0), ("boosting", 0.8, 0))[0] == 1
    assert chosen(spark, ("linear", math.nan, 0), ("linear", 0.9, math.nan), ("linear", math.inf, 0), ("forest", 0.5, 0)) == (3, {3})
    assert chosen(spark, ("linear", math.nan, 0)) == ([], set())


@pytest.mark.parametrize("labels", [["low", "mid", "top"], ["10", "9", "x"]])
def test_text_labels_of_three_classes(spark, labels):
    df = spark.range(270).select((F.col("id") % 9).cast("double").alias("x"), (F.xxhash64("id") % 1000).cast("double").alias("z"), F.get(F.array(*map(F.lit, labels)), F.floor(F.col("id") % 9 / 3).cast("int")).alias("y"))
    df = df.union(spark.createDataFrame([(1.0, 2.0, None)], df.schema)).cache()
    plan = FeaturePlan({"x": "numeric", "z": "numeric"})
    found = ml.select_model(df, plan, "y", "classification", 2, ("boosting", "forest"), max_gap=0.2)
    assert found.classes == ml.class_order(df, "y") == (["9", "10", "x"] if "x" in labels else labels) and {t.family for t in found.trials} == {"boosting", "forest"}
    assert all(math.isfinite(t.score) and math.isfinite(t.gap) for t in found.trials)
    rows = found.predicted(df.where("y is not null"), plan, "y").groupBy("x").agg(F.collect_set("predicted").alias("p")).collect()
    assert {r.x: r.p for r in rows} == {float(i): [labels[i // 3]] for i in range(9)}
    with pytest.raises(ValueError, match="classes"):
        ml.class_order(df, "z", 5)


def test_select_and_overfit(spark):
    noise = F.xxhash64("id", F.lit(1)) % 100 / 100.0
    df = spark.range(240).select((F.col("id") % 7).cast("double").alias("x"), (F.xxhash64("id") % 1000).cast("double").alias("z"), (F.col("id") % 7 + noise > 3).cast("int").alias("y")).cache()
    plan = FeaturePlan({"x": "numeric", "z": "numeric"})
    found = ml.select_model(df, plan, "y", "classification", 2, ("linear",), max_gap=0.2)
    assert found.trial.gap <= 0.2 and len(found.trials) == len(ml.STRENGTHS) and found.model is not None
    # noise in the label: full trees learn it by heart
    assert ml.overfit_model(df, plan, "y", "classification", 2, trees=5).gap > 0.05
    assert df.count() == 240


def test_rank_strata(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(10)] + [(0.0, 10), (None, 11)], "v double, i int")
    got = {r.i: r.stratum for r in ml.rank_strata(df, "v", 4).collect()}
    values = sorted((v, i) for v, i in [(float(i), i) for i in range(10)] + [(0.0, 10)])
    below = {i: sum(w < v for w, _ in values) for v, i in values}
    assert got == {i: below[i] * 4 // 11 for i in below} | {11: None}
    assert ml.rank_strata(df.limit(0), "v").count() == 0


def test_split_keeps_labels_on_both_sides(spark):
    df = tables.demo_table(spark, 600, 1)
    train, test, _ = preprocess.preprocess(df, "income", 4)
    labels = [{r.income for r in side.select("income").distinct().collect()} for side in (train, test)]
    assert labels[0] == labels[1]


def test_verification_of_tampered_chain(spark):
    events = spark.range(1, 7).select(F.lit("t").alias("k"), "id")
    log = provenance.chain(events, "k", "id", F.concat(F.lit("e"), F.col("id"))).cache()
    assert provenance.verify_chain(log).count() == 0
    changed = log.withColumn("body", F.when(F.col("seq") == 3, "other").otherwise(F.col("body")))
    assert [(r.seq, r.problem) for r in provenance.verify_chain(changed).collect()] == [(3, "content")]
    cut = provenance.verify_chain(log.where("seq <> 4")).collect()
    assert {(r.seq, r.problem) for r in cut} == {(5, "sequence 4 missing"), (5, "link")}


def test_gram_losses_against_a_count(spark):
    texts = ["the cat sat", "ab", "a the mat", "", None]
    spans = [("a", 0, 0, "the cat sat", 4, 7), ("b", 0, 0, "ab", 0, 2), ("c", 0, 0, "zzq", 1, 3), ("d", 0, 0, "ab", 1, 1)]
    counts = audit.gram_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = audit.gram_losses(spark.createDataFrame(spans, "id string, pos int, variant int, text string, start int, end int"), counts)
    grams = Counter(("   " + t)[i : i + 4] for t in texts if t for i in range(len(t)))
    whole = Counter()
    for g, n in grams.items():
        whole[g[:3]] += n
    want = {}
    for name, _, _, text, start, end in spans[:3]:
        own = [("   " + text)[i : i + 4] for i in range(start, end)]
        want[name] = sum(-math.log((grams[g] + 0.1) / (whole[g[:3]] + 25.6)) for g in own) / len(own)
    assert {r.id: round(r.loss, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
