import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.functions import significance as sig
from veilmark.operators import audit, drift, leakage


def frame(spark, seed, shift, n):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(float(40 + 10 * shift + 10 * a), ["red", "green", "blue"][b]) for a, b in zip(r.normal(size=n), r.integers(0, 3, n), strict=True)], "hours double, color string")


def test_drift_verdicts(spark):
    ref = frame(spark, 1, 0, 3000)
    same = {r.column: r.drifted for r in drift.check_drift(ref, frame(spark, 2, 0, 1000)).collect()}
    moved = {r.column: r.drifted for r in drift.check_drift(ref, frame(spark, 3, 1, 1000)).collect()}
    assert not any(same.values()) and moved == {"hours": True, "color": False}


def test_psi_of_itself_and_constant(spark):
    ref = frame(spark, 1, 0, 500)
    assert drift.psi_numeric(ref, ref, "hours").first().psi == 0
    assert drift.psi_numeric(ref.withColumn("hours", F.lit(1.0)), ref, "hours").first().psi == 0


def test_two_sample_against_direct(spark):
    r = np.random.default_rng(0)
    x, y = r.integers(0, 9, 60).astype(float), r.integers(1, 10, 40).astype(float)
    got = drift.two_sample(spark.createDataFrame([(float(v),) for v in x], "v double"), spark.createDataFrame([(float(v),) for v in y], "v double"), "v").first()
    both = np.concatenate([x, y])
    rank = np.array([(both < v).sum() + ((both == v).sum() + 1) / 2 for v in both])
    rx, ry = np.sort(rank[:60]), np.sort(rank[60:])
    assert got.u == pytest.approx(rank[:60].sum() - 60 * 61 / 2)
    assert got.ks == pytest.approx(max(abs((x <= v).mean() - (y <= v).mean()) for v in both))
    u = 60 * ((rx - np.arange(1, 61)) ** 2).sum() + 40 * ((ry - np.arange(1, 41)) ** 2).sum()
    assert got.cvm == pytest.approx(u / (2400 * 100) - (4 * 2400 - 1) / 600)


def test_tails():
    assert sig.cvm_limit_sf(0.46136) == pytest.approx(0.05, abs=1e-5)
    assert sig.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert sig.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert sig.binomial_tail(3, 10, 0.1) == pytest.approx(0.0701908, abs=1e-6) and sig.binomial_tail(0, 5, 0.2) == 1


def test_auc_and_roc(spark):
    rows = [(0.9, 1), (0.8, 1), (0.8, 0), (0.3, 0), (None, 1), (float("nan"), 0)]
    df = spark.createDataFrame(rows, "score double, member int")
    assert leakage.auc(df).first().auc == pytest.approx((2 + 1.5) / 4)
    assert {r.level: r.tpr for r in leakage.tpr_at_fpr(df).collect()}[0.01] == 0.5
    assert leakage.auc(df.limit(0)).first().auc is None


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double")
    got = {r.p: r.q for r in audit.benjamini_hochberg(df).collect()}
    assert got[0.01] == pytest.approx(0.04) and got[0.04] == pytest.approx(0.0533333) and got[0.03] == pytest.approx(0.0533333) and got[0.5] == 0.5


def test_token_scores(spark):
    tokens = [(0, 3, None), (3, 6, -1.0), (6, 9, -2.0), (9, 12, -4.0), (12, 15, -8.0)]
    df = spark.createDataFrame([(tokens,)], "t array<struct<start:int,end:int,logprob:double>>")
    parts = df.select(audit.token_parts(F.col("t"), F.lit(6), F.lit(9)).alias("p")).select("p.*").first()
    assert (parts["all"], parts["value"], parts["suffix"]) == ([-1, -2, -4, -8], [-2], [-4, -8])
    assert df.select(audit.min_k(F.array(F.lit(-1.0), F.lit(-5.0), F.lit(-3.0)))).first()[0] == -5
    assert df.select(audit.log_mean_exp(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == 0


def test_scorer_and_evidence(spark):
    def familiar(texts):
        return [[(i, i + 1, -0.1 if "in1" in t else -3.0) for i in range(len(t))] for t in texts]

    texts = spark.createDataFrame([("in1 a",), ("zz b",), ("in1 a",)], "text string")
    scored = audit.score_texts(texts, familiar)
    assert scored.count() == 3
    means = {r.text: r.m for r in scored.select("text", audit.mean_loss(F.transform("tokens", lambda t: t["logprob"])).alias("m")).collect()}
    assert means["in1 a"] > means["zz b"]
    rows = [(i, "EMAIL", m, (2.0 if m == "loss" else 0.0) + math.sin(i), math.cos(i)) for i in range(80) for m in ("loss", "min_k")]
    long = spark.createDataFrame(rows, "entity long, entity_type string, method string, member double, control double")
    got = audit.gather(long, ["loss", "min_k"])
    assert {r.method for r in got.select("method").distinct().collect()} == {"loss"} and got.count() == 80


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    m = leakage.regression_metrics(df, "y", "p").first()
    assert m.mae == 0.5 and m.r2 == pytest.approx(1 - 1.25 / (14 / 3))
    lab = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.6), (1, 0, 0.4), (0, 0, 0.1)], "y int, p int, q double")
    m = leakage.binary_metrics(lab, "y", "p", "q").first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (0.5, 0.5, 0.5, 0.5)


def test_drift_counts_each_feature_once(spark):
    """The one count of a feature's values gives what the single tests give; numbers and times are not all made distinct."""
    from pyspark.sql import functions as F

    from veilmark.operators import drift, profile

    def side(n, shift):
        return spark.range(n).select((F.col("id") * 37 % 101 + shift).cast("double").alias("x"), F.concat(F.lit("c"), (F.col("id") * 7 % (23 + shift)).cast("string")).alias("kind"), F.timestamp_seconds(F.col("id") * 86400).alias("at"))

    a, b = side(600, 0), side(500, 4)
    got = {r.column: r for r in drift.check_drift(a, b).collect()}
    for c, (x, y) in {"x": (a, b), "at": [df.select(profile.datetime_days(F.col("at"), df.schema["at"].dataType).alias("at")) for df in (a, b)]}.items():
        assert got[c].psi == drift.psi_numeric(x, y, c).first().psi
    assert got["kind"].psi == drift.psi_categorical(*drift.pooled(a, b, "kind"), "kind").first().psi and got["kind"].unseen == 4
    assert drift.drift_and_problems(a, b)[1] == 0
    plan = profile.column_roles(a.select("x", "at"))._jdf.queryExecution().toString()
    assert "Expand" not in plan and "distinct" not in plan
