"""Membership leakage, model metrics and generalisation gaps over tables of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.running import running_totals

FPR_LEVELS = (0.001, 0.01, 0.05)  # fixed values


def _counts(scores: DataFrame, score: str, member: str) -> DataFrame:
    """score, pos, neg of each distinct score; nulls and NaN dropped."""
    clean = scores.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return clean.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(member).cast("int")).cast("double").alias("pos"), F.sum(1 - F.col(member).cast("int")).cast("double").alias("neg"))


def auc(scores: DataFrame, score: str = "score", member: str = "member") -> DataFrame:
    """One row: auc by average ranks; null without both sides."""
    ranked = running_totals(_counts(scores, score, member), "score", {"cp": "pos", "cn": "neg"})
    won = F.sum(F.col("pos") * (F.col("cn") - F.col("neg") / 2))
    return ranked.agg((won / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def roc(scores: DataFrame, score: str = "score", member: str = "member") -> DataFrame:
    """score, tpr, fpr of each distinct threshold, tied scores as one."""
    counts = _counts(scores, score, member)
    ranked = running_totals(counts, "score", {"tp": "pos", "fp": "neg"}, descending=True)
    total = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return ranked.crossJoin(F.broadcast(total)).select("score", (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("n")).alias("fpr"))  # one row of totals


def tpr_at_fpr(scores: DataFrame, levels: tuple[float, ...] = FPR_LEVELS, score: str = "score", member: str = "member") -> DataFrame:
    """level, tpr: the best true-positive rate whose false-positive rate is within the level."""
    curve = roc(scores, score, member)
    best = curve.agg(*[F.coalesce(F.max(F.when(F.col("fpr") <= x, F.col("tpr"))), F.lit(0.0)).alias(f"t{i}") for i, x in enumerate(levels)])
    return best.select(F.inline(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"t{i}").alias("tpr")) for i, x in enumerate(levels)])))


def log_loss(p_true: Column) -> Column:
    return -F.log(F.least(F.greatest(p_true, F.lit(1e-12)), F.lit(1.0)))


def squared_error(y: Column, predicted: Column) -> Column:
    return F.pow(y - predicted, 2)


def loss_threshold_attack(members: DataFrame, others: DataFrame, loss: str = "loss", fpr: float = 0.01) -> DataFrame:
    """One row: mia_auc, tpr_at_low_fpr, and the mean losses of both sides; a lower loss speaks for membership."""
    both = members.select((-F.col(loss)).alias("score"), F.lit(1).alias("member")).unionByName(others.select((-F.col(loss)).alias("score"), F.lit(0).alias("member")))
    means = both.agg((-F.avg(F.when(F.col("member") == 1, F.col("score")))).alias("member_loss"), (-F.avg(F.when(F.col("member") == 0, F.col("score")))).alias("other_loss"))
    low = tpr_at_fpr(both, (fpr,)).select(F.col("tpr").alias("tpr_at_low_fpr"))
    return auc(both).withColumnRenamed("auc", "mia_auc").crossJoin(low).crossJoin(means)  # one row each


def binary_metrics(df: DataFrame, label: str, predicted: str, probability: str) -> DataFrame:
    """One row: accuracy, precision, recall, f1, brier, positive_rate of 0/1 labels."""
    y, p = F.col(label).cast("int"), F.col(predicted).cast("int")
    tp, fp, fn = F.count_if((y == 1) & (p == 1)), F.count_if((y == 0) & (p == 1)), F.count_if((y == 1) & (p == 0))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return df.where(y.isNotNull()).agg(F.avg((y == p).cast("int")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.avg(F.pow(F.col(probability) - y, 2)).alias("brier"), F.avg(p.cast("double")).alias("positive_rate"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def regression_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: rmse, mae, r2, baseline_rmse (population standard deviation of the label)."""
    y, e = F.col(label), F.col(label) - F.col(predicted)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"), F.stddev_pop(y).alias("baseline_rmse"))


def generalization_gap(train: DataFrame, test: DataFrame, metric: str, label: str = "label", predicted: str = "predicted", loss: str = "loss") -> DataFrame:
    """One row: generalization_gap. Accuracy and R2 are train minus test, log loss is test minus train."""
    if metric == "accuracy":
        one = lambda df: df.agg(F.avg((F.col(label) == F.col(predicted)).cast("int")).alias("v"))
    elif metric == "r2":
        one = lambda df: regression_metrics(df, label, predicted).select(F.col("r2").alias("v"))
    else:
        one = lambda df: df.agg(F.avg(loss).alias("v"))
    sign = -1 if metric == "log_loss" else 1
    return one(train).withColumnRenamed("v", "a").crossJoin(one(test)).select(((F.col("a") - F.col("v")) * sign).alias("generalization_gap"))  # one row each


def live_score(df: DataFrame, label: str, predicted: str, baseline: float, tolerance: float) -> DataFrame:
    """One row: score, degraded. Labels compare as trimmed text."""
    same = F.trim(F.col(label).cast("string")) == F.trim(F.col(predicted).cast("string"))
    return df.where(F.col(label).isNotNull()).agg(F.avg(same.cast("int")).alias("score")).withColumn("degraded", F.col("score") < baseline - tolerance)
