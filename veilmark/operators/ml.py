"""Model selection on tables with Spark ML: families, grids, cross-validation and an honest choice."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.running import running_totals
from .profile import FeaturePlan, apply_plan

RARE_ROWS, MAX_CATEGORIES, STRENGTHS = 5, 50, [0.001, 0.01, 0.1, 1.0, 10.0]  # fixed values


def feature_stages(df: DataFrame, label: str, linear: bool) -> list:
    """Imputed (and for linear models scaled) numbers and indexed (one-hot) categories into `features`."""
    texts = [c for c, t in df.dtypes if t == "string" and c != label]
    numbers = [c for c, t in df.dtypes if t != "string" and c != label]
    stages: list = []
    if numbers:
        stages.append(Imputer(strategy="median", inputCols=numbers, outputCols=[f"{c}__i" for c in numbers]))
    if texts:
        stages.append(StringIndexer(inputCols=texts, outputCols=[f"{c}__x" for c in texts], handleInvalid="keep"))
    cats = [f"{c}__x" for c in texts]
    if linear and texts:
        stages.append(OneHotEncoder(inputCols=cats, outputCols=[f"{c}__h" for c in texts], handleInvalid="keep"))
        cats = [f"{c}__h" for c in texts]
    stages.append(VectorAssembler(inputCols=[*[f"{c}__i" for c in numbers], *cats], outputCol="raw" if linear else "features", handleInvalid="keep"))
    if linear:
        stages.append(StandardScaler(inputCol="raw", outputCol="features"))
    return stages


def pooled_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Categories of fewer than five rows, or beyond the fifty most frequent, as one."""
    for c in columns:
        top = [r[0] for r in df.groupBy(c).count().where(F.col("count") >= RARE_ROWS).orderBy(F.desc("count"), c).limit(MAX_CATEGORIES).collect() if r[0] is not None]
        df = df.withColumn(c, F.when(F.col(c).isin(top), F.col(c)).when(F.col(c).isNotNull(), "__rare__"))
    return df


class RestProbabilities(Transformer):
    """probability from the margins of one boosted model for each class against the rest, scaled to a sum of one."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        each = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        total = F.aggregate(each, F.lit(0.0), lambda s, p: s + p)
        return dataset.withColumn("probability", array_to_vector(F.transform(each, lambda p: p / total)))


def estimator(family: str, task: str, label: str, classes: int = 2):
    if task == "regression":
        return {"linear": LinearRegression(labelCol=label), "boosting": GBTRegressor(labelCol=label, maxIter=20), "forest": RandomForestRegressor(labelCol=label, seed=0)}[family]
    boosting = GBTClassifier(labelCol=label, maxIter=20)
    if classes > 2:
        boosting = OneVsRest(classifier=boosting, labelCol=label, rawPredictionCol="rawPrediction")
    return {"linear": LogisticRegression(labelCol=label), "boosting": boosting, "forest": RandomForestClassifier(labelCol=label, seed=0)}[family]


def pipeline(stages: list, model) -> Pipeline:
    return Pipeline(stages=[*stages, model, *([RestProbabilities()] if isinstance(model, OneVsRest) else [])])


def grid(model, family: str):
    b, tree = ParamGridBuilder(), model.getClassifier() if isinstance(model, OneVsRest) else model
    return (b.addGrid(model.regParam, STRENGTHS) if family == "linear" else b.addGrid(tree.maxDepth, [3, 5])).build()


def class_order(df: DataFrame, label: str, most: int = 1000) -> list[str]:
    """The classes as text, numbers by value before other texts; more than ``most`` are no classes."""
    text = F.col(label).cast("string")
    rows = df.where(text.isNotNull()).groupBy(text.alias("c")).agg(F.first(text.try_cast("double")).alias("v")).orderBy(F.asc_nulls_last("v"), "c").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{label} has more than {most} classes")
    return [r.c for r in rows]


def fold_column(df: DataFrame, folds: int, label: str, classes: bool) -> DataFrame:
    """Hash order dealt round-robin, inside each class for classification."""
    by = Window.partitionBy(label) if classes else Window.partitionBy(F.pmod(F.xxhash64(*df.columns), F.lit(64)))
    return df.withColumn("__fold", ((F.row_number().over(by.orderBy(F.xxhash64(*df.columns))) - 1) % folds).cast("int"))


@dataclass(frozen=True)
class Trial:
    """A setting's mean validation score (higher is better) with its standard error, and how much better the training side fits."""

    family: str
    score: float
    error: float
    gap: float
    model: PipelineModel | None = None


FAMILIES = ("linear", "boosting", "forest")


def evaluator(task: str, label: str):
    return RegressionEvaluator(labelCol=label, metricName="rmse") if task == "regression" else MulticlassClassificationEvaluator(labelCol=label, metricName="logLoss")


def fit_gap(model: PipelineModel, rows: DataFrame, fold: int, task: str) -> float:
    """Accuracy (of regressions: R squared) on the rows outside a fold, less that inside it, in one pass; nan without either side."""
    y, p = F.col("__label"), F.col("prediction")
    fits = []
    for side in (F.col("__fold") != fold, F.col("__fold") == fold):
        if task == "regression":
            fits.append(1 - F.sum(F.when(side, F.pow(y - p, 2))) / F.nullif(F.var_pop(F.when(side, y)) * F.count_if(side), F.lit(0.0)))
        else:
            fits.append(F.avg(F.when(side, (y == p).cast("double"))))
    gap = model.transform(rows).agg((fits[0] - fits[1]).alias("gap")).first().gap
    return math.nan if gap is None else gap


def trials_of(family: str, stages: list, model, settings: list, wide: DataFrame, task: str, folds: int) -> list[Trial]:
    """A trial for each setting; only the family's best one carries its model, fitted on all rows."""
    cv = CrossValidator(estimator=pipeline(stages, model), estimatorParamMaps=settings, evaluator=evaluator(task, "__label"), numFolds=folds, foldCol="__fold", parallelism=4, collectSubModels=True).fit(wide)
    best = min(range(len(settings)), key=lambda i: cv.avgMetrics[i])
    gaps = [sum(fit_gap(cv.subModels[k][i], wide, k, task) for k in range(folds)) / folds for i in range(len(settings))]
    return [Trial(family, -cv.avgMetrics[i], cv.stdMetrics[i] / folds**0.5, gaps[i], cv.bestModel if i == best else None) for i in range(len(settings))]


def cv_rows(folds: DataFrame) -> DataFrame:
    """family, setting, score, error, gap of folds(family, setting, fold, score, train_fit, fit): means over the folds, the score's
    standard error, and how much better the training side fits."""
    error = F.stddev_pop("score") / F.sqrt(F.count("score"))
    return folds.groupBy("family", "setting").agg(F.avg("score").alias("score"), error.alias("error"), F.avg(F.col("train_fit") - F.col("fit")).alias("gap"))


def ranked(trials: DataFrame, max_gap: float = 0.05, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """trials(family, setting, score, error, gap) with eligible and chosen, which holds for one row unless none has a finite score and gap.

    Eligible are the trials within max_gap, or where there is none the least overfit one.  Those whose score is within one standard error of the best
    eligible one compete by the order of families, then score, then setting.
    """
    order = F.array_position(F.array(*map(F.lit, families)), F.col("family"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
    rows = trials.withColumns({"__usable": finite("score") & finite("gap"), "__at": F.struct(order.alias("order"), (-F.col("score")).alias("score"), F.col("setting").alias("setting"))})
    one = lambda df: F.broadcast(df)  # noqa: E731  a row each
    calm = F.col("__usable") & (F.col("gap") <= max_gap)
    facts = rows.agg(F.count_if(calm).alias("__calm"), F.min(F.when(F.col("__usable"), F.struct("gap", "__at"))).alias("__least"))
    rows = rows.crossJoin(one(facts)).withColumn("eligible", F.when(F.col("__calm") > 0, calm).otherwise(F.col("__usable") & (F.col("__at") == F.col("__least.__at"))))
    top = rows.where("eligible").agg((F.max("score") - F.max_by("error", F.struct("score", (-order).alias("o")))).alias("__bar"))
    rows = rows.crossJoin(one(top))
    first = rows.where("eligible and score >= __bar").agg(F.min("__at").alias("__first"))
    return rows.crossJoin(one(first)).withColumn("chosen", F.coalesce(F.col("eligible") & (F.col("__at") == F.col("__first")), F.lit(False))).select(*trials.columns, "eligible", "chosen")


def _folded(df: DataFrame, plan: FeaturePlan, label: str, task: str, folds: int) -> tuple[DataFrame, list[str]]:
    """The features with __label and __fold, and the classes that __label numbers."""
    roles = {c: role for c, role in plan.roles.items() if c != label}
    classes = [] if task == "regression" else class_order(df, label)
    number = F.col(label).cast("double") if task == "regression" else F.nullif(F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("string")), F.lit(0)) - 1
    table = apply_plan(df.withColumn("__label", number.cast("double")), FeaturePlan(roles | {"__label": "numeric"}))
    return fold_column(table.where("__label is not null"), folds, "__label", task != "regression"), classes


@dataclass(frozen=True)
class Selection:
    """The chosen trial, its model fitted on all rows, the classes by the numbers that it predicts, and the trials of every setting."""

    trial: Trial
    model: PipelineModel
    classes: list[str]
    trials: list[Trial]

    def predicted(self, df: DataFrame, plan: FeaturePlan, label: str, name: str = "predicted") -> DataFrame:
        """df's features with the predicted class as text, or the predicted number."""
        out = self.model.transform(apply_plan(df, FeaturePlan({c: r for c, r in plan.roles.items() if c != label})))
        value = F.get(F.array(*map(F.lit, self.classes)), F.col("prediction").cast("int")) if self.classes else F.col("prediction")
        return out.withColumn(name, value)


def select_model(df: DataFrame, plan: FeaturePlan, label: str, task: str, folds: int = 3, families: tuple[str, ...] = FAMILIES, max_gap: float = 0.05) -> Selection:
    """Cross-validates every setting of every family and chooses by ``ranked``; labels may be numbers or texts of any number of classes, and rows without one are left out."""
    wide, classes = _folded(df, plan, label, task, folds)
    trials, made = [], []
    for family in families:
        model = estimator(family, task, "__label", len(classes))
        stages, settings = feature_stages(wide.drop("__fold"), "__label", family == "linear"), grid(model, family)
        trials += trials_of(family, stages, model, settings, wide, task, folds)
        made += [(stages, model, s) for s in settings]
    rows = df.sparkSession.createDataFrame([(t.family, i, float(t.score), float(t.error), float(t.gap)) for i, t in enumerate(trials)], "family string, setting int, score double, error double, gap double")
    at = ranked(rows, max_gap, families).where("chosen").select("setting").first()
    if at is None:
        raise ValueError("no setting of any family could be trained")
    chosen = trials[at.setting]
    if chosen.model is None:
        stages, model, setting = made[at.setting]
        chosen = replace(chosen, model=pipeline(stages, model).fit(wide, setting))
    return Selection(chosen, chosen.model, classes, trials)


def overfit_model(df: DataFrame, plan: FeaturePlan, label: str, task: str, folds: int = 3, trees: int = 200) -> Trial:
    """A forest of full trees without bootstrap, with the same evidence as chosen models: what a leakage audit must find."""
    wide, _ = _folded(df, plan, label, task, folds)
    model = estimator("forest", task, "__label").setBootstrap(False).setNumTrees(trees).setMaxDepth(30).setFeatureSubsetStrategy("all")
    return trials_of("forest", feature_stages(wide.drop("__fold"), "__label", False), model, [{}], wide, task, folds)[0]


def rank_strata(df: DataFrame, column: str, bins: int = 5, name: str = "stratum") -> DataFrame:
    """df with the quantile bin (0 to bins - 1) of the rank of column's value; equal values share a bin, null has none.

    Ranks come from running totals over the distinct values, so no task orders all rows.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    totals = running_totals(counts, "__v", {"__cum": "__n"})
    whole = counts.agg(F.sum("__n").alias("__all"))  # one row
    binned = totals.crossJoin(F.broadcast(whole)).select("__v", F.floor((F.col("__cum") - F.col("__n")) * bins / F.col("__all")).cast("int").alias(name))
    return df.join(binned, df[column] == F.col("__v"), "left").drop("__v")


def stratified_split(df: DataFrame, by: list[str], test_share: float, order: str) -> DataFrame:
    """df with is_test: in each stratum the first rows by hash, at least one on each side of strata of two or more."""
    w = Window.partitionBy(*by)
    cut = F.greatest(F.lit(1), F.least(F.round(F.count("*").over(w) * test_share), F.count("*").over(w) - 1))
    ranked = df.withColumn("__rn", F.row_number().over(w.orderBy(F.xxhash64(order), order)))
    return ranked.withColumn("is_test", (F.col("__rn") <= cut) & (F.count("*").over(w) > 1)).drop("__rn")
