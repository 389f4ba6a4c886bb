"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Grams of one to three characters are hashed to ``slots``; a text's feature is the share of its grams in a
slot times the slot's inverse document frequency, counted over *all* training texts.  Weights are fitted by
follow-the-regularised-leader with elastic-net penalties on at most ``rows_per_language`` training texts of
each language, picked by hash, and a temperature is fitted on a fifth of them that the weights don't see.

Defined results: a null, empty or letterless text is ``und`` with score 0; rows with a null language never
train; without any training text every row is ``und``; repeated rows each give a row; the smaller language
name wins an exact tie; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import language_kernels, linear
from .staging import ship

ship(language_kernels, linear, __name__)


@dataclass(frozen=True)
class LanguageParams:
    slots: int = 1 << 14
    #: bound of the sample that weights are fitted on; counts use every training text
    rows_per_language: int = 600
    #: times that an equal text counts in it at most
    repeats: int = 20
    #: factor that brings gram shares to a scale of about one
    scale: float = 50.0
    alpha: float = 0.3
    l1: float = 0.05
    l2: float = 0.01
    epochs: int = 2
    seed: int = 11


@dataclass(frozen=True)
class LanguageModel:
    names: list[str]
    #: slots x languages: inverse document frequency times weight, over the temperature
    table: np.ndarray
    params: LanguageParams


def train(spark: SparkSession, docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Fit on docs(text, lang)."""
    p = params
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counted = docs.select("text").mapInArrow(language_kernels.document_frequency(p), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    df = np.zeros(p.slots + 1)
    for row in counted.collect():  # slots + 1 rows; the last is the number of texts
        df[row.slot] = row.n
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    sample = docs.join(F.broadcast(_least_hashes(docs.select("lang", F.xxhash64("text").alias("h")), p.rows_per_language)), ["lang"]).where(F.xxhash64("text") <= F.col("most")).groupBy("text", "lang").count()
    # equal texts count, up to a bound
    sample = sample.select("text", "lang", F.explode(F.sequence(F.lit(1).cast("long"), F.least("count", F.lit(p.repeats).cast("long")))).alias("copy")).drop("copy")
    rows = sample.mapInArrow(language_kernels.gram_counts(p), "lang string, at binary, n binary").collect()
    names = sorted({r.lang for r in rows})
    rows.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.n)))
    data, labels = [], []
    for r in rows:
        at, n = np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.int64).astype(float)
        if len(at):
            data.append((at, p.scale * n / n.sum() * idf[at]))
            labels.append(names.index(r.lang))
    labels = np.array(labels, dtype=int)
    part = np.random.default_rng(p.seed).permutation(len(data)) % 5 == 0
    fit = linear.Ftrl(p.slots, max(1, len(names)), alpha=p.alpha, l1=p.l1, l2=p.l2).fit([x for x, out in zip(data, part, strict=True) if not out], labels[~part], p.epochs, p.seed)
    weights = fit.weights()
    logits = np.array([x @ weights[at] for (at, x), out in zip(data, part, strict=True) if out]).reshape(-1, max(1, len(names)))
    return LanguageModel(names, (p.scale * idf[:, None] * weights / linear.fit_temperature(logits, labels[part])).astype(np.float32), p)


def _least_hashes(rows: DataFrame, n: int) -> DataFrame:
    """(lang, most): the n-th least different hash of each language, from rows(lang, h); ranked inside parts of each language first."""
    rows = rows.distinct()
    by_part = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h")
    least = rows.withColumn("rank", F.row_number().over(by_part)).where(F.col("rank") <= n).drop("rank")  # 64 n rows of a language at most
    by_lang = Window.partitionBy("lang").orderBy("h")
    return least.withColumn("rank", F.row_number().over(by_lang)).where(F.col("rank") <= n).groupBy("lang").agg(F.max("h").alias("most"))


def predict(spark: SparkSession, docs: DataFrame, model: LanguageModel, *keep: Column) -> DataFrame:
    """The columns kept, then lang_pred and score, of each row of docs(text)."""
    text = F.col("text").cast("string")
    rows = docs.select(*keep, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("has_letter"), text.alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    table = spark.sparkContext.broadcast((model.names, model.table))  # slots x languages
    return rows.mapInArrow(language_kernels.predictor(table, model.params), f"{kept}, lang_pred string, score double")
