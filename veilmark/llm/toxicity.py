"""Toxicity by classifier chains.

Categories are predicted in order.  The model of each is a sparse linear one over the distinct words and
word beginnings of a text, to which the probabilities of the categories before it are added as features.  For training these come
from models that have not seen the row (out-of-fold), so later models learn how far to trust them.

The last category decides: its model sees the probabilities of all the others.

Weights are fitted on a bounded sample of labelled texts, at most ``rows_flagged`` with the last category and
``rows_other`` without, picked by hash; its probability is corrected to its share among all labelled
rows.  Each model trains on the rows that have its own label.  Prediction covers every text whole.

Defined results: a null or wordless text gets the probabilities of the bare intercept and is not flagged;
rows with a null doc_id never train, and those with a null label not that category's model; conflicting or repeated labels of
a doc_id count as flagged if any is; equal texts train once; a category without labels of both kinds has
probability 0, and without the last one nothing is flagged; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear, toxicity_kernels
from .staging import ship

ship(toxicity_kernels, linear, __name__)


@dataclass(frozen=True)
class ToxicityParams:
    slots: int = 1 << 20
    #: word beginnings, in bytes, that are features beside whole words
    prefixes: tuple[int, ...] = (4, 5, 6, 7, 8, 9)
    rows_flagged: int = 1000
    rows_other: int = 4000
    folds: int = 3
    epochs: int = 2
    alpha: float = 0.5
    l1: float = 3.0
    l2: float = 0.05
    seed: int = 5
    threshold: float = 0.5


@dataclass(frozen=True)
class ToxicityModel:
    categories: list[str]
    #: for each category the slots with a weight, these weights, intercept, and weights of the categories before it
    links: list[tuple[np.ndarray, np.ndarray, float, list[float]]]
    params: ToxicityParams


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories: list[str], params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit a chain on docs(doc_id, text) and labels(doc_id, one 0/1 column for each category)."""
    p = params
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna(subset=["doc_id"])
    labels = labels.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    last = categories[-1]
    totals = {r[last]: r["count"] for r in labels.groupBy(last).count().collect() if r[last] is not None}
    marked = labels.where(F.col(last) == 1)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = marked.orderBy(*order).limit(p.rows_flagged).union(labels.where(F.coalesce(F.col(last) != 1, F.lit(True))).orderBy(*order).limit(p.rows_other))
    # the sample's size is bounded by the parameters
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.mapInArrow(toxicity_kernels.word_slots(p, categories), ", ".join(f"`{c}` int" for c in categories) + ", at binary").collect()
    unique = {bytes(r.at): r for r in rows if len(r.at)}
    rows = [unique[k] for k in sorted(unique)]
    at = [np.frombuffer(r.at, np.int32) for r in rows]
    known = np.array([[-1 if r[c] is None else int(r[c] == 1) for c in categories] for r in rows], dtype=int).reshape(len(rows), len(categories))
    fold = np.random.default_rng(p.seed).permutation(len(rows)) % p.folds
    links: list[tuple[np.ndarray, np.ndarray, float, list[float]]] = []
    earlier = np.zeros((len(rows), 0))
    for k in range(len(categories)):
        y = known[:, k]
        own = np.flatnonzero(y >= 0)
        if len(set(y[own].tolist())) < 2:
            links.append((np.zeros(0, np.int32), np.zeros(0), -20.0, [0.0] * k))
            earlier = np.column_stack([earlier, np.zeros(len(rows))])
            continue
        data = [_row(x, earlier[i], p) for i, x in enumerate(at)]
        held = np.zeros(len(rows))
        for f in range(p.folds):
            rest = own[fold[own] != f]
            w = _fit([data[i] for i in rest], y[rest], k, p)
            for i in np.flatnonzero(fold == f):
                held[i] = 1 / (1 + math.exp(-np.clip(data[i][1] @ w[data[i][0]], -30, 30)))
        w = _fit([data[i] for i in own], y[own], k, p)
        shift = 0.0
        if k == len(categories) - 1:
            bad = int(y[own].sum())
            shift = math.log(bad / (len(own) - bad)) - math.log(totals[1] / (sum(totals.values()) - totals[1]))
        used = np.flatnonzero(w[: p.slots]).astype(np.int32)
        links.append((used, w[used], float(w[p.slots]) - shift, [float(x) for x in w[p.slots + 1 :]]))
        earlier = np.column_stack([earlier, held])
    return ToxicityModel(categories, links, p)


def _row(slots: np.ndarray, earlier: np.ndarray, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    extra = p.slots + np.arange(1 + len(earlier))
    return np.concatenate([slots, extra]).astype(np.int64), np.concatenate([np.ones(len(slots) + 1), earlier])


def _fit(data: list, y: np.ndarray, earlier: int, p: ToxicityParams) -> np.ndarray:
    w = linear.Ftrl(p.slots + 1 + earlier, 2, alpha=p.alpha, l1=p.l1, l2=p.l2).fit(data, y, p.epochs, p.seed).weights()
    return w[:, 1] - w[:, 0]


def predict(spark: SparkSession, docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, flagged and p_<category> of each row of docs(doc_id, text); flagged goes by the last category."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    links = spark.sparkContext.broadcast(model.links)  # at most slots weights for each category
    kind = docs.schema["doc_id"].dataType.simpleString()
    shares = ", ".join(f"`p_{c}` double" for c in model.categories)
    return rows.mapInArrow(toxicity_kernels.predictor(links, model.params, model.categories), f"doc_id {kind}, flagged boolean, {shares}")
