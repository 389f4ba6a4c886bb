"""Span detection, sanitising and stable splits."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.grammars import key_of
from .detectors import SPANS, Detector, spans


def detect(text: Column, detectors: Sequence[Detector | str] = ("patterns",)) -> Column:
    """Non-overlapping spans in code points; texts without any sign of one don't leave the JVM."""
    return spans(text, detectors)


def detect_records(df: DataFrame, text: str = "text", detectors: Sequence[Detector | str] = ("patterns",)) -> DataFrame:
    """df with entities."""
    return df.withColumn("entities", spans(F.col(text), detectors))


def fingerprint(key: bytes) -> Callable[[Column, Column], Column]:
    """HMAC-SHA256 of type:value."""

    @F.pandas_udf(T.StringType())
    def run(kind: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([hmac.new(key, f"{k}:{v}".encode(), hashlib.sha256).hexdigest() for k, v in zip(kind, value, strict=True)])

    return run


# --- sanitising -----------------------------------------------------------------------------------
def surrogate(kind: Column, value: Column, seed: Column | int = 0) -> Column:
    """A value of the same shape that depends on (seed, type, value) alone, so it is the same everywhere."""
    digest = F.sha2(key_of(kind, value, seed).cast("binary"), 256)
    digit = lambda i: F.conv(F.substring(digest, F.pmod(i * 2, F.lit(60)) + 1, 2), 16, 10).cast("int")

    def one(c: Column, i: Column) -> Column:
        n = digit(i)
        letter = lambda base: F.char(F.lit(ord(base)) + n % 26)
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), letter("a")).when(c.rlike("[A-Z]"), letter("A")).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def sanitize(records: DataFrame, strategy: str = "surrogate", types: list[str] | None = None, seed: int = 0, chosen: str | None = None, make: Callable[..., Column] | None = None) -> DataFrame:
    """records(id, text, entities) with spans replaced left to right (surrogate or mask), or records with any dropped.

    types limits the spans by type, chosen to those that a column array<struct<start, end>> lists (null: none); all other
    spans stay and move along. make(type, value, seed) gives other surrogates; where it gives null, the shape decides.
    """
    hit = lambda e: (e["entity_type"].isin(types) if types else F.lit(True)) & (F.exists(F.coalesce(F.col(chosen), F.array().cast("array<struct<start:int,end:int>>")), lambda c: (c["start"] == e["start"]) & (c["end"] == e["end"])) if chosen else F.lit(True))
    spans_ = F.array_sort(F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["entity_type"].alias("entity_type"), hit(e).alias("hit"))))
    rows = records.withColumn("__spans", spans_).withColumn("__any", F.exists("__spans", lambda e: e["hit"]))
    if strategy == "drop":
        return rows.where("not coalesce(__any, false)").drop("__spans", "__any")
    cut = lambda a, n: F.substring(F.col("text"), a, n)

    def replaced(e: Column) -> Column:
        value = cut(e["start"] + 1, e["end"] - e["start"])
        if strategy == "mask":
            return F.when(e["hit"], F.concat(F.lit("["), e["entity_type"], F.lit("]"))).otherwise(value)
        new = surrogate(e["entity_type"], value, seed)
        return F.when(e["hit"], F.coalesce(make(e["entity_type"], value, seed), new) if make else new).otherwise(value)

    named = rows.withColumn("__new", F.transform("__spans", lambda e: F.struct(e.alias("e"), replaced(e).alias("new"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        e = x["e"]
        out = F.concat(acc["out"], cut(acc["at"] + 1, e["start"] - acc["at"]), x["new"])
        one = F.struct((F.length(out) - F.length(x["new"])).alias("start"), F.length(out).alias("end"), e["entity_type"].alias("entity_type"))
        return F.struct(e["end"].alias("at"), out.alias("out"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    done = named.withColumn("__done", F.aggregate("__new", zero, step))
    text = F.concat(F.col("__done.out"), cut(F.col("__done.at") + 1, F.length("text")))
    out = done.withColumn("text", F.when(F.col("__any"), text).otherwise(F.col("text"))).withColumn("entities", F.when(F.col("__any"), F.col("__done.spans")).otherwise(F.col("entities")))
    return out.drop("__spans", "__any", "__new", "__done")


def translate(wanted: DataFrame, raw: DataFrame, train: DataFrame, only_original: bool = False) -> DataFrame:
    """Spans of the training copy at the places (id, ordinal) of wanted spans (id, start, end) of the raw copy;
    records whose span counts differ are skipped, and with only_original values that were replaced before."""
    value = lambda e: F.substring("text", e["start"] + 1, e["end"] - e["start"])
    held = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), value(e).alias("value")))
    at = lambda df, name: df.select("id", F.size("entities").alias(f"n_{name}"), F.posexplode(held).alias("pos", name))
    both = at(raw, "r").join(at(train, "t"), ["id", "pos"]).where("n_r = n_t")
    if only_original:
        both = both.where("r.value <=> t.value")
    both = both.select("id", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("t.start").alias("train_start"), F.col("t.end").alias("train_end"))
    return both.join(wanted.select("id", "start", "end").distinct(), ["id", "start", "end"], "left_semi")


def risky_spans(findings: DataFrame, records: DataFrame, minimum: str = "high", always: list[str] | None = None) -> DataFrame:
    """id and spans: findings of at least a severity, and every span of the types always wanted."""
    risky = findings.where(P.at_least(F.col("severity"), minimum)).select("id", "start", "end")
    if always:
        risky = risky.union(records.select("id", F.inline("entities")).where(F.col("entity_type").isin(always)).select("id", "start", "end"))
    return risky.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


# --- stable splits ----------------------------------------------------------------------------------
def hash_bucket(key: Column, buckets: int) -> Column:
    """First four bytes of SHA-256, big-endian, modulo the number of buckets."""
    return (F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("long") % buckets).cast("long")


def split_holdout(records: DataFrame, key: str = "id", share: float = 0.1) -> DataFrame:
    return records.withColumn("holdout", hash_bucket(F.col(key), 10_000) < round(share * 10_000))


def repeat_split(records: DataFrame, key: str = "id", salt: str = "split") -> DataFrame:
    """60/20/20 split by salted hash and a repeat count of 1, 2, 4 or 8 for training rows."""
    salted = lambda s: F.concat(F.lit(f"{s}:"), F.col(key).cast("string"))
    part = hash_bucket(salted(salt), 5)
    split = F.when(part < 3, "train").when(part == 3, "holdout").otherwise("unseen")
    repeats = F.when(split == "train", F.pow(F.lit(2), hash_bucket(salted(f"{salt}-repeat"), 4))).otherwise(1).cast("long")
    return records.withColumn("split", split).withColumn("repeats", repeats)

