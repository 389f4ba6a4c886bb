"""Exact running totals over a whole table without a one-task window.

Values are dealt into ranges by approximate quantiles; totals run inside a range, and the totals of the ranges
before it are added.  The result doesn't depend on how good the quantiles are, only the balance does.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, order: str, totals: dict[str, str], descending: bool = False, ranges: int = 256) -> DataFrame:
    """df with, for each name: column of totals, the running sum up to and including rows of equal order."""
    cuts = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000).alias("q")).first()["q"] or []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    part = F.size(F.filter(edges, lambda e: F.col(order) >= e))
    df = df.withColumn("__part", part)
    by = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy("__part").orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in totals.items()])
    first = F.col("__part").desc() if descending else F.col("__part").asc()
    before = Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)  # at most `ranges` rows
    sums = sums.select("__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in totals])
    out = df.select("*", *[F.sum(c).over(inside).alias(n) for n, c in totals.items()]).join(F.broadcast(sums), "__part")
    return out.select(*[c for c in df.columns if c != "__part"], *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in totals])


def quantiles(df: DataFrame, x: Column, levels: list[float]) -> list[float]:
    """Exact quantiles of the numbers that are not null, interpolated between neighbours; empty without any.

    Distinct values are counted and ranked in ranges, so no task holds all of them as an aggregate over a whole column would.
    """
    return count_quantiles(df.select(x.cast("double").alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("n")), levels)


def count_quantiles(counts: DataFrame, levels: list[float]) -> list[float]:
    """quantiles() of rows (x, n): a distinct number and how often it is there."""
    ranked = running_totals(counts, "x", {"upto": "n"}).persist()
    try:
        size = ranked.agg(F.max("upto")).first()[0]
        if not size:
            return []
        places = [level * (size - 1) for level in levels]
        ends = sorted({int(p) for p in places} | {math.ceil(p) for p in places})
        row = ranked.agg(*[F.min(F.when(F.col("upto") > r, F.col("x"))).alias(f"r{r}") for r in ends]).first()
    finally:
        ranked.unpersist()
    at = lambda p: (row[f"r{int(p)}"], row[f"r{math.ceil(p)}"])
    return [low if low == high else (math.ceil(p) - p) * low + (p - int(p)) * high for p, (low, high) in ((p, at(p)) for p in places)]


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over tasks for all cores: rows of few bytes that take long to work on otherwise come in one task or two."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; where it is unset in the warehouse, or on one machine in a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="veilmark-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in a shared folder and read again, so that what follows neither works it out nor plans it again."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def half_up(x: Column, digits: int) -> Column:
    return F.round(x, digits)
