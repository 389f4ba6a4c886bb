"""Composite plans: the privacy gate and batch monitoring."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import entity_of_name
from ..functions.patterns import ENTITIES
from ..operators import drift, policy, reid


def name_identifiers(df: DataFrame) -> list[str]:
    """Columns whose name says they hold a direct identifier."""
    return [c for c in df.columns if (e := entity_of_name(c)) and ENTITIES[e][1]]


def privacy_gate(df: DataFrame, quasi_identifiers: list[str], sensitive: str | None, rules: dict[str, Any]) -> DataFrame:
    """rule, observed, result of a table: identifiers by column name, k-anonymity, uniqueness and l-diversity."""
    spark = df.sparkSession
    risk = reid.assess(df, quasi_identifiers, sensitive)
    named = spark.createDataFrame([("pii_columns_max", float(len(name_identifiers(df))))], "rule string, observed double")
    one = risk.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c).cast("double").alias("observed")) for r, c in (("min_k_anonymity", "k_anonymity"), ("unique_record_fraction_max", "unique_fraction"), ("min_l_diversity", "l_diversity"))])))
    return policy.evaluate(policy.rule_table(spark, rules), named.union(one))


def monitor(reference: DataFrame, batch: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row: features, drifted, schema_problems, retrain."""
    report, problems = drift.drift_and_problems(reference, batch, exclude=exclude)
    out = report.agg(F.count("*").alias("features"), F.count_if("drifted").alias("drifted"))
    return out.withColumn("schema_problems", F.lit(problems)).withColumn("retrain", (F.col("drifted") > 0) | (F.lit(problems) > 0))
