"""Re-identification risk: class sizes, k-anonymity, uniqueness, l-diversity, minimal risky combinations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import suggested_quasi_identifiers


def class_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per combination of values; null is a value."""
    return df.groupBy(*columns).agg(F.count("*").alias("class_size"))


def k_anonymity(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: k_anonymity, null for no rows."""
    return class_sizes(df, columns).agg(F.min("class_size").alias("k_anonymity"))


def unique_fraction(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: unique_fraction, 0 for no rows."""
    share = F.count_if(F.col("class_size") == 1) / F.sum("class_size")
    return class_sizes(df, columns).agg(F.coalesce(share, F.lit(0.0)).alias("unique_fraction"))


def l_diversity(df: DataFrame, columns: list[str], sensitive: str) -> DataFrame:
    """One row: l_diversity; a null sensitive value counts as a value."""
    values = F.count_distinct(sensitive) + F.max(F.col(sensitive).isNull().cast("int"))
    return df.groupBy(*columns).agg(values.alias("l")).agg(F.min("l").alias("l_diversity"))


def at_risk(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """One row: records in classes of fewer than k."""
    small = F.sum(F.when(F.col("class_size") < k, F.col("class_size")).otherwise(0))
    return class_sizes(df, columns).agg(F.coalesce(small, F.lit(0)).alias("at_risk"))


def combination_uniqueness(df: DataFrame, columns: list[str], max_size: int = 3, sets_per_pass: int = 64) -> DataFrame:
    """columns (comma-joined), size, unique_fraction of every subset up to max_size.

    Subsets are counted as grouping sets over the pre-aggregated distinct rows, so the table is read once
    and only its distinct combinations are expanded.
    """
    subsets = [c for n in range(1, max_size + 1) for c in combinations(columns, n)]
    base = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    out = None
    for at in range(0, len(subsets), sets_per_pass):
        part = subsets[at : at + sets_per_pass]
        sized = base.groupingSets([[F.col(c) for c in s] for s in part], *columns).agg(F.grouping_id().alias("__g"), F.sum("__n").alias("__size"))
        ids = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s): s for s in part}
        name = F.create_map(*[x for g, s in ids.items() for x in (F.lit(g), F.lit(",".join(s)))])
        size = F.create_map(*[x for g, s in ids.items() for x in (F.lit(g), F.lit(len(s)))])
        counted = sized.groupBy("__g").agg((F.count_if(F.col("__size") == 1) / F.sum("__size")).alias("unique_fraction"))
        counted = counted.select(name[F.col("__g").cast("int")].alias("columns"), size[F.col("__g").cast("int")].alias("size"), "unique_fraction")
        out = counted if out is None else out.union(counted)
    return out


def risky_combinations(df: DataFrame, columns: list[str], max_size: int = 3, threshold: float = 0.01) -> DataFrame:
    """The minimal subsets whose unique fraction is above the threshold, most unique first."""
    risky = combination_uniqueness(df, columns, max_size).where(F.col("unique_fraction") > threshold)
    part = F.split("columns", ",")
    inner = risky.select(part.alias("__inner"), F.col("size").alias("__inner_size"))
    # a subset set is at most a few hundred rows
    superset = (F.col("__inner_size") < F.col("size")) & (F.size(F.array_except("__inner", part)) == 0)
    return risky.join(F.broadcast(inner), superset, "left_anti").orderBy(F.desc("unique_fraction"), "columns")


def severity_of_k(k: Column) -> Column:
    return F.when(k <= 1, "critical").when(k < 5, "high").when(k < 10, "medium").otherwise("low")


def assess(df: DataFrame, quasi_identifiers: list[str] | None = None, sensitive: str | None = None) -> DataFrame:
    """One row: quasi_identifiers, k_anonymity, unique_fraction, l_diversity; nulls without quasi-identifiers."""
    columns = suggested_quasi_identifiers(df.columns) if quasi_identifiers is None else [c for c in quasi_identifiers if c in df.columns]
    if not columns:
        return df.sparkSession.sql("SELECT '' AS quasi_identifiers, CAST(NULL AS BIGINT) AS k_anonymity, CAST(NULL AS DOUBLE) AS unique_fraction, CAST(NULL AS BIGINT) AS l_diversity")
    diverse = [(F.count_distinct(sensitive) + F.max(F.col(sensitive).isNull().cast("int"))).alias("l")] if sensitive else []
    sizes = df.groupBy(*columns).agg(F.count("*").alias("n"), *diverse)
    least = F.min("l") if sensitive else F.lit(None).cast("bigint")
    out = sizes.agg(F.min("n").alias("k_anonymity"), F.coalesce(F.count_if(F.col("n") == 1) / F.sum("n"), F.lit(0.0)).alias("unique_fraction"), least.alias("l_diversity"))
    return out.select(F.lit(",".join(columns)).alias("quasi_identifiers"), "*")


def findings(assessment: DataFrame, dataset: str, k: int = 5) -> DataFrame:
    """Findings of an assessment: scanner, category, severity, location, message."""
    low_k = assessment.where("k_anonymity is not null").select(F.lit("reid").alias("scanner"), F.lit("LOW_K_ANONYMITY").alias("category"), severity_of_k(F.col("k_anonymity")).alias("severity"), F.lit(dataset).alias("location"), F.concat(F.lit("k-anonymity is "), F.col("k_anonymity")).alias("message"), F.col("k_anonymity").alias("k"))
    return low_k.where(F.col("k") < k).drop("k")


def suppress_small_groups(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Rows in classes of at least k.

    The class table is joined back rather than computed by a window, so one huge class isn't one task.
    """
    sizes = class_sizes(df, columns).where(F.col("class_size") >= k)
    same = None
    for c in columns:
        term = df[c].eqNullSafe(sizes[c])
        same = term if same is None else same & term
    return df.join(sizes, same, "left_semi")
