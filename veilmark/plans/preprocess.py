"""Preprocessing of a table for training, and its replay on new batches."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.documents import canonical_json
from ..functions.patterns import suggested_quasi_identifiers
from ..operators import anonymize, ml, pii_scan, profile, reid
from ..sources.tables import read_table


def identifiers(df: DataFrame, keep: tuple[str, ...] = ()) -> list[str]:
    """Columns that the scan finds to hold direct identifiers, in table order."""
    found = {r.location.split(":", 1)[1] for r in pii_scan.pii_columns(pii_scan.scan(df, "input")).collect()}  # one row a column
    return [c for c in df.columns if c in found and c not in keep]


def quasi_identifiers(df: DataFrame, requested: list[str] | str | None = "auto", exclude: tuple[str, ...] = ()) -> list[str]:
    names = suggested_quasi_identifiers(df.columns) if requested in (None, "auto") else [requested] if isinstance(requested, str) else requested
    return [c for c in names if c in df.columns and c not in exclude]


def build_manifest(df: DataFrame, label: str, min_k: int = 5, test_size: float = 0.25, width: float = 10, requested: list[str] | str = "auto") -> dict[str, Any]:
    drop = identifiers(df, keep=(label,))
    quasi = quasi_identifiers(df, requested, (label, *drop))
    rules = anonymize.fit_generalization(df, quasi, width, anonymize.split_target(min_k, test_size), label=label)
    return {"label": label, "drop": drop, "quasi_identifiers": quasi, "rules": rules, "min_k": min_k}


def manifest_hash(manifest: dict[str, Any]) -> str:
    return hashlib.sha256(canonical_json(manifest)).hexdigest()


def certified(manifest: dict[str, Any], recorded: str) -> dict[str, Any]:
    if manifest_hash(manifest) != recorded:
        raise ValueError("the manifest differs from the certified one")
    return manifest


def preprocess(df: DataFrame, label: str, min_k: int = 5, test_size: float = 0.25, **how: Any) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """(train, test, manifest): cleaned, without identifiers, generalised, small groups left out on each side."""
    task = profile.infer_task(df, label).first()["task"]
    clean = profile.clean_rows(df, label, regression=task == "regression")
    manifest = build_manifest(clean, label, min_k, test_size, **how)
    quasi = manifest["quasi_identifiers"]
    safe = anonymize.apply_manifest(clean, manifest)
    keyed = safe.withColumn("__id", F.xxhash64(*safe.columns)).withColumn("__label", F.col(label))
    if task == "regression":
        keyed = ml.rank_strata(keyed.drop("__label"), label, name="__label")
    # a group is split by label too where that leaves two rows or more for a label
    both = F.count("*").over(Window.partitionBy(*quasi, "__label"))
    keyed = keyed.withColumn("__label", F.when(both >= 2, F.col("__label")))
    parts = ml.stratified_split(keyed, [*quasi, "__label"], test_size, "__id").drop("__id", "__label")
    sides = [parts.where(F.col("is_test") == test).drop("is_test") for test in (False, True)]
    train, test = (reid.suppress_small_groups(s, quasi, min_k) if quasi else s for s in sides)
    return train, test, manifest


def prepare_batch(spark: SparkSession, path: str, manifest: dict[str, Any], recorded: str, out: str) -> int:
    """Write a new batch as the manifest makes it; the number of rows."""
    done = anonymize.apply_manifest(read_table(spark, path), certified(manifest, recorded))
    done.write.mode("overwrite").option("header", True).csv(out)
    return done.count()


class TableCleaner(Transformer):
    """Applies a feature plan as a pipeline stage."""

    def __init__(self, plan: profile.FeaturePlan) -> None:
        super().__init__()
        self.plan = plan

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return profile.apply_plan(dataset, self.plan)
