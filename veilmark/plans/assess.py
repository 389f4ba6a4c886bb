"""Assessment of a trained model: its artifacts, its dependencies, and the leakage audit that an unsafe artifact forgoes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import artifacts, leakage


def assess_models(scanned: DataFrame, path: str, model: str, dependencies: DataFrame, advisories: DataFrame, severities: DataFrame, members: DataFrame, others: DataFrame, loss: str = "loss") -> tuple[DataFrame, DataFrame | None]:
    """Findings (scanner, category, severity, location, count) and the attack's row for scored members and others.

    Without a scan of the model at that path, or with one that refuses it, there is no attack but a finding AUDIT_SKIPPED.
    """
    plain = ["scanner", "category", "severity", "location", "count"]
    found = artifacts.findings(scanned, path).select(*plain).unionByName(artifacts.dependency_findings(dependencies, advisories, severities).select(*plain))
    # one model; its scans are as few as its copies
    of_model = artifacts.judged(scanned.where(F.col(f"`{path}`") == model)).agg(F.count("*").alias("n"), F.bool_or("refused").alias("refused")).first()
    if of_model["n"] and not of_model["refused"]:
        return found, leakage.loss_threshold_attack(members, others, loss)
    skipped = scanned.sparkSession.createDataFrame([("leakage", "AUDIT_SKIPPED", "high", model, 1)], ", ".join(f"{c} {'long' if c == 'count' else 'string'}" for c in plain))
    return found.unionByName(skipped), None
