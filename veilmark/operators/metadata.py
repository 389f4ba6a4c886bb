"""Queries over tenants, versions, deployments and guard events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(df: DataFrame, tenant: str) -> DataFrame:
    """Rows of a tenant or of all tenants; the filter reaches the scan."""
    return df.where(F.col("tenant_id").isin(tenant, "*"))


def members(users: DataFrame, memberships: DataFrame, tenant: str) -> DataFrame:
    return users.join(memberships.where(F.col("tenant_id") == tenant), "user_id").orderBy("email")


def deployments(deployed: DataFrame, versions: DataFrame, models: DataFrame, model_id: str | None = None) -> DataFrame:
    """Three-way join, newest first."""
    rows = deployed.join(versions, "version_id").join(models, "model_id")
    return (rows.where(F.col("model_id") == model_id) if model_id else rows).orderBy(F.desc("created_at"))


def newest_active(deployed: DataFrame, by: list[str]) -> DataFrame:
    live = deployed.where("status = 'active'")
    return live.groupBy(*by).agg(F.max_by("version_id", "created_at").alias("version_id"), F.max("created_at").alias("created_at"))


def deploy(deployed: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """All deployments after new ones: active ones of the same group are superseded."""
    hit = new.select(*by).distinct().withColumn("__hit", F.lit(True))
    old = deployed.join(hit, by, "left").withColumn("status", F.when(F.col("__hit") & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))).drop("__hit")
    return old.unionByName(new.withColumn("status", F.lit("active")))


def search(df: DataFrame, limit: int = 50, **equal: str | None) -> DataFrame:
    """Rows with the given values, newest first: a top-n report."""
    for c, v in equal.items():
        df = df.where(F.col(c) == v) if v is not None else df
    return df.orderBy(F.desc("created_at")).limit(limit)


def page(df: DataFrame, key: str, after: int, limit: int = 100) -> DataFrame:
    """The next page by key."""
    return df.where(F.col(key) > after).orderBy(key).limit(min(limit, 1000))


def models_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("model").agg(F.count("*").alias("passports"), F.max("created_at").alias("latest"))




def guard_stats(events: DataFrame, day: Column, outcome: str, latency: str, playground: Column) -> DataFrame:
    """day, outcome, n, latency (upper median of rows outside the playground).

    The median is found by rank inside the group after counting equal latencies, not by collecting them.
    """
    rows = events.select(day.alias("day"), F.col(outcome).alias("outcome"), F.when(~playground, F.col(latency)).alias("x"))
    counts = rows.groupBy("day", "outcome", "x").agg(F.count("*").alias("k"))
    n = counts.groupBy("day", "outcome").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("x").isNotNull(), F.col("k"))).alias("with_x"))
    upto = Window.partitionBy("day", "outcome").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.where("x is not null").withColumn("upto", F.sum("k").over(upto)).join(n, ["day", "outcome"])
    middle = ranked.where(F.col("upto") > F.floor(F.col("with_x") / 2)).groupBy("day", "outcome").agg(F.min("x").alias("latency"))
    return n.select("day", "outcome", "n").join(middle, ["day", "outcome"], "left")


def type_totals(events: DataFrame, counts: str) -> DataFrame:
    """Sum of a map column by key."""
    return events.select(F.explode(counts).alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n"))


def dashboard(versions: DataFrame) -> DataFrame:
    """state, versions, findings (critical and high, of versions in state findings)."""
    return versions.groupBy("state").agg(F.count("*").alias("versions"), F.sum(F.when(F.col("state") == "findings", F.col("critical") + F.col("high")).otherwise(0)).alias("findings"))


def transition_allowed(moves: DataFrame, allowed: DataFrame) -> DataFrame:
    """Moves (from_state, to_state, role) that the table of allowed moves has."""
    return moves.join(allowed, ["from_state", "to_state", "role"], "left_semi")


def next_states(allowed: DataFrame, state: str) -> DataFrame:
    return allowed.where(F.col("from_state") == state).select("to_state").distinct().orderBy("to_state")


def first_severity(vulnerabilities: DataFrame, severities: DataFrame, order: str) -> DataFrame:
    """Vulnerabilities with a severity where one is known; of an id's severities the first by the order column wins."""
    first = severities.groupBy("id").agg(F.min_by(F.struct(*severities.columns), order).alias("s")).select("s.*")
    return vulnerabilities.join(first, "id", "left")


def best_per_family(trials: DataFrame) -> DataFrame:
    """The best trial of each family, best first."""
    best = trials.groupBy("family").agg(F.max_by(F.struct(*trials.columns), "score").alias("t")).select("t.*")
    return best.orderBy(F.desc("score"), "family")


def fresh_insert(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows and the new ones whose key is not there yet."""
    return stored.unionByName(new.join(stored, key, "left_anti"))


def with_defaults(rows: DataFrame, settings: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    out = rows.join(settings, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def findings_by_type(audits: DataFrame, column: str = "findings") -> DataFrame:
    """entity_type, n: high and critical findings of a nested column, most first."""
    rows = audits.select(F.explode(column).alias("f")).select("f.*").where(F.col("severity").isin("high", "critical"))
    return rows.groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type")


def recurring_types(rounds: DataFrame, earlier: int, later: int) -> DataFrame:
    """Types that are risky in both of two rounds (round, entity_type)."""
    at = lambda r: rounds.where(F.col("round") == r).select("entity_type")
    return at(earlier).intersect(at(later))


def diligence(versions: DataFrame, datasets: DataFrame, attestations: DataFrame) -> DataFrame:
    """version_id, parent_version, datasets, unknown_consent, verified for each version."""
    parent = versions.select(F.col("version_id").alias("parent_id"), F.col("version").alias("parent_version"))
    sets = datasets.groupBy("version_id").agg(F.array_sort(F.collect_set("name")).alias("datasets"), F.count_if(F.col("consent").isNull() | (F.col("consent") == "unknown")).alias("unknown_consent"))
    signed = attestations.groupBy("version_id").agg(F.bool_and("verified").alias("verified"))
    rows = versions.join(parent, "parent_id", "left").join(sets, "version_id", "left").join(signed, "version_id", "left")
    return rows.select("version_id", "parent_version", "datasets", F.coalesce("unknown_consent", F.lit(0)).alias("unknown_consent"), F.coalesce("verified", F.lit(False)).alias("verified"))


def summary(datasets: DataFrame, findings: DataFrame, risk: DataFrame) -> DataFrame:
    """One row: rows, identifier_columns, min_k."""
    rows = datasets.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    ids = findings.where("direct_identifier").agg(F.count_distinct("location").alias("identifier_columns"))
    return rows.crossJoin(ids).crossJoin(risk.agg(F.min("k_anonymity").alias("min_k")))  # one row each


def write_findings(findings: DataFrame, path: str, fail_on: str = "high") -> bool:
    """Write findings as JSON lines; whether any is at least as severe as fail_on."""
    from ..functions.patterns import at_least

    findings.write.mode("overwrite").json(path)
    return not findings.where(at_least(F.col("severity"), fail_on)).isEmpty()
