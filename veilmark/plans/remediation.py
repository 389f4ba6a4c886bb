"""Rounds of audit, gate and replacement until the release gate passes.

Each round is a folder of tables: the training copy, the findings of its audit, the strengths of the attack, and last a
one-row summary. A round with a summary is done; a run that was cut goes on after it, from tables alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import bump_minor
from ..functions.grammars import generated
from ..functions.patterns import at_least
from ..operators import audit, policy, references, text
from .running import stored

#: an audit of a training copy: findings (id, start, end of the raw corpus, entity_type, severity) and strengths
#: (entity_type, null for all; auc)
Audit = Callable[[DataFrame], tuple[DataFrame, DataFrame]]

SUMMARY = "round int, version string, verdict string, auc double, critical long, high long, risky_types array<string>, leaky_types array<string>, whole_types array<string>, passed boolean"
POLICY = {"entity_critical_max": 0, "entity_high_max": {"warn": 0}, "el_mia_auc_max": {"warn": 0.55, "fail": 0.60}}


@dataclass(frozen=True)
class Settings:
    """always: types that are replaced whatever their score. type_auc_max: above it a type leaks as a whole."""

    max_rounds: int = 3
    minimum: str = "medium"
    always: tuple[str, ...] = ("SSN", "CREDITCARDNUMBER")
    strategy: str = "surrogate"
    seed: int = 0
    type_auc_max: float = 0.60
    rules: dict[str, Any] = field(default_factory=lambda: dict(POLICY))


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # not written yet
        return None


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def summarize(number: int, version: str, findings: DataFrame, strengths: DataFrame, settings: Settings) -> DataFrame:
    """One row about a round: the verdict over its findings and strengths, and the types that stand out."""
    spark = findings.sparkSession
    counts = policy.severity_evidence(findings, {"entity_critical_max": "critical", "entity_high_max": "high"})
    auc = strengths.where("entity_type is null").agg(F.max("auc").alias("observed")).select(F.lit("el_mia_auc_max").alias("rule"), "observed")
    verdict = policy.worst(policy.evaluate(policy.rule_table(spark, settings.rules), counts.union(auc)))
    risky = F.collect_set(F.when(at_least(F.col("severity"), "high"), F.col("entity_type")))  # types, not rows
    found = findings.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.array_sort(risky).alias("risky_types"))
    leaky = strengths.agg(F.max(F.when(F.col("entity_type").isNull(), F.col("auc"))).alias("auc"), F.array_sort(F.collect_set(F.when(F.col("auc") > settings.type_auc_max, F.col("entity_type")))).alias("leaky_types"))
    one = verdict.crossJoin(found).crossJoin(leaky)  # one row each
    passed = (F.col("verdict") != "fail") & (F.col("critical") + F.col("high") == 0)
    return one.select(F.lit(number).alias("round"), F.lit(version).alias("version"), "verdict", "auc", "critical", "high", "risky_types", "leaky_types", passed.alias("passed"))


def whole_types(current: Any, previous: Any) -> list[str]:
    """Types to replace altogether: risky two rounds in a row; where nothing blocks and the gate fails, those that leak."""
    again = set(current.risky_types) & set(previous.risky_types if previous else [])
    return sorted(again | (set() if current.critical + current.high else set(current.leaky_types)))


def replaced_copy(raw: DataFrame, train: DataFrame, findings: DataFrame, types: list[str], settings: Settings) -> DataFrame:
    """The training copy with risky values, and every value of some types, replaced; values replaced before stay."""
    chosen = text.risky_spans(findings, raw, settings.minimum, types).select("id", F.inline("spans"))
    spans = text.translate(chosen, raw, train, only_original=True)
    spans = spans.groupBy("id").agg(F.collect_list(F.struct(F.col("train_start").alias("start"), F.col("train_end").alias("end"))).alias("__chosen"))
    rows = train.join(spans, "id", "left")
    held = {r[0] for r in raw.select(F.explode("entities.entity_type").alias("k")).select(F.upper("k")).distinct().collect()}  # types, not values
    return text.sanitize(rows, settings.strategy, seed=settings.seed, chosen="__chosen", make=partial(generated, kinds=held)).drop("__chosen")


def replaced_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """entity_type, n: values that differ between two copies of the same records."""
    value = lambda e: F.substring("text", e["start"] + 1, e["end"] - e["start"])
    held = lambda df, name: df.select("id", F.posexplode(F.transform("entities", lambda e: F.struct(e["entity_type"].alias("entity_type"), value(e).alias("value")))).alias("pos", name))
    both = held(before, "a").join(held(after, "b"), ["id", "pos"]).where("not (a.value <=> b.value)")
    return both.groupBy(F.col("a.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))


def remediate(raw: DataFrame, run_audit: Audit, folder: str, settings: Settings | None = None, version: str = "1.0.0") -> DataFrame:
    """Rows of SUMMARY, one a round, until the gate passes or max_rounds replacements are made.

    raw has id (no null, no repeated one), text and entities in code points, as text.detect_records gives. The training
    copy of round n is folder/round=n/train. Strategy drop takes records away; their findings go with them.
    """
    s = settings or Settings()
    spark = raw.sparkSession
    held = _table(spark, f"{folder}/raw")
    raw = held if held is not None else _stored(raw.select("id", "text", "entities"), f"{folder}/raw")
    rounds: list[Any] = []
    for number in range(s.max_rounds + 1):
        here = f"{folder}/round={number}"
        done = _table(spark, f"{here}/summary")
        if done is None:
            if number == 0:
                train = raw
            else:
                last = f"{folder}/round={number - 1}"
                old = raw if number == 1 else spark.read.parquet(f"{last}/train")
                types = [*s.always, *rounds[-1].whole_types]
                train = _stored(replaced_copy(raw, old, spark.read.parquet(f"{last}/findings"), types, s), f"{here}/train")
            findings, strengths = (_stored(df, f"{here}/{name}") for df, name in zip(run_audit(train), ("findings", "strengths"), strict=True))
            row = summarize(number, version, findings, strengths, s)
            now = row.first()
            whole = whole_types(now, rounds[-1] if rounds else None) if not now.passed else []
            kinds = F.array(*map(F.lit, whole)).cast("array<string>")
            names = [c.split()[0] for c in SUMMARY.split(", ")]
            done = _stored(spark.createDataFrame([now], row.schema).withColumn("whole_types", kinds).select(*names).coalesce(1), f"{here}/summary")
        rounds.append(done.first())
        if rounds[-1].passed:
            break
        version = bump_minor(rounds[-1].version)
    return spark.createDataFrame([tuple(r) for r in rounds], SUMMARY)  # a row a round


def gate_passed(rounds: DataFrame) -> bool:
    last = rounds.orderBy(F.desc("round")).first()
    return last is not None and last.passed


def gram_audit(raw: DataFrame, folder: str, n: int = 5, order: int = 4, fdr: float = 0.05, seed: int = 0) -> Audit:
    """An audit by character grams of the training copy: each value of the raw corpus against n look-alikes that the raw
    corpus does not hold. Values, look-alikes and their contexts are written once for all rounds.
    """
    spark = raw.sparkSession

    def once(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        held = _table(spark, f"{folder}/{name}/table")
        return held if held is not None else _stored(make(), f"{folder}/{name}/table")

    asked = once("targets", lambda: references.references(audit.targets(raw, context=order - 1), n, "synthetic", seed))
    options = once("variants", lambda: references.variants(asked))

    def run(train: DataFrame) -> tuple[DataFrame, DataFrame]:
        losses = audit.gram_losses(options, audit.gram_counts(train, order), order)
        scores = stored(audit.evidence(losses, asked).where("method = 'loss'"), "scores")  # read by some five jobs
        judged = stored(audit.gather(scores, ["loss"], "loss"), "judged")  # ranked by several jobs, each of which would judge again
        found = audit.entity_risk(audit.benjamini_hochberg(judged), fdr)
        at = asked.select(F.concat_ws("#", "id", "pos").alias("entity"), "id", "start", "end")
        strengths = audit.type_strength(scores).select("entity_type", "auc")
        whole = audit.attack_strength(scores).select(F.lit(None).cast("string").alias("entity_type"), "auc")
        return found.join(at, "entity").select("id", "start", "end", "entity_type", "severity", "risk", "q"), strengths.union(whole)

    return run
