"""Streaming forms of batch operators (extensions; the batch forms define the results)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import drift


def daily_outcomes(events: DataFrame, at: str, outcome: str, late: str = "1 hour") -> DataFrame:
    """day window, outcome, n; events later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("day"), outcome).agg(F.count("*").alias("n"))


def drift_batches(reference: DataFrame, batches: DataFrame, table: str, checkpoint: str, exclude: tuple[str, ...] = ()):
    """A query that checks each micro-batch against the reference and appends one report a batch."""

    def check(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            drift.check_drift(reference, batch, exclude=exclude).withColumn("batch", F.lit(number)).write.mode("append").parquet(table)

    return batches.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)


def throttle(attempts: DataFrame, limit: int = 5, seconds: int = 900) -> DataFrame:
    """key, at, failures, blocked of attempts(key string, at timestamp, success boolean); state is the failures of the
    last seconds, each of them, as in the batch form."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(frames)).sort_values("at").itertuples():
            now = r.at.timestamp()
            recent = [] if r.success else [t for t in [*recent, now] if now - t < seconds]
            out.append((key[0], r.at, len(recent), len(recent) >= limit))
        state.update((recent,))
        yield pd.DataFrame(out, columns=["key", "at", "failures", "blocked"])

    return attempts.groupBy("key").applyInPandasWithState(step, "key string, at timestamp, failures long, blocked boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)
