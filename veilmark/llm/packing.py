"""Packing into optimal length buckets.

A text's length is its number of words; texts longer than ``max_tokens`` are cut into pieces of that size.
Dynamic programming over the global length histogram picks the bucket boundaries with the least padding, and
inside each bucket pieces are numbered and dealt into batches of ``batch_tokens`` padded tokens.

The numbering is exact without a task that holds a bucket: pieces are numbered inside (bucket, block), where
blocks are many, and the sums of earlier blocks are added.

Defined results: a null, empty or blank text has one row with 0 tokens and null bucket, batch and slot; rows
with a null doc_id are packed as any other; repeated rows are packed once each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import Stage


@dataclass(frozen=True)
class PackingParams:
    max_tokens: int = 2048
    buckets: int = 8
    batch_tokens: int = 65_536
    #: pieces in one block of the numbering, on average
    block_rows: int = 20_000


def bucket_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` ranges of lengths, the padding to whose ends is least in total."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=float)
    upto, mass = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    n = len(lengths)
    best, back = np.full(n + 1, np.inf), []
    best[0] = 0
    for _ in range(min(buckets, n)):
        new, came = best.copy(), np.arange(n + 1)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (upto[j] - upto[:j]) - (mass[j] - mass[:j])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], came[j] = cost[i], i
        best = new
        back.append(came)
    ends, j = [], n
    for came in reversed(back):
        if j and came[j] != j:
            ends.append(int(lengths[j - 1]))
            j = int(came[j])
    return sorted(ends)


def pack(spark: SparkSession, docs: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """doc_id, text_hash, piece, first_word, n_tokens, bucket, batch, slot: (bucket, batch) names a batch, slot a place in it.

    The piece is the text's n_tokens words from first_word on; text_hash, xxhash64(doc_id, text), tells texts of one doc_id apart.
    """
    p = params
    stage = Stage(spark, "packing")
    words = F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    sized = docs.select("doc_id", F.coalesce(words, F.lit(0)).cast("long").alias("n"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("mark"))
    sized = stage.table(sized, "sized")
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / p.max_tokens) - 1).cast("int")
    pieces = sized.select("doc_id", "mark", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select("doc_id", "mark", "piece", F.least(F.lit(p.max_tokens), F.col("n") - F.col("piece") * p.max_tokens).alias("n_tokens"))
    histogram = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect() if r.n_tokens}  # at most max_tokens rows
    ends = bucket_boundaries(histogram, p.buckets)
    bucket = F.lit(None).cast("long")
    for end in reversed(ends):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(end).cast("long")).otherwise(bucket)
    blocks = max(1, sum(histogram.values()) // p.block_rows)
    dealt = pieces.withColumn("bucket", F.when(F.col("n_tokens") > 0, bucket)).withColumn("block", F.pmod(F.xxhash64("mark", "piece"), F.lit(blocks)))
    full = dealt.where("bucket is not null")
    before = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = full.groupBy("bucket", "block").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    sums = stage.table(sums, "sums")
    within = Window.partitionBy("bucket", "block").orderBy("mark", "piece", "doc_id")
    numbered = full.withColumn("at", F.row_number().over(within) - 1).join(sums, ["bucket", "block"]).withColumn("at", F.col("at") + F.col("base"))
    size = F.greatest(F.lit(1), F.floor(F.lit(p.batch_tokens) / F.col("bucket"))).cast("long")
    place = [F.col("mark").alias("text_hash"), "piece", (F.col("piece").cast("long") * p.max_tokens).alias("first_word"), "n_tokens"]
    out = numbered.select("doc_id", *place, "bucket", F.floor(F.col("at") / size).cast("long").alias("batch"), (F.col("at") % size).cast("long").alias("slot"))
    none = F.lit(None).cast("long")
    return out.union(dealt.where("bucket is null").select("doc_id", *place, none.alias("bucket"), none.alias("batch"), none.alias("slot")))
