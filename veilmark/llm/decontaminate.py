"""Benchmark decontamination by winnowing.

Every run of ``k + w - 1`` words has ``w`` k-word grams; the smallest gram hash of each run is its
fingerprint, so two texts that share such a run share its fingerprint.  With k + w - 1 equal to the window
length no shared window can be missed.  Fingerprints of a document are joined with those of the benchmark,
and each hit is extended to its whole window and compared word hash by word hash.  Items shorter than a
window are one window each and are looked up by grams of their own length.

The benchmark's index is broadcast only in blocks of at most ``block_bytes`` of text, measured before; a
larger benchmark is taken block by block, each against all documents, and the hits of a document are merged.

Defined results: null or wordless texts have no words and no hits; null or wordless items have no window;
items with a null item_id are ignored; repeated items count once; repeated documents each give a row; an
empty benchmark gives no hits; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import winnow_kernels
from .staging import Stage, ship

ship(winnow_kernels, __name__)


@dataclass(frozen=True)
class WinnowParams:
    window_words: int = 13
    gram_words: int = 5
    #: a document is contaminated from this share (1 / share_den) of hit words on
    share_den: int = 20
    #: benchmark text in one broadcast index
    block_bytes: int = 16_000_000


def benchmark_hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, params: WinnowParams = WinnowParams()) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item_ids as strings), contaminated: one row for each row of docs(doc_id, text)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    blocks = -(-size // params.block_bytes) or 1
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if blocks == 1:
        scanned = _scan(spark, docs, items, params)
        return _verdict(scanned.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"), "items"), params)
    stage = Stage(spark, "winnow")
    keyed = stage.table(docs.withColumn("row", F.monotonically_increasing_id()), "docs")
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    parts = None
    for b in range(blocks):
        part = _scan(spark, keyed.select("row", "text"), items.where(block == b), params)
        parts = part if parts is None else parts.union(part)
    merged = parts.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # total length of the union of sorted intervals
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    grow = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto"))
    merged = merged.withColumn("n_hit", F.aggregate("spans", start, grow)["n"])
    return _verdict(keyed.select("row", "doc_id").join(merged, "row").select("doc_id", "n_words", "n_hit", "items"), params)


def _scan(spark: SparkSession, docs: DataFrame, items: DataFrame, p: WinnowParams) -> DataFrame:
    """The first column of docs(key, text), n_words, spans and items."""
    rows = [(r.item, r.text) for r in items.collect()]  # at most about block_bytes
    index = spark.sparkContext.broadcast(winnow_kernels.build_index(rows, p))
    schema = StructType([docs.schema.fields[0], *StructType.fromDDL("n_words long, spans array<struct<start:long,end:long>>, items array<string>").fields])
    return docs.mapInArrow(winnow_kernels.scanner(index, p), schema)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, params: WinnowParams = WinnowParams()) -> DataFrame:
    """The rows of docs that are not contaminated, each judged by its own text, with docs' own columns."""
    hits = benchmark_hits(spark, docs.select(F.struct("*").alias("doc_id"), "text"), benchmark, params)
    return hits.where("not contaminated").select("doc_id.*")


def _verdict(hits: DataFrame, p: WinnowParams) -> DataFrame:
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (p.share_den * F.col("n_hit") >= F.col("n_words")))
