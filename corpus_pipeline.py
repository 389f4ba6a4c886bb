"""Corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that the stage before it kept.
The first four return the columns of documents, the last the batches.

Every row is judged by its own text, whatever its doc_id: rows with a null doc_id are judged as any other, and rows that share
one can fare differently.  Null, empty and blank texts fail the quality stage; where a later stage meets them, near-duplicate
removal, decontamination and redaction keep them as they are and packing gives them no batch.  Of rows that are equal in
all columns near-duplicate removal keeps one; the other stages judge each.  Every stage returns no rows for an empty table.
Other columns, whatever their names, are kept by the first four.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.decontaminate import drop_contaminated
from veilmark.llm.near_dedup import NearParams, drop_near_duplicates
from veilmark.llm.packing import pack
from veilmark.llm.quality import keep_good
from veilmark.llm.secrets import redact_secrets
from veilmark.llm.staging import shared_folder


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    return keep_good(spark, docs, _read(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group at a five-word shingle similarity of 0.8 or more: the one with the smallest doc_id."""
    return drop_near_duplicates(spark, docs, NearParams())


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the contamination rule does not hold for."""
    return drop_contaminated(spark, docs, _read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their text replaced and n_chars counted anew."""
    columns = docs.columns
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text_hash, piece, first_word, n_tokens, bucket, batch, slot."""
    return pack(spark, docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: MinHash families, learned rules and batch numbering have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = _read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
