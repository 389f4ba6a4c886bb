"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan


def ship(*modules) -> None:
    """Kernels and parameters travel with the task, so executors need no copy of this package."""
    for module in modules:
        cloudpickle.register_pickle_by_value(sys.modules[module] if isinstance(module, str) else module)


ship(textscan)

_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset the warehouse, or on one machine (as in tests) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/veilmark-stages"
    return folder or _FALLBACK.setdefault("folder", tempfile.mkdtemp(prefix="veilmark-"))


class Stage:
    """Tables of one operator call, written as Parquet and read again, so that later steps neither
    recompute them nor depend on any executor that wrote them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: rows of a few numbers that may be broadcast: about 16 MB
BROADCAST_ROWS = 500_000


def if_small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows; larger ones are joined by an exchange."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def connected_components(stage: Stage, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node with an edge (a, b); component is the smallest node reachable.

    Each round hooks every component to its smallest neighbour, halves the paths twice, and relabels the
    edges; edges inside a component go, so the graph shrinks by a factor each round.
    """
    live = stage.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-e0")
    labels = stage.table(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("component", F.col("node")), f"{name}-l0")
    step = 0
    while not live.isEmpty():
        step += 1
        both = live.select(F.col("a").alias("x"), F.col("b").alias("y")).union(live.select("b", "a"))
        up = stage.table(both.groupBy("x").agg(F.least("x", F.min("y")).alias("p")), f"{name}-p{step}")
        for half in range(2):
            over = up.select(F.col("x").alias("p"), F.col("p").alias("q"))
            up = up.join(over, "p", "left").select("x", F.coalesce("q", "p").alias("p"))
        up = stage.table(up, f"{name}-q{step}")
        moved = labels.join(up, labels.component == up.x, "left").select("node", F.coalesce("p", "component").alias("component"))
        labels = stage.table(moved, f"{name}-l{step}")
        a, b = up.select(F.col("x").alias("a"), F.col("p").alias("pa")), up.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        live = live.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        live = stage.table(live, f"{name}-e{step}")
    return labels
