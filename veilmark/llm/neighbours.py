"""Nearest vectors by inner product: a forest of random-projection trees, one priority queue, exact reranking.

The trees are fitted on a sample of at most about ``sample_rows`` different vectors; every vector is indexed.  Copies of a vector are one
entry with its smallest ids (the others can be in no answer), so that a vector of many copies is neither a large leaf nor many queries.  A query
goes down all trees through one queue, ordered by the least cut that it has to cross; the vectors of the leaves that
it visits are compared with it exactly.

How many leaves a query visits is measured, not set: for up to ``tuning_queries`` queries the true neighbours are found by looking at every
vector, and the budget is the number of visits after which ``recall`` of them have been seen.  So vectors without structure cost a
scan of a large part of the table and clustered ones little.  A query also goes on until one tree has shown ``least_seen`` different vectors, so
that small tables are searched whole.

Entries are dealt by shelves of neighbouring leaves; a shelf with more than ``part_rows`` vectors or queries is split, so no task holds a whole one.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of another than the most
frequent length (the shorter of equally frequent ones), nor rows with a null id; equal rows count once; an id with unlike
vectors stands for each of them and, as a query, gets a list for each; a query never finds its own id; ties go to the smaller id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest_kernels as kernels
from .staging import Stage, if_small, ship

ship(kernels, __name__)


@dataclass(frozen=True)
class ForestParams:
    neighbours: int = 20
    trees: int = 4
    #: vectors that the trees are fitted on, in expectation; leaves get at least 16 of them
    sample_rows: int = 65_536
    leaf_rows: int = 256
    max_depth: int = 12
    tuning_queries: int = 64
    recall: float = 0.95
    least_seen: int = 1024
    #: a shelf's vectors; a query goes to each shelf that it visits
    shelf_rows: int = 16_384
    part_rows: int = 16_384
    seed: int = 0


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, params: ForestParams = ForestParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of vectors(id, vector) for each row of queries(id, vector) but that of its own id."""
    p, stage, keep = params, Stage(spark, "forest"), params.neighbours + 1  # one may be the query itself
    usable = vectors.where(_usable("id", "vector"))
    width = usable.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    kind = f"array<{'double' if dict(vectors.dtypes)['vector'] != 'array<float>' else 'float'}>"
    fit = lambda df: df.where(_usable("id", "vector") & (F.size("vector") == (width.width if width else 0))).select(F.col("id").cast("long").alias("id"), F.col("vector").cast(kind).alias("vector"))
    asked = stage.table(fit(queries).mapInArrow(kernels.namer(), f"id long, vector {kind}, name binary"), "asked")
    lists = fit(vectors).mapInArrow(kernels.distinct(keep), f"name binary, vector {kind}, ids array<long>")
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)  # a list for each task at most
    entries = stage.table(lists.groupBy("name").agg(F.first("vector").alias("vector"), smallest.alias("ids")), "entries")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, norm2 = entries.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    different = stage.table(asked.groupBy("name").agg(F.first("vector").alias("vector")), "different")

    sample = kernels.matrix(_some(entries, n, p.sample_rows).select("vector").toArrow()["vector"])
    deep = min(math.log2(max(2, n / p.leaf_rows)), math.log2(max(2, len(sample) / 16)), p.max_depth)
    depth = max(1, int(deep))
    shelves = 1 << min(depth, max(3, math.ceil(math.log2(n / p.shelf_rows))))
    forest = kernels.fit(sample, p.trees, depth, norm2, p.seed)
    held = spark.sparkContext.broadcast(forest.state())  # trees * 2 ** depth directions

    posted = stage.table(entries.mapInArrow(kernels.router(held, shelves), f"shelf int, leaf int, name binary, ids array<long>, vector {kind}"), "posted")
    counts = np.zeros(p.trees << depth, dtype=np.int64)
    for r in posted.groupBy("leaf").count().collect():  # a row for each leaf of the forest
        counts[r.leaf] = r["count"]
    counts = counts.reshape(p.trees, -1)
    budget = _budget(stage, entries, different, forest, held, p)
    search = kernels.searcher(held, shelves, spark.sparkContext.broadcast(counts), budget, p.least_seen)
    visits = stage.table(different.mapInArrow(search, f"name binary, vector {kind}, shelf int, leaves array<int>"), "visits")

    # parts of each shelf's vectors and queries; every part of the one meets every part of the other
    parts = lambda df, name: df.groupBy("shelf").agg(F.ceil(F.count("*") / p.part_rows).cast("int").alias(name))
    split = F.broadcast(parts(posted, "of").join(parts(visits, "by"), "shelf"))  # a row for each shelf of the forest
    part = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int").alias(n[0])
    copies = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    left = posted.join(split, "shelf").select("shelf", "leaf", "ids", "vector", part("of"), copies("by", "b"))
    right = visits.join(split, "shelf").select("shelf", "name", "vector", "leaves", part("by"), copies("of", "o"))
    found = left.groupBy("shelf", "o", "b").cogroup(right.groupBy("shelf", "o", "b")).applyInArrow(kernels.reranker(keep), "name binary, found array<struct<worse:double,id:long>>")
    # a list for each shelf part visited; array_distinct would compare all pairs of them
    merged = stage.table(found.repartition("name").mapInArrow(kernels.merger(keep), "name binary, found array<struct<worse:double,id:long>>"), "merged")

    own = asked.select(F.col("id").alias("query_id"), "name").distinct().join(if_small(merged), "name")
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, p.neighbours)
    ranked = own.select("query_id", F.posexplode(others).alias("at", "f"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.worse")).alias("score"))


def _usable(id_column: str, vector: str) -> Column:
    x = F.col(vector)
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.col(id_column).isNotNull() & F.coalesce(finite & F.exists(x, lambda c: c != 0), F.lit(False))


def _some(rows: DataFrame, n: int, wanted: int) -> DataFrame:
    """About so many rows, by the hash of their name; all if there are no more."""
    bits = 1 << 30
    return rows if n <= wanted else rows.where(F.pmod(F.xxhash64("name"), F.lit(bits)) < int(bits * wanted / n))


def _budget(stage: Stage, entries: DataFrame, different: DataFrame, forest: kernels.Forest, held, p: ForestParams) -> int:
    """Visits after which the wanted share of the true neighbours of some queries has been seen."""
    spark = stage.spark
    some = _some(different, different.count(), p.tuning_queries).select("name", "vector").toArrow()
    if not some.num_rows:
        return 1
    x = kernels.matrix(some["vector"])
    names = some["name"].to_pylist()
    asked = spark.sparkContext.broadcast(list(zip(names, x, strict=True)))
    each = entries.mapInArrow(kernels.exact(asked, held, p.neighbours + 1), "q int, score double, id long, leaves array<int>")
    top = each.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("worse"), "id", "leaves"))), 1, p.neighbours + 1).alias("top"))  # a list for each task
    seen = []
    for r in top.collect():  # neighbours + 1 for each of the few queries
        at = kernels.places(forest, x[r.q])
        seen += [min(int(at[t * forest.leaves + leaf]) for t, leaf in enumerate(f.leaves)) + 1 for f in r.top]
    return int(np.quantile(seen, p.recall, method="higher")) if seen else 1
