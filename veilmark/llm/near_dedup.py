"""Near-duplicate documents by a signature-coordinate inverted join, confirmed on full shingle sets.

Each text becomes the set of its k-word shingles.  Texts with equal sets are one class.  A class's MinHash signature has
``2 ** coordinate_bits`` coordinates: the first bits of a shingle's hash name its coordinate, and each coordinate keeps its
least hash (one permutation), so a text has as many values as coordinates hold a shingle of it.  Two signatures collide where they have
a value in common; the share of collisions among the coordinates that either fills estimates the similarity, exactly so where no coordinate
holds two shingles.  A pair counts as a match above a share of the similarity less ``slack_sd`` standard deviations of that
estimate: a link is missed with odds under 1e-7.

Classes are posted under their coordinate values in one global order, rarest first.  Of n values only the first
``n - ceil(share n) + 1`` need posting, and the long lists behind them are skipped.  Entries of a list meet if their places leave
room for enough collisions; the collisions of those that meet are counted by merging what is left of both signatures, and what passes is
confirmed on the full sets.

Large groups don't make all pairs: every entry of a list is first held against two leaders of that list, the
groups so linked are joined, and only entries of *different* groups of a list then meet as pairs.

Defined results: a null or blank text has an empty set, is its own component and is kept; a row's component is the smallest
doc_id that its text reaches, so rows that share a doc_id but no set can differ; a null doc_id gives a null component and
is kept (drop_near_duplicates groups such rows by their text); rows of equal text are copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import near_kernels
from .staging import Stage, connected_components, if_small, ship

ship(near_kernels, __name__)


@dataclass(frozen=True)
class NearParams:
    shingle_words: int = 5
    #: similarity as num / den, compared in whole numbers
    num: int = 80
    den: int = 100
    #: the signature has 2 ** coordinate_bits coordinates
    coordinate_bits: int = 14
    slack_sd: float = 5.6
    #: counters by which values are put in order; any size gives the same links
    order_slots: int = 1 << 20

    def match_share(self, shingles: int, values: int) -> float:
        """Least share of collisions of a set of so many shingles with so many signature values, for partners up to den / num times as large."""
        s, coordinates = self.num / self.den, 1 << self.coordinate_bits
        # the share of shingles that are the least of their coordinate, in this set and in the largest partner's
        seen = min(values / shingles, coordinates * s / shingles * -math.expm1(-shingles / s / coordinates))
        # and one collision for sets too small for a normal law: it makes up for 1 / (1 - s) common shingles that others hide
        return max(s / 2, s - self.slack_sd * math.sqrt(s * (1 - s) * (1 - seen) / values) - 1 / values)


def near_duplicates(spark: SparkSession, docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs(doc_id, text)."""
    stage = Stage(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed, named = _components(stage, docs, params)
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("class") != 0, F.col("smallest")).otherwise(F.col("doc_id")))
    out = signed.join(if_small(named), "class", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id (nulls last, then by the row's hash), and all rows with empty sets."""
    stage = Stage(spark, "near")
    columns = docs.columns
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed, named = _components(stage, rows.select("doc_id", "text"), params)
    schema = StructType([*rows.schema.fields, StructField("class", LongType()), StructField("n_shingles", LongType())])
    every = rows.mapInArrow(near_kernels.signer(params), schema)
    grouped = every.where("class <> 0").join(if_small(named.select("class", "component")), "class").withColumn("at", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("row").alias("hash")))
    first = stage.table(grouped.groupBy("component").agg(F.min("at").alias("best")), "first")
    # rows that are equal in all are one
    chosen = grouped.join(if_small(first), "component").where(F.col("at").eqNullSafe(F.col("best"))).dropDuplicates(["component"])
    kept = chosen.select("row").union(every.where("class = 0").select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in columns])


def _components(stage: Stage, docs: DataFrame, p: NearParams) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, class) of each row, and (class, component, smallest doc_id) of each class but the empty one."""
    schema = StructType([*docs.schema.fields, StructField("class", LongType()), StructField("n_shingles", LongType())])
    signed = stage.table(docs.mapInArrow(near_kernels.signer(p), schema).drop("text"), "signed")

    order = stage.spark.sparkContext.broadcast(_slot_order(docs, p))
    by_value = Window.partitionBy("value")
    posted = docs.select("text").mapInArrow(near_kernels.poster(p, order), near_kernels.POSTING)
    posted = posted.withColumns({"low": F.min("class").over(by_value), "high": F.max("class").over(by_value)}).where("low < high").drop("low", "high")
    posted = stage.table(posted.distinct(), "posted")
    involved = stage.table(posted.select("class").distinct(), "involved")
    texts = docs.select("text").mapInArrow(near_kernels.class_texts(p), "class long, text string").join(if_small(involved), "class", "left_semi")
    texts = stage.table(texts.dropDuplicates(["class"]), "texts")

    # the entry with the fewest rarer values is the likeliest centre of its group
    entry = ("class", "n", "at", "share")
    ends = posted.groupBy("value").agg(F.min(F.struct(*entry)).alias("x"), F.min(F.struct("at", "class", "n", "share")).alias("y"))
    ends = stage.table(ends, "leaders")
    leaders = F.explode(F.array(F.col("x"), F.struct(*[F.col(f"y.{c}").alias(c) for c in entry]))).alias("o")
    led = posted.join(ends, "value").select(*entry, leaders).where(F.col("class") != F.col("o.class")).where(_reachable(*entry[1:], *[f"o.{c}" for c in entry[1:]]))
    # each entry's leaders it collides with most, counted over its lists; what they don't link meets below
    led = led.groupBy("class", F.col("o.class").alias("other")).agg(F.count("*").alias("hits"), F.min("o.at").alias("at"))
    most = F.max(F.struct("hits", -F.col("other"))), F.min(F.struct("at", -F.col("hits"), "other"))
    led = led.groupBy("class").agg(F.array_distinct(F.array(-most[0]["col2"], most[1]["other"])).alias("others")).select("class", F.explode("others").alias("other"))
    led = led.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
    star = stage.table(_confirmed(led, texts, p), "star")
    groups = connected_components(stage, star, "cc1")

    grouped = posted.join(groups, posted["class"] == groups.node, "left").select("value", *entry, F.coalesce("component", "class").alias("grp"))
    mixed = grouped.withColumns({"low": F.min("grp").over(by_value), "high": F.max("grp").over(by_value)}).where("low < high").drop("low", "high")
    mixed = stage.table(mixed, "mixed")
    x, y = mixed.alias("x"), mixed.alias("y")
    meet = (F.col("x.value") == F.col("y.value")) & (F.col("x.grp") < F.col("y.grp")) & _reachable(*[f"{t}.{c}" for t in "xy" for c in entry[1:]])
    across = x.join(y, meet).select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()
    links = stage.table(star.union(_confirmed(across, texts, p)), "links")
    groups = connected_components(stage, links, "cc2")

    classes = signed.where("class <> 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    named = classes.join(groups, classes["class"] == groups.node, "left").select("class", "doc_id", F.coalesce("component", "class").alias("component"))
    linked = named.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    return signed, stage.table(named.join(linked, "component").select("class", "component", "smallest"), "named")


def _reachable(n: str, at: str, share: str, m: str, bt: str, other: str) -> Column:
    """Whether signatures of n and m values whose first common one is at places at and bt can collide often enough:
    no rarer value is common, so at most the rest of either is."""
    least = F.least(share, other).cast("double") - 1e-6
    return F.least(F.col(n) - F.col(at), F.col(m) - F.col(bt)) * (1 + least) >= (F.col(n) + F.col(m)) * least


def _slot_order(docs: DataFrame, p: NearParams) -> bytes:
    """One byte for each counter slot: the rounded logarithm of how many signatures have a value there."""
    block = 4096
    n = p.order_slots // block
    counted = docs.select("text").mapInArrow(near_kernels.slot_counter(p, block), "block int, counts binary")
    summed = counted.repartition(min(n, 64), "block").mapInArrow(near_kernels.slot_summer(block), "block int, counts binary")
    levels = np.zeros(p.order_slots, dtype=np.uint8)
    for row in summed.collect():  # order_slots * 8 bytes, whatever the input
        counts = np.frombuffer(row.counts, dtype=np.uint64)
        levels[row.block * block : (row.block + 1) * block] = np.minimum(255, 6 * np.log2(1.0 + counts)).astype(np.uint8)
    return levels.tobytes()


def _confirmed(pairs: DataFrame, texts: DataFrame, p: NearParams) -> DataFrame:
    """The pairs (a, b) whose signatures collide often enough and whose full sets are similar enough."""
    side = lambda c: texts.select(F.col("class").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(near_kernels.confirmer(p), "a long, b long")
