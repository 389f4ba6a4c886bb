"""Merkle manifest of a table: a leaf for each row, a tree for each group of rows, a tree over the groups.

Leaves of a group are put in order by an exchange on ranges, which deals a large group over many tasks, and numbered by
counts of the ranges.  Each ``fan_out ** block_levels`` consecutive leaves form a block that one task reduces to one node.  The
nodes left are few; the driver builds the top tree over them and broadcasts the rest of each block's path, from its top to the root;
the executors write the proofs of the block's rows and fold each row's present leaf with them.

At most ``top_nodes`` nodes go to the driver.  If more are left, blocks of nodes are reduced on the executors once more, within groups and then
over the group roots, as often as it takes, and paths come down through the same tables.

Defined results: nulls are ``-`` inside a leaf; rows of a null group are the first group; a null order value comes first; rows equal in order
values stand by their leaf and then their present leaf, so that the result does not depend on the order of input; a single row is
leaf, subroot and root with an empty proof; very long texts are hashed where they lie and never move; an empty table gives no rows;
columns of other names stay out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import manifest_kernels as kernels
from .staging import Stage, if_small, ship

ship(kernels, __name__)


@dataclass(frozen=True)
class ManifestParams:
    fan_out: int = 3
    #: a block has fan_out ** block_levels leaves: 2187
    block_levels: int = 7
    #: most nodes of the tree that the driver builds; their paths take about 1 kB each
    top_nodes: int = 20_000
    #: fold rows whose leaf is unchanged too (their folded root can be no other than the root)
    refold: bool = True

    @property
    def block(self) -> int:
        return self.fan_out**self.block_levels


def leaf(fields: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` for null, else UTF-8 byte count, colon, value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]).cast("binary"), 256)


def merkle_manifest(spark: SparkSession, rows: DataFrame, group: str, order: str, params: ManifestParams = ManifestParams()) -> DataFrame:
    """order, leaf, subroot, root, proof (siblings from the leaf's run up to the root, left to right), folded_root of rows(group, order, leaf, now).

    ``leaf`` is what the manifest is made of and ``now`` the same row's leaf as it is found at verification.
    """
    p, stage = params, Stage(spark, "manifest")
    named = rows.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("name"), F.col(order).alias(order), F.col("leaf").alias("hash"), F.col("now").alias("now"))
    named = stage.table(named, "leaves")  # dealing by ranges reads its input twice: hashes, not texts
    ordered = stage.table(_in_order(named, ["name", order, "hash", "now"]), "ordered")

    # the first place of each group's share of each range, and the group's number by name
    shares = stage.table(ordered.groupBy("name", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")), "shares")
    by_part = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shares = shares.withColumn("base", F.coalesce(F.sum("n").over(by_part), F.lit(0)) - F.col("first"))
    groups = shares.groupBy("name").agg(F.sum("n").alias("size"))
    groups = _numbered(stage.table(_in_order(groups, ["name"]), "groups")).withColumnRenamed("number", "grp")
    shares = stage.table(shares.join(groups, "name").select("name", "part", "base", "grp", "size"), "bases")

    leaves = ordered.join(if_small(shares), ["name", "part"]).withColumn("pos", F.col("at") + F.col("base"))
    members = F.struct("pos", "hash", order, "now")
    tiers = [stage.table(_blocks(leaves, members, p), "tier0")]
    crossed = False
    while True:
        low = tiers[-1]
        tops = stage.table(low.select("grp", "block", "alone", F.inline("members")).select("grp", "block", "alone", "hash").mapInArrow(kernels.tops(p), "grp long, block long, hash string"), f"tops{len(tiers)}")
        if tops.count() <= p.top_nodes:
            break
        sizes = tops.groupBy("grp").agg(F.count("*").alias("size"))
        if sizes.where("size > 1").isEmpty() and not crossed:  # every group is one node: on to the tree over the groups
            crossed = True
            total = sizes.count()
            nodes = tops.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(total).cast("long").alias("size"), "hash", F.col("grp").alias("below_grp"), F.col("block").alias("below_block"))
            step = True
        else:
            nodes = tops.join(if_small(sizes), "grp").select("grp", F.col("block").alias("pos"), "size", "hash", F.col("grp").alias("below_grp"), F.col("block").alias("below_block"))
            step = False
        members = F.struct("pos", "hash", "below_grp", "below_block")
        tiers.append(stage.table(_blocks(nodes, members, p).withColumn("crossed", F.lit(step)), f"tier{len(tiers)}"))

    top = sorted((r.grp, r.block, r.hash) for r in tops.collect())  # at most top_nodes
    schema = f"grp long, block long, steps {kernels.STEPS}, subroot string, root string"
    paths = F.broadcast(spark.createDataFrame(kernels.finish(top, crossed, p.fan_out), schema))
    for i in range(len(tiers) - 1, 0, -1):
        below = _with_paths(tiers[i], paths).mapInArrow(kernels.suffixes(p), schema)
        paths = stage.table(below, f"paths{i}")

    key = StructType([rows.select(order).schema.fields[0]])
    out_schema = StructType([*key.fields, *StructType.fromDDL("leaf string, subroot string, root string, proof array<string>, folded_root string").fields])
    return _with_paths(tiers[0], paths).mapInArrow(kernels.proofs(p, pa.schema(list(to_arrow_schema(key)))), out_schema)


def document_manifest(spark: SparkSession, docs: DataFrame, altered: Column | None = None, params: ManifestParams = ManifestParams()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, folded_root, verified of docs(doc_id, source, lang, n_chars, text), a tree for each source.

    ``altered`` is the text as found at verification; by default the text itself.
    """
    kept = ["doc_id", "source", "lang", "n_chars"]
    docs = docs.select(*kept, F.col("text").cast("string").alias("text"))
    now = F.col("text") if altered is None else altered
    rows = docs.select("doc_id", "source", leaf([F.col(c) for c in [*kept, "text"]]).alias("leaf"), leaf([*[F.col(c) for c in kept], now]).alias("now"))
    return merkle_manifest(spark, rows, "source", "doc_id", params).withColumn("verified", F.col("folded_root") == F.col("root"))


def _in_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows dealt by ranges of the columns and sorted, with part (the range) and at (the place inside it)."""
    dealt = rows.repartitionByRange(*[F.asc_nulls_first(c) for c in by]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in by])
    place = F.monotonically_increasing_id()
    return dealt.withColumns({"part": F.shiftright(place, 33), "at": place.bitwiseAND(F.lit((1 << 33) - 1))})


def _numbered(ordered: DataFrame) -> DataFrame:
    """number: place of each row over all ranges, from 0."""
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return ordered.join(F.broadcast(base), "part").withColumn("number", (F.col("at") + F.col("base")).cast("long")).drop("part", "at", "base")


def _blocks(nodes: DataFrame, members: Column, p: ManifestParams) -> DataFrame:
    """grp, block, alone (the group has no other block), members in order: at most p.block of them."""
    block = F.floor(F.col("pos") / p.block).cast("long").alias("block")
    return nodes.groupBy("grp", block).agg((F.max("size") <= p.block).alias("alone"), F.array_sort(F.collect_list(members)).alias("members"))


def _with_paths(tier: DataFrame, paths: DataFrame) -> DataFrame:
    """The members of each block as consecutive rows; the first carries the rest of the block's path."""
    flat = tier.join(paths, ["grp", "block"]).select(*tier.drop("members").columns, "steps", "subroot", "root", F.posexplode("members").alias("at", "m"))
    first = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)
    return flat.select(*tier.drop("members").columns, first("steps"), first("subroot"), first("root"), "m.*")
