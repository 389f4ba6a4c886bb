"""Hash chains, Merkle roots, revision differences and lineage."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.documents import canonical_json

GENESIS = "0" * 64


def chain(events: DataFrame, by: str, order: str, body: Column) -> DataFrame:
    """events with seq, prev_hash and hash: each hash covers the body and the hash before it.

    A chain is sequential by nature, so each chain (tenant) is folded in order inside one group.
    """
    keyed = events.select(F.col(by).cast("string").alias("chain"), F.col(order).alias("ord"), body.alias("body"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord").reset_index(drop=True)
        prev, rows = GENESIS, []
        for i, r in enumerate(frame.itertuples(), 1):
            own = hashlib.sha256(f"{prev}:{r.body}".encode()).hexdigest()
            rows.append((r.chain, i, r.body, prev, own))
            prev = own
        return pd.DataFrame(rows, columns=["chain", "seq", "body", "prev_hash", "hash"])

    return keyed.groupBy("chain").applyInPandas(fold, "chain string, seq long, body string, prev_hash string, hash string")


def next_link(log: DataFrame) -> DataFrame:
    """chain, seq, prev_hash that the next event of each chain takes."""
    return log.groupBy("chain").agg((F.max("seq") + 1).alias("seq"), F.max_by("hash", "seq").alias("prev_hash"))


def verify_chain(log: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """chain, seq, problem: a number that is missing before this event, ``link`` (it names another hash than that of the event
    before it) or ``content`` (its own hash is of other contents); empty for an intact log."""
    w = Window.partitionBy("chain").orderBy("seq")
    seen = log.withColumn("want_seq", F.coalesce(F.lag("seq").over(w) + 1, F.lit(1))).withColumn("want_prev", F.coalesce(F.lag("hash").over(w), F.lit(genesis)))
    digest = F.sha2(F.concat_ws(":", "prev_hash", "body").cast("binary"), 256)
    problems = F.array_compact(F.array(
        F.when(F.col("seq") != F.col("want_seq"), F.concat(F.lit("sequence "), F.col("want_seq"), F.lit(" missing"))),
        F.when(F.col("prev_hash") != F.col("want_prev"), F.lit("link")),
        F.when(digest != F.col("hash"), F.lit("content")),
    ))
    return seen.select("chain", "seq", F.explode(problems).alias("problem"))


def chain_status(log: DataFrame) -> DataFrame:
    counted = log.groupBy("chain").agg(F.count("*").alias("events"))
    bad = verify_chain(log).groupBy("chain").agg(F.count("*").alias("problems"))
    return counted.join(bad, "chain", "left").na.fill(0, ["problems"])


def leaf_hash(hex_hash: Column) -> Column:
    return F.sha2(F.concat(F.lit(b"\x00"), F.unhex(hex_hash)), 256)


def merkle_levels(hashes: DataFrame, column: str = "sha256") -> DataFrame:
    """One row: merkle_root over the sorted distinct-position hashes, leaf and node prefixes as in RFC 6962; an odd
    node moves up unchanged.

    Each level is one shuffle of half the rows of the level before; the rank of a leaf comes from range-part counts.
    """
    spark = hashes.sparkSession
    part = Window.partitionBy("__p").orderBy("h", "__i")
    leaves = hashes.select(F.col(column).alias("h"), F.monotonically_increasing_id().alias("__i")).withColumn("__p", F.substring("h", 1, 2))
    sizes = leaves.groupBy("__p").count()
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows
    base = sizes.select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("b"))
    level = leaves.withColumn("r", F.row_number().over(part) - 1).join(F.broadcast(base), "__p").select((F.col("r") + F.col("b")).cast("long").alias("i"), leaf_hash(F.col("h")).alias("h"))
    n = hashes.count()
    if not n:
        return spark.createDataFrame([(hashlib.sha256(b"").hexdigest(),)], "merkle_root string")
    while n > 1:
        node = F.sha2(F.concat(F.lit(b"\x01"), F.unhex("l"), F.unhex("r")), 256)
        pairs = level.groupBy(F.floor(F.col("i") / 2).cast("long").alias("i")).agg(F.min_by("h", "i").alias("l"), F.max_by("h", "i").alias("r"), F.count("*").alias("k"))
        level = pairs.select("i", F.when(F.col("k") == 1, F.col("l")).otherwise(node).alias("h"))
        n = (n + 1) // 2
    return level.select(F.col("h").alias("merkle_root"))


# --- revisions ------------------------------------------------------------------------------------
def dataset_changes(previous: DataFrame, current: DataFrame, key: str = "name", digest: str = "sha256") -> DataFrame:
    """key, status (added, removed, changed, unchanged) by a full outer join."""
    a, b = previous.select(F.col(key), F.col(digest).alias("old")), current.select(F.col(key), F.col(digest).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def revision(previous: DataFrame, current: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """key, change: artifacts added, removed or changed."""
    added = current.join(previous, key, "left_anti").select(key, F.lit("added").alias("change"))
    removed = previous.join(current, key, "left_anti").select(key, F.lit("removed").alias("change"))
    changed = current.select(key, digest).join(previous.select(key, F.col(digest).alias("old")), key).where(F.col(digest) != F.col("old")).select(key, F.lit("changed").alias("change"))
    return added.union(removed).union(changed)


def metric_deltas(previous: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("split", "metric"), value: str = "value") -> DataFrame:
    old = previous.select(*keys, F.col(value).alias("old"))
    return current.join(old, list(keys)).select(*keys, F.round(F.col(value) - F.col("old"), 6).alias("delta"))


def merged_metrics(run: DataFrame, declared: DataFrame, keys: tuple[str, ...] = ("split", "metric"), value: str = "value") -> DataFrame:
    """Run values, overridden by declared ones."""
    a = run.select(*keys, F.col(value).alias("run_value"))
    b = declared.select(*keys, F.col(value).alias("own"))
    return a.join(b, list(keys), "full_outer").select(*keys, F.coalesce("own", "run_value").alias(value))


def artifact_status(recorded: DataFrame, actual: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """key, status: ok, modified or missing."""
    now = actual.select(key, F.col(digest).alias("now"))
    return recorded.join(now, key, "left").select(key, F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col(digest), "ok").otherwise("modified").alias("status"))


def first_by_priority(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """One row for each key, the one with the least priority."""
    packed = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), priority).alias("row"))
    return packed.select("row.*")


def lineage(edges: DataFrame, root: str, depth: int = 10) -> DataFrame:
    """node, depth of everything upstream of the root within the depth, nearest first; edges are (child, parent)."""
    edges = edges.select("child", "parent").distinct()
    known = edges.sparkSession.createDataFrame([(root, 0)], "node string, depth int")
    front = known
    for d in range(1, depth + 1):
        front = edges.join(front, edges.child == front.node).select(F.col("parent").alias("node"), F.lit(d).alias("depth")).distinct().join(known, "node", "left_anti")
        if front.isEmpty():
            break
        known = known.union(front)
    return known


def lineage_nodes(edges: DataFrame, nodes: DataFrame, root: str, depth: int = 10) -> DataFrame:
    """lineage with status known, or missing for parents without a document."""
    known = nodes.select(F.col("node")).distinct().withColumn("status", F.lit("known"))
    return lineage(edges, root, depth).join(known, "node", "left").na.fill("missing", ["status"])


def rollback_pick(deployments: DataFrame, by: list[str]) -> DataFrame:
    """For each group the deployment to go back to: the newest superseded one, older than the active one, of another version."""
    active = deployments.where("status = 'active'").groupBy(*by).agg(F.max("created_at").alias("since"), F.max_by("version", "created_at").alias("now"))
    older = deployments.where("status = 'superseded'").join(active, by).where((F.col("created_at") < F.col("since")) & (F.col("version") != F.col("now")))
    return older.groupBy(*by).agg(F.max_by("version", "created_at").alias("version"))


def login_throttle(attempts: DataFrame, key: str, at: str, success: Column, limit: int = 5, seconds: int = 900) -> DataFrame:
    """attempts with failures (in the window, this one included, since the last success) and blocked."""
    order = Window.partitionBy(key).orderBy(at)
    out = attempts.withColumn("__s", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("__ok", success.cast("int"))
    out = out.withColumn("__seg", F.coalesce(F.sum("__ok").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
    recent = Window.partitionBy(key, "__seg").orderBy("__s").rangeBetween(-(seconds * 1_000_000 - 1), Window.currentRow)
    out = out.withColumn("failures", F.sum(1 - F.col("__ok")).over(recent))
    return out.withColumn("blocked", F.col("failures") >= limit).drop("__s", "__ok", "__seg")


def retry_after(attempts: DataFrame, key: str, at: str, success: Column, limit: int = 5, seconds: int = 900) -> DataFrame:
    """attempts with retry_after: seconds until the limit-th newest failure leaves the window, 0 where not blocked."""
    out = login_throttle(attempts, key, at, success, limit, seconds)
    order = Window.partitionBy(key).orderBy(at)
    oldest = F.lag(F.unix_seconds(F.col(at).cast("timestamp")), limit - 1).over(order)
    wait = oldest + seconds - F.unix_seconds(F.col(at).cast("timestamp"))
    return out.withColumn("retry_after", F.when(F.col("blocked"), F.greatest(wait, F.lit(0))).otherwise(0))
