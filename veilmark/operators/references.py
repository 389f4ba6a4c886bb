"""Look-alike values for a candidate: perturbed, from the corpus, or mixed; and stand-in scorers for tests."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grammars import generated
from ..functions.patterns import shape, similar
from ..plans.running import spread, stored
from .text import surrogate


CELL = ["entity_type", "n", "like"]


def _drawn(kind: Column, value: Column, n: int, seed: int, kinds: Collection[str]) -> Column:
    """array<struct<rank, i, v>>: 8 n draws of the type's grammar if it is one of kinds, those like the value first, then n that keep its shape."""
    draw = lambda i: F.lit(seed * 1000) + i
    ours = F.transform(F.sequence(F.lit(1), F.lit(8 * n)), lambda i: F.struct(i.alias("i"), generated(kind, value, draw(i), kinds).alias("v")))
    ours = F.transform(ours, lambda x: F.struct(F.when(similar(value, x["v"]), 0).otherwise(1).alias("rank"), x["i"].alias("i"), x["v"].alias("v")))
    # types without a grammar have nothing but their shape
    shaped = F.transform(F.sequence(F.lit(1), F.lit(3 * n)), lambda i: F.struct(F.lit(2).alias("rank"), i.alias("i"), surrogate(kind, value, draw(i)).alias("v")))
    return F.filter(F.concat(ours, shaped), lambda x: x["v"].isNotNull() & (x["v"] != value))


def _first(rows: Column, n: int) -> Column:
    return F.slice(F.array_distinct(F.transform(F.array_sort(rows), lambda x: x["v"])), 1, n)


def perturbed(kind: Column, value: Column, n: int, seed: int = 0) -> Column:
    """Up to n distinct values of the value's shape, none of them the value."""
    return _first(F.filter(_drawn(kind, value, n, seed, ()), lambda x: x["rank"] == 2), n)


def outside_corpus(targets: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """entity_type, value, made: up to n values that are no value of the corpus: of the type's grammar and like the value,
    then of the grammar, then of the value's shape."""
    asked = stored(targets.select("entity_type", "value").distinct(), "values")
    kinds = {r[0] for r in asked.select(F.upper("entity_type")).distinct().collect()}  # types, not values
    # a value is short, its draws take long; planned with the joins below they would be copied into filters and planned many times
    drawn = stored(spread(asked).select("entity_type", "value", _drawn(F.col("entity_type"), F.col("value"), n, seed, kinds).alias("xs")), "draws")
    rows = drawn.select("entity_type", "value", F.explode("xs").alias("x"))
    free = rows.withColumn("v", F.col("x.v")).join(asked.select(F.col("value").alias("v")).distinct(), "v", "left_anti")
    return free.groupBy("entity_type", "value").agg(_first(F.collect_list("x"), n).alias("made"))


def _case(x: Column) -> Column:
    return F.when(F.left(x, F.lit(1)).rlike(r"^\p{Lu}"), "case A").otherwise("case a")


def corpus_pool(targets: DataFrame, seed: int = 0) -> DataFrame:
    """entity_type, n, like, value, rn, size: the distinct values of a corpus, numbered in hash order in each cell that
    look-alikes are searched in: length and shape, length and first case, and the whole type.

    Numbers come from counts of 1,024 hash ranges of a cell, so no task sorts a whole type.
    """
    size = F.length("value")
    cells = F.array(F.struct(size.alias("n"), F.concat(F.lit("shape "), shape(F.col("value"))).alias("like")), F.struct(size.alias("n"), _case(F.col("value")).alias("like")), F.struct(F.lit(0).alias("n"), F.lit("type").alias("like")))
    rows = targets.select("entity_type", "value").distinct().select("entity_type", F.explode(cells).alias("cell"), "value").select("entity_type", "cell.*", "value")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(1024)))
    cell = Window.partitionBy(*CELL)
    parts = rows.groupBy(*CELL, "part").agg(F.count("*").alias("k"))
    parts = parts.withColumn("before", F.coalesce(F.sum("k").over(cell.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("k").over(cell)).drop("k")
    inside = Window.partitionBy(*CELL, "part").orderBy(F.xxhash64("value", F.lit(seed + 1)), "value")
    return rows.withColumn("rn", F.row_number().over(inside)).join(parts, [*CELL, "part"]).withColumn("rn", F.col("before") + F.col("rn") - 1).drop("before", "part")


def from_corpus(targets: DataFrame, pool: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """id, pos, references: up to n similar values of the same type, and any of the type where none is similar.

    Each distinct candidate takes n + 1 numbers in a row, from a hashed one on, of each of its cells (lengths within a
    quarter; see similar), so every value of a cell can be drawn and the work is in proportion to the candidates.
    """
    x = F.col("candidate")
    size = F.length(x)
    slack = F.greatest(F.lit(1), F.bround(size * 0.25)).cast("int")
    digits = F.length(F.regexp_replace(x, r"\P{Nd}", "")) * 2 >= size
    lengths = F.when(digits, F.array(size)).otherwise(F.sequence(F.greatest(F.lit(1), size - slack), size + slack))
    like = F.when(digits, F.concat(F.lit("shape "), shape(x))).otherwise(_case(x))
    cells = F.concat(F.transform(lengths, lambda k: F.struct(k.alias("n"), like.alias("like"))), F.array(F.struct(F.lit(0).alias("n"), F.lit("type").alias("like"))))
    asked = targets.select("entity_type", F.col("value").alias("candidate")).distinct()
    asked = asked.select("entity_type", "candidate", F.explode(cells).alias("cell")).select("entity_type", "candidate", "cell.*")
    asked = asked.join(pool.select(*CELL, "size").distinct(), CELL)
    asked = asked.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(n + 1), "size") - 1)))
    asked = asked.withColumn("rn", F.pmod(F.pmod(F.xxhash64("candidate", "n", F.lit(seed)), F.col("size")) + F.col("step"), F.col("size"))).drop("step", "size")
    met = asked.join(pool.drop("size"), [*CELL, "rn"]).where(x != F.col("value"))
    order = F.struct(F.xxhash64("value", "candidate", F.lit(seed)).alias("h"), "value")
    near, any_ = (F.array_sort(F.collect_set(F.when(test, order))) for test in (F.col("n") > 0, F.col("n") == 0))
    found = met.groupBy("entity_type", "candidate").agg(near.alias("near"), any_.alias("any"))
    picked = F.transform(F.slice(F.when(F.size("near") > 0, F.col("near")).otherwise(F.col("any")), 1, n), lambda r: r["value"])
    return targets.select("id", "pos", "entity_type", F.col("value").alias("candidate")).join(found.select("entity_type", "candidate", picked.alias("references")), ["entity_type", "candidate"]).select("id", "pos", "references")


def references(targets: DataFrame, n: int, source: str = "mix", seed: int = 0) -> DataFrame:
    """targets with column references: from the corpus, by perturbation, or the first topped up by the second."""
    none = F.array().cast("array<string>")
    out = targets
    if source != "corpus":
        out = out.join(outside_corpus(targets, n, seed), ["entity_type", "value"], "left").select(*targets.columns, F.coalesce("made", none).alias("made"))
    if source == "synthetic":
        return out.withColumnRenamed("made", "references")
    out = out.join(from_corpus(targets, corpus_pool(targets, seed), n, seed), ["id", "pos"], "left")
    own = F.coalesce("references", none)
    return out.withColumn("references", own if source == "corpus" else F.slice(F.array_distinct(F.concat(own, "made")), 1, n)).drop("made")


def variants(targets: DataFrame) -> DataFrame:
    """id, pos, variant, text, start, end: each target's text with its value and with each reference in its place."""
    options = F.concat(F.array(F.col("value")), F.col("references"))
    rows = targets.select("id", "pos", "prefix", "suffix", F.posexplode(options).alias("variant", "v"))
    start = F.length("prefix")
    return rows.select("id", "pos", "variant", F.concat("prefix", "v", "suffix").alias("text"), start.alias("start"), (start + F.length("v")).alias("end"))


class NgramScorer:
    """Character n-gram log-probabilities with add-one smoothing: a deterministic stand-in for a language model."""

    def __init__(self, texts: list[str], n: int = 4) -> None:
        self.n, self.counts, self.totals = n, defaultdict(Counter), Counter()
        self.alphabet = len({c for t in texts for c in t}) + 1
        for t in texts:
            for i, c in enumerate(t):
                self.counts[t[max(0, i - n) : i]][c] += 1
                self.totals[t[max(0, i - n) : i]] += 1

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, float]]]:
        def one(t: str, i: int) -> float:
            context = t[max(0, i - self.n) : i]
            return math.log((self.counts[context][t[i]] + 1) / (self.totals[context] + self.alphabet)) if context in self.counts else -math.log(self.alphabet)

        return [[(i, i + 1, one(t, i)) for i in range(len(t))] for t in texts]
