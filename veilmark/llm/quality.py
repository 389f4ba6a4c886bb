"""Quality rules as a learned decision list.

Rules that reject a text are conjunctions of thresholds on its statistics.  Sequential covering learns them
from labelled statistics: a rule is grown threshold by threshold on two thirds of the rows by information gain,
pruned on the rest to the shortest form with the best precision there, accepted if that precision is high
enough, and the rows it covers leave before the next rule is grown.  The list is emitted as one ordered Spark
conditional expression.  Every labelled row counts; each step is one aggregate over binned statistics.

Defined results: a null or wordless text has zeros everywhere and fails the base rule; labels with a null
doc_id or quality are ignored; conflicting labels of a doc_id count as low if any is; without labels of both
kinds there are no rules; a null doc_id is never labelled; repeated rows each give a row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import Stage

_SPACE = r"[\x20\x09-\x0D]+"
_REPEAT_WORDS = 8


@dataclass(frozen=True)
class QualityParams:
    bins: int = 24
    rules: int = 8
    terms: int = 3
    #: precision that a rule must have on the rows it was not grown on
    precision: float = 0.9
    #: rows, and share of the low-quality rows, that a rule must cover there
    least_rows: int = 3
    least_share: float = 0.01


@dataclass(frozen=True)
class DecisionList:
    #: each rule: (statistic, "ge" or "lt", threshold) terms that must all hold
    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def rejects(self) -> Column:
        """Number of the first rule that holds, from 1; null if none does."""
        out = F.lit(None).cast("int")
        for i in range(len(self.rules), 0, -1):
            holds = F.lit(True)
            for name, side, value in self.rules[i - 1]:
                holds = holds & ((F.col(name) >= value) if side == "ge" else (F.col(name) < value))
            out = F.when(holds, F.lit(i)).otherwise(out)
        return out


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the statistics of the text as columns q_*; rows stay as they are."""
    x = F.coalesce(F.col(text).cast("string"), F.lit(""))
    has_word = r"[^\x20\x09-\x0D]"
    docs = docs.withColumn("q_words", F.array_remove(F.split(x, _SPACE), ""))
    docs = docs.withColumn("q_lines", F.filter(F.split(x, "\n"), lambda line: line.rlike(has_word)))
    without = lambda pattern: F.length(F.regexp_replace(x, pattern, ""))
    docs = docs.withColumn("q_n_words", F.size("q_words").cast("long")).withColumn("q_word_chars", F.length(F.array_join("q_words", "")).cast("long"))
    docs = docs.withColumn("q_n_symbols", (F.length(x) - without(r"[#*$%&|<>]+")).cast("long")).withColumn("q_n_capitals", (F.length(x) - without(r"\p{Lu}+")).cast("long"))
    docs = docs.withColumn("q_n_lines", F.size("q_lines").cast("long")).withColumn("q_n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
    # hashes of windows of 1, 2, 4 and 8 words, each from two of the size before
    docs = docs.withColumn("q_gram", F.transform("q_words", lambda w: F.xxhash64(w)))
    half = 1
    while half < _REPEAT_WORDS:
        left = F.greatest(F.size("q_gram") - half, F.lit(0))
        docs = docs.withColumn("q_gram", F.zip_with(F.slice("q_gram", 1, left), F.slice("q_gram", half + 1, left), lambda a, b: F.xxhash64(a, b)))
        half *= 2
    again = F.size(F.array_distinct("q_gram")) < F.size("q_gram")
    sorted_grams = F.array_sort(F.transform("q_gram", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    docs = docs.withColumn("q_order", F.when(again, sorted_grams)).drop("q_gram", "q_lines", "q_words")
    same = lambda s, i, d: F.coalesce(F.get(F.col("q_order"), i + d)["h"] == s["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter("q_order", lambda s, i: same(s, i, -1) | same(s, i, 1)), lambda s: s["i"]))
    docs = docs.withColumn("q_order", places)
    # words that the windows at these places cover
    covered = F.aggregate(F.transform("q_order", lambda at, i: F.least(F.lit(_REPEAT_WORDS), F.coalesce(F.get(F.col("q_order"), i + 1) - at, F.lit(_REPEAT_WORDS)))), F.lit(0), lambda n, x: n + x)
    docs = docs.withColumn("q_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("q_order")
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("q_n_words", "q_word_chars", "q_n_lines"))
    return docs.withColumns({
        "q_base_failed": (F.col("q_n_words") < 20) | (100 * F.col("q_n_repeat_words") > 30 * F.col("q_n_words")),
        "q_word_length": F.col("q_word_chars") / words,
        "q_symbol_share": F.col("q_n_symbols") / chars,
        "q_capital_share": F.col("q_n_capitals") / chars,
        "q_dup_line_share": F.col("q_n_dup_lines") / lines,
        "q_repeat_share": F.col("q_n_repeat_words") / words,
        "q_line_words": F.col("q_n_words") / lines,
    })


FEATURES = ["q_n_words", "q_word_length", "q_symbol_share", "q_capital_share", "q_dup_line_share", "q_repeat_share", "q_line_words"]


def _edges(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Bin edges of each statistic: the least value of the group of values, equal at three significant digits, that holds a quantile.

    There are so few groups (900 for each power of ten) that they are counted exactly in one aggregate and ranked
    by statistic; the edges do not depend on how the rows lie in partitions, as those of a quantile sketch would.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("x")) for f in FEATURES])).alias("p")
    counts = rows.select(pairs).groupBy("p.f", F.format_string("%.2e", "p.x").alias("g")).agg(F.count("*").alias("n"), F.min("p.x").alias("x"))
    by = Window.partitionBy("f")
    upto = F.sum("n").over(by.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.select("f", "x", "n", upto.alias("upto"), F.sum("n").over(by).alias("all"))
    # a group holds a quantile if the i-th of the bins' shares, with i from 1 to bins - 1, ends in it
    share = lambda n: F.floor(n * bins / F.col("all"))
    held = ranked.where(F.least(share(F.col("upto")), F.lit(bins - 1)) > share(F.col("upto") - F.col("n")))
    edges: dict[str, list[float]] = {f: [] for f in FEATURES}
    for r in held.orderBy("f", "x").collect():  # statistics x bins rows
        edges[r.f].append(r.x)
    return edges


def learn(stage: Stage, rows: DataFrame, params: QualityParams = QualityParams()) -> DecisionList:
    """A decision list from rows(doc_id, low as 0/1, the statistics)."""
    p = params
    edges = _edges(rows, p.bins)
    rank = lambda f: F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[f]]), lambda e: F.col(f) >= e)) if edges[f] else F.lit(0)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) > 0
    binned = stage.table(rows.select("low", part.alias("grow"), *[rank(f).alias(f) for f in FEATURES]), "binned")
    total = binned.agg(F.sum("low").alias("low"), F.count("*").alias("n")).first()
    found: list[list[tuple[str, str, int]]] = []
    if not total["low"] or total["low"] == total["n"]:
        return DecisionList()

    def holds(terms: list[tuple[str, str, int]]) -> Column:
        out = F.lit(True)
        for f, side, b in terms:
            out = out & ((F.col(f) >= b) if side == "ge" else (F.col(f) < b))
        return out

    def bits(bad: float, good: float) -> float:
        return math.log2((bad + 1e-9) / (bad + good + 1e-9))

    while len(found) < p.rules:
        left = binned
        for rule in found:
            left = left.where(~holds(rule))
        terms: list[tuple[str, str, int]] = []
        while len(terms) < p.terms:
            pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("x")
            table = left.where("grow").where(holds(terms)).select("low", pairs).groupBy("x.f", "x.b").agg(F.sum("low").alias("bad"), F.sum(1 - F.col("low")).alias("good")).collect()  # statistics x bins
            bad0 = sum(r.bad for r in table if r.f == FEATURES[0])
            good0 = sum(r.good for r in table if r.f == FEATURES[0])
            if not bad0 or not good0:
                break
            best = (0.0, None)
            for f in FEATURES:
                counts = {r.b: (r.bad, r.good) for r in table if r.f == f}
                for b in range(1, len(edges[f]) + 1):
                    upper = [sum(v[k] for c, v in counts.items() if c >= b) for k in (0, 1)]
                    for side, bad, good in (("ge", *upper), ("lt", bad0 - upper[0], good0 - upper[1])):
                        if bad:
                            gain = bad * (bits(bad, good) - bits(bad0, good0))
                            best = max(best, (gain, (f, side, b)), key=lambda x: x[0])
            if best[1] is None or best[0] < 1e-6 * bad0 + 0.5:
                break
            terms.append(best[1])
        if not terms:
            break
        counts = left.where("not grow").agg(F.sum("low").alias("all"), *[F.sum(holds(terms[:k]).cast("int") * v).alias(f"{c}{k}") for k in range(1, len(terms) + 1) for c, v in (("bad", F.col("low")), ("good", 1 - F.col("low")))]).first()
        scored = [((counts[f"bad{k}"] or 0, counts[f"good{k}"] or 0), k) for k in range(1, len(terms) + 1)]
        (bad, good), k = max(scored, key=lambda s: (round((s[0][0] + 1) / (s[0][0] + s[0][1] + 2), 3), -s[1]))
        if bad < max(p.least_rows, p.least_share * (counts["all"] or 0)) or bad < p.precision * (bad + good):
            break
        found.append(terms[:k])
    return DecisionList([[(f, side, float(edges[f][b - 1])) for f, side, b in rule] for rule in found])


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> tuple[DataFrame, DecisionList]:
    """Each row's doc_id and statistics (without the text), q_rule and q_kept; and the list."""
    stage = Stage(spark, "quality")
    stats = stage.table(statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    learned = learn(stage, _labelled(stats, labels), params)
    return _apply(stats, learned), learned


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    low = labels.select(F.col("doc_id"), (1 - F.col("quality")).cast("int").alias("low")).dropna().groupBy("doc_id").agg(F.max("low").alias("low"))
    return stats.where("not q_base_failed").join(low, "doc_id")


def _apply(stats: DataFrame, learned: DecisionList) -> DataFrame:
    return stats.withColumn("q_rule", learned.rejects()).withColumn("q_kept", ~F.col("q_base_failed") & F.col("q_rule").isNull())


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs that the base rule and the list keep, with docs' own columns."""
    stage = Stage(spark, "quality")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text"))
    stats = stage.table(statistics(rows).drop("text"), "rows")
    learned = learn(stage, _labelled(stats.drop("row"), labels), params)
    return _apply(stats, learned).where("q_kept").select("row.*")
