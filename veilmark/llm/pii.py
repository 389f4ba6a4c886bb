"""Personal data: fixed patterns plus bootstrapped contextual extraction.

Identifier-like strings (runs of identifier characters with several digits) and the words before them form a
bipartite graph of lexical patterns and instances.  Seeds are the instances that the fixed patterns cover.  In
each round a pattern's score is the share of its occurrences whose instance is trusted, weighted by the number of
different trusted instances; instances whose patterns are trusted enough become trusted themselves.  Strings
outside the fixed patterns that end up trusted are reported as context spans.

Defined results: a null text is empty and has no spans; a null doc_id stays null; repeated rows each give a row
(and count once for each row in the graph); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .staging import Stage

# The patterns of each kind.  Runs are possessive, and a match starts a run or follows another match,
# which finds the same matches in linear time.
_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_RUN = "A-Za-z0-9._@/+-"
CANDIDATE = rf"(?<![{_RUN}])(?=(?:[A-Za-z._@/+-]*+[0-9]){{5}})[{_RUN}]++"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]+", "")


def _keeps() -> dict[str, object]:
    size = lambda h: F.length(_digits(h))
    return {
        "email": None,
        "ip": lambda h: h.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": lambda h: F.when(size(h).between(13, 19), F.call_function("luhn_check", _digits(h))).otherwise(False),
        "phone": lambda h: size(h).between(9, 15),
    }


@dataclass(frozen=True)
class PiiParams:
    rounds: int = 3
    #: least share of trusted occurrences, and number of different trusted instances, of a trusted pattern
    share: float = 0.8
    instances: int = 3
    #: characters before a candidate in which the pattern's words are looked for
    reach: int = 64


def base_spans(text: Column, kind: str) -> Column:
    return spans.matches(text, PATTERNS[kind], _keeps()[kind])


def personal_data(spark: SparkSession, docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context."""
    p = params
    stage = Stage(spark, "pii")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    for kind in PATTERNS:
        found = found.withColumn(kind, base_spans(F.col("text"), kind))
    found = found.withColumn("near", spans.matches(F.col("text"), CANDIDATE))
    base = F.concat(*[spans.tagged(F.col(k), i, k, by_start=False) for i, k in enumerate(PATTERNS)])
    found = found.withColumn("base", base)
    # the last two words before the candidate, lower-cased, digits as one sign
    tail = lambda s: F.substring(s["gap"], -p.reach, p.reach)
    word = lambda s: F.lower(F.regexp_replace(F.regexp_extract(tail(s), r"((?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1), "[0-9]+", "#"))
    near = F.transform("near", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("instance"), word(s).alias("pattern"), spans.overlaps(s, F.col("base")).alias("seed")))
    found = stage.table(found.select("row", "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS], "base", near.alias("near")), "found")
    seen = found.where(F.size("near") > 0).select("row", F.explode("near").alias("n")).select("row", "n.*").where("pattern <> ''")
    edges = stage.table(seen.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    known = stage.table(edges.where("seed").select("instance").distinct(), "known0")
    good = None
    for r in range(1, p.rounds + 1):
        marked = edges.join(known.withColumn("trusted", F.lit(True)), "instance", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
        scored = marked.groupBy("pattern").agg(F.sum(F.when(F.col("trusted"), F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("n"), F.count(F.when(F.col("trusted"), 1)).alias("kinds"))
        good = stage.table(scored.where((F.col("hits") >= p.share * F.col("n")) & (F.col("kinds") >= p.instances)).select("pattern"), f"good{r}")
        # an instance is trusted when most of its occurrences are in trusted patterns
        judged = edges.join(good.withColumn("good", F.lit(True)), "pattern", "left").groupBy("instance").agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("n"))
        known = stage.table(known.union(judged.where(F.col("hits") >= p.share * F.col("n")).select("instance")).distinct(), f"known{r}")
    fresh = seen.where("not seed").join(good, "pattern", "left_semi").join(known, "instance", "left_semi")
    context = fresh.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("more"))  # spans of one text
    out = found.join(context, "row", "left").withColumn("more", spans.tagged(F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>")), len(PATTERNS), "context", by_start=False))
    digest = F.sha2(spans.listed(F.col("base")).cast("binary"), 256)
    return out.select("doc_id", *[f"n_{k}" for k in PATTERNS], digest.alias("base_sha256"), spans.listed(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_context"))
