"""Personal-data scan of table columns, by values and by names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

CARD_RATE, EXAMPLES, SAMPLE_ROWS, FREE_TEXT_ROWS = 0.5, 2, 10_000, 200  # fixed values


def _finder(entity: str, named: str | None, as_of: Column | None):
    if entity == "PHONE" and named == "PHONE":  # bare digit strings are phones only where the name says so
        return lambda x: F.when(F.size(P.found_phones(x)) > 0, P.found_phones(x)).otherwise(F.regexp_extract_all(x, F.lit(P.UNICODE + P.BARE_PHONE), F.lit(0)))
    return (lambda x: P.found_dates(x, as_of)) if entity == "DATE" else P.FINDERS[entity]


def scan(df: DataFrame, dataset: str, sample_rows: int | None = SAMPLE_ROWS, as_of: Column | None = None) -> DataFrame:
    """Findings: scanner, category, severity, location, count, hit_rate, confidence, direct_identifier, evidence, masked_examples.

    One pass counts all columns and kinds; examples are masked before they leave it.
    """
    spark = df.sparkSession
    columns = df.columns
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    if sample_rows:
        text = text.withColumn("o", F.xxhash64(*text.columns)).orderBy("o").limit(sample_rows).drop("o")
    named = [P.entity_of_name(c) for c in columns]
    stats, hits = [], []
    for i, name in enumerate(named):
        x = F.when(F.trim(f"c{i}") != "", F.col(f"c{i}"))
        stats += [F.count(x).alias(f"n{i}"), F.avg(x.rlike(r"(?U)\s").cast("int")).alias(f"w{i}")]
        for entity in P.FINDERS:
            key = f"{i}_{entity}"
            hits.append(_finder(entity, name, as_of)(x).alias(f"hits{key}"))
            masked = F.when(F.size(f"hits{key}") > 0, P.masked(F.get(f"hits{key}", F.lit(0)), entity))
            stats += [F.count_if(F.size(f"hits{key}") > 0).alias(f"h{key}"), F.min(masked).alias(f"a{key}"), F.max(masked).alias(f"b{key}")]
    row = text.select("*", *hits).agg(*stats).first()  # hits are bound before they are counted
    out = []
    for i, c in enumerate(columns):
        n, name = row[f"n{i}"], named[i]
        hits = {e: (row[f"h{i}_{e}"], sorted({row[f"a{i}_{e}"], row[f"b{i}_{e}"]} - {None})) for e in P.FINDERS if row[f"h{i}_{e}"]}
        if name == "DATE_OF_BIRTH" and "DATE" in hits:
            hits[name] = hits.pop("DATE")
        if "CREDIT_CARD" in hits and name != "CREDIT_CARD" and hits["CREDIT_CARD"][0] / n < CARD_RATE and (row[f"w{i}"] or 0) <= 0.5:
            del hits["CREDIT_CARD"]
        for entity, (count, examples) in hits.items():
            rate = count / n
            agrees = entity == name
            out.append((entity, f"{dataset}:{c}", count, rate, max(rate, 0.9) if agrees else rate, "column name and values" if agrees else "values", examples))
        if name and name not in hits:
            out.append((name, f"{dataset}:{c}", n, None, 0.6, "column name", []))
    found = spark.createDataFrame([("pii", e, P.ENTITIES[e][0], loc, n, r, conf, P.ENTITIES[e][1], ev, ex) for e, loc, n, r, conf, ev, ex in out], "scanner string, category string, severity string, location string, count long, hit_rate double, confidence double, direct_identifier boolean, evidence string, masked_examples array<string>")
    return found


def value_hits(df: DataFrame, column: str, entities: list[str] | None = None, as_of: Column | None = None) -> DataFrame:
    """entity, rows_hit, values_hit of one text column, over all rows."""
    x = F.col(f"`{column}`")
    kinds = list(entities or P.FINDERS)
    found = df.select(*[F.greatest(F.size(_finder(e, None, as_of)(x)), F.lit(0)).alias(f"n{i}") for i, e in enumerate(kinds)])  # each text is searched once
    stats = [F.struct(F.lit(e).alias("entity"), F.count_if(F.col(f"n{i}") > 0).alias("rows_hit"), F.coalesce(F.sum(f"n{i}"), F.lit(0)).cast("long").alias("values_hit")) for i, e in enumerate(kinds)]
    return found.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def first_examples(df: DataFrame, column: str, entity: str, order: str, n: int = EXAMPLES) -> DataFrame:
    """The first n masked values by an order column; a top-n, not a window over all rows."""
    hit = F.get(P.FINDERS[entity](F.col(f"`{column}`")), F.lit(0))
    return df.select(F.col(order), hit.alias("hit")).where("hit is not null").orderBy(order).limit(n).select(order, P.masked(F.col("hit"), entity).alias("masked"))


def pii_columns(findings: DataFrame) -> DataFrame:
    return findings.where("scanner = 'pii' and direct_identifier").select("location").distinct()


def examples_per_group(findings: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """At most n rows of (location, category) groups of a long table of masked hits."""
    w = Window.partitionBy("location", "category").orderBy("masked")
    return findings.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")
