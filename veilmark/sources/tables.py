"""Table and corpus sources and sinks."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.profile import restore_types
from ..operators.text import SPANS, detect_records

TABULAR = {".csv": ",", ".tsv": "\t", ".parquet": None, ".jsonl": None}


def suffix(path: str) -> str:
    return PurePosixPath(path).suffix.lower()


def load_table(spark: SparkSession, path: str, string_columns: tuple[str, ...] = (), infer: bool = True) -> DataFrame:
    """CSV, TSV, Parquet or JSON lines by suffix; the named columns as text; NaN as null."""
    kind = suffix(path)
    if kind not in TABULAR:
        raise ValueError(f"unsupported table format: {path}")
    if TABULAR[kind]:
        df = spark.read.option("header", True).option("sep", TABULAR[kind]).option("multiLine", True).option("escape", '"').csv(path)
        if infer:
            free = [c for c in df.columns if c not in string_columns]
            typed = restore_types(df.select(*[F.col(f"`{c}`") for c in free]))
            casts = dict(typed.dtypes)
            df = df.select(*[(F.col(f"`{c}`").try_cast(casts[c]).alias(c) if c in casts and casts[c] != "string" else F.col(f"`{c}`")) for c in df.columns])
    else:
        df = spark.read.parquet(path) if kind == ".parquet" else spark.read.json(path)
        df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in string_columns else F.col(f"`{c}`") for c in df.columns])
    return nan_to_null(df)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Text columns of a CSV become numbers only where no code with leading zeros is among them."""
    return load_table(spark, path)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def string_columns(schema: dict[str, str]) -> list[str]:
    return [c for c, t in schema.items() if t in ("object", "str", "string")]


_RAW = "array<struct<start:int,end:int,type:string,label:string>>"


def _spans(raw, text):
    """Valid spans inside the text, type or label in capitals, sorted by start."""
    good = F.filter(raw, lambda e: e["start"].isNotNull() & e["end"].isNotNull() & (e["start"] < e["end"]) & (e["end"] <= F.length(text)))
    kind = lambda e: F.upper(F.coalesce(e["type"], e["label"], F.lit("UNKNOWN")))
    return F.array_sort(F.transform(good, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), kind(e).alias("entity_type"))))


def load_corpus(spark: SparkSession, path: str, detect_missing: bool = False) -> DataFrame:
    """id, text, entities from JSON lines in either dialect (text/entities or source_text/privacy_mask), or one text a line.

    Records without an id get their position in the file, blank lines not counted.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    numbered = lines.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = numbered.groupBy(part.alias("__p")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a file split
    base = sizes.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b"))
    indexed = numbered.withColumn("__p", part).join(F.broadcast(base), "__p").withColumn("index", F.col("b") + F.col("__at").bitwiseAND((1 << 33) - 1))
    if suffix(path) != ".jsonl":
        rows = indexed.select(F.col("index").cast("string").alias("id"), F.col("value").alias("text"), F.lit(None).cast(SPANS).alias("entities"))
    else:
        schema = f"id string, text string, source_text string, entities {_RAW}, privacy_mask {_RAW}"
        rows = indexed.select("index", F.from_json("value", schema).alias("r"))
        text = F.coalesce("r.text", "r.source_text")
        raw = F.coalesce("r.entities", "r.privacy_mask")
        rows = rows.select(F.coalesce("r.id", F.col("index").cast("string")).alias("id"), text.alias("text"), _spans(raw, text).alias("entities"))
    if not detect_missing:
        return rows.withColumn("entities", F.coalesce("entities", F.array().cast(SPANS)))
    found = detect_records(rows.where("entities is null or size(entities) = 0").drop("entities"))
    return rows.where("size(entities) > 0").unionByName(found)


def annotated_parquet(spark: SparkSession, path: str, max_chars: int | None = None, locale: str | None = None, kinds: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Records of an annotated Parquet table (uid, text, locale, spans): only these columns and matching rows are
    read; overlapping spans go, the earlier and longer one stays."""
    df = spark.read.parquet(path).select(F.col("uid").cast("string").alias("id"), "text", "locale", F.from_json("spans", _RAW).alias("raw"))
    df = df.where(F.col("locale") == locale) if locale else df
    df = df.where(F.length("text") <= max_chars) if max_chars else df
    table = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))]) if kinds else None
    named = lambda e: F.coalesce(F.get(F.array(table[e["label"]]), F.lit(0)), F.upper(e["label"])) if table is not None else F.upper(F.coalesce(e["type"], e["label"]))
    ordered = F.array_sort(F.transform("raw", lambda e: F.struct(e["start"].alias("start"), (-e["end"]).alias("minus_end"), named(e).alias("entity_type"))))
    keep = F.aggregate(ordered, F.array().cast(SPANS), lambda acc, e: F.when((F.size(acc) == 0) | (e["start"] >= F.get(acc, F.size(acc) - 1)["end"]), F.concat(acc, F.array(F.struct(e["start"].alias("start"), (-e["minus_end"]).alias("end"), e["entity_type"].alias("entity_type"))))).otherwise(acc))
    df = df.select("id", "text", keep.alias("entities")).where(F.size("entities") > 0)
    return df.limit(limit) if limit else df


def write_corpus(records: DataFrame, path: str) -> None:
    spans = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["entity_type"].alias("type")))
    records.select("id", "text", spans.alias("entities")).write.json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, size of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def directory_hash(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """One row: sha256 over the sorted relpath NUL filehash lines, and the total size."""
    files = file_hashes(spark, root).withColumn("rel", F.expr(f"substring(path, instr(path, '{root.rstrip('/')}') + {len(root.rstrip('/')) + 1})"))
    lines = F.array_sort(F.collect_list(F.concat("rel", F.lit("\u0000"), "sha256", F.lit("\n"))))
    return files.agg(F.sha2(F.concat(F.lit(prefix), F.array_join(lines, "")).cast("binary"), 256).alias("sha256"), F.sum("size").alias("size"))


def synthetic_corpus(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """id, text, entities from templates filled with generated values; the same for the same seed."""
    r = lambda k, m: F.pmod(F.xxhash64("i", F.lit(seed), F.lit(k)), F.lit(m))
    email = F.concat(F.lit("user"), r(1, 10_000).cast("string"), F.lit("@mail"), r(2, 50).cast("string"), F.lit(".test"))
    phone = F.format_string("(%03d) 555-%04d", r(3, 800) + 200, r(4, 10_000))
    templates = [("Please contact ", email, "EMAIL", " about the invoice."), ("Call ", phone, "PHONENUMBER", " before noon."), ("The reset link went to ", email, "EMAIL", "."), ("My new number is ", phone, "PHONENUMBER", ", thanks.")]
    pick = F.array(*[F.struct(F.lit(a).alias("a"), v.alias("v"), F.lit(k).alias("k"), F.lit(b).alias("b")) for a, v, k, b in templates])
    rows = spark.range(n).withColumnRenamed("id", "i").select("i", F.get(pick, r(0, len(templates)).cast("int")).alias("t"))
    span = F.array(F.struct(F.length("t.a").alias("start"), (F.length("t.a") + F.length("t.v")).alias("end"), F.col("t.k").alias("entity_type")))
    return rows.select(F.col("i").cast("string").alias("id"), F.concat("t.a", "t.v", "t.b").alias("text"), span.alias("entities"))


def demo_table(spark: SparkSession, rows: int, seed: int = 0, drift: float = 0.0) -> DataFrame:
    """A census-like table with identifiers and a shift knob."""
    df = spark.range(rows)
    norm = lambda k: F.randn(seed + k)
    df = df.withColumn("age", F.greatest(F.lit(17), F.least(F.lit(90), F.round(norm(1) * 13 + 40 + 5 * drift))).cast("long"))
    df = df.withColumn("hours_per_week", F.greatest(F.lit(1), F.round(norm(2) * 10 + 40 + 10 * drift)).cast("long"))
    df = df.withColumn("zip", F.lpad((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(300)) + 2000).cast("string"), 5, "0"))
    df = df.withColumn("gender", F.when(F.rand(seed + 3) < 0.5, "F").otherwise("M")).withColumn("email", F.concat(F.lit("p"), "id", F.lit("@mail.test")))
    df = df.withColumn("name", F.concat(F.lit("Person "), "id")).withColumn("phone", F.format_string("(%03d) 555-%04d", F.pmod(F.xxhash64("id"), F.lit(800)) + 200, F.pmod("id", F.lit(10_000))))
    odds = (F.col("age") - 40) / 20 + (F.col("hours_per_week") - 40) / 15
    return df.withColumn("income", F.when(F.rand(seed + 4) < 1 / (1 + F.exp(-odds)), ">50K").otherwise("<=50K")).drop("id")


def secret_files(spark: SparkSession, path: str) -> DataFrame:
    """path, category, severity of text files with a private-key header or an access-key id, version-control folders left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    files = files.where(~F.col("path").contains("/.git/"))
    rules = [("PRIVATE_KEY", "high", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"), ("AWS_ACCESS_KEY_ID", "critical", r"\bAKIA[0-9A-Z]{16}\b")]
    hits = F.array_compact(F.array(*[F.when(F.col("value").rlike(p), F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"))) for c, s, p in rules]))
    return files.select("path", F.inline(hits))
