"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality, toxicity
from .decontaminate import benchmark_hits
from .manifest import document_manifest
from .near_dedup import NearParams, near_duplicates
from .neighbours import nearest
from .packing import pack
from .passages import repeated_passages
from .periodic import periodic_runs, planted, strongest
from .pii import personal_data
from .secrets import secret_spans
from .url_filter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, _table(spark, sf_dir, "documents"), NearParams(num=85, den=100))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark, _table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = quality.judged(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select("doc_id", *[F.col(f"q_{n}").alias(n) for n in names], F.col("q_rule").alias("rule"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark, _table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, _table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    model = language_id.train(spark, docs.where(~held_out))
    return language_id.predict(spark, docs, model, F.col("doc_id"), held_out)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    # the labels know low quality and toxic: the first model's probability is a feature of the second
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    model = toxicity.train(spark, docs, labels, ["low_quality", "toxic"])
    return toxicity.predict(spark, docs, model).where("flagged")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(spark, vectors, vectors.where("id % 20 = 0"))


def _crc32(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    altered = F.when(_crc32(F.col("doc_id")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = document_manifest(spark, _table(spark, sf_dir, "documents"), altered)
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), _crc32(F.col("doc_id"))).alias("text"))
    best, digest = F.col("best"), lambda c: F.sha2(c.cast("binary"), 256)
    every = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    milli = F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli")
    found = periodic_runs(docs).withColumn("best", strongest(F.col("runs")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli, digest(every).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_url_filter, op2_near_dedup, op3_secrets, op4_pii, op5_quality, op6_substring_dedup, op7_packing, op8_language_id, op9_decontaminate, op10_toxicity]
    every += [op11_nearest, op12_merkle_manifest, op13_periodic_runs]
    return {f.__name__: f for f in every} | {"pipeline": pipeline}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN s USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""

OP9_SQL = rf"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) u(i) WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
h AS (SELECT d.doc_id, i, k.size, k.item_id FROM d, (SELECT DISTINCT size FROM k) z, unnest(range(1, len(d.w) - z.size + 2)) u(i) JOIN k ON k.size = z.size AND k.g = array_to_string(d.w[i:i + z.size - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM h, unnest(range(i, i + size)) v(j) GROUP BY 1),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""



def _leaf_sql(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


OP12_SQL = rf"""
WITH RECURSIVE b(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM b WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8),
z(id, s, k, c) AS (SELECT DISTINCT doc_id, doc_id::VARCHAR, 0, 4294967295 FROM documents UNION ALL SELECT id, s, k + 1, xor(c >> 8, t[(xor(c, ord(s[k + 1])) & 255) + 1]) FROM z, t WHERE k < length(s)),
even AS (SELECT id FROM z WHERE k = length(s) AND xor(c, 4294967295) % 2 = 0),
d AS (SELECT *, CASE WHEN doc_id IN (SELECT id FROM even) THEN replace(text, chr(10), '') ELSE text END AS found FROM documents),
f AS (SELECT doc_id, coalesce('=' || source, '') AS src, {_leaf_sql("text")} AS leaf, {_leaf_sql("found")} AS now FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS pos, row_number() OVER () AS rid FROM f),
m(src, lvl, l) AS (SELECT src, 0, list(leaf ORDER BY pos) FROM r GROUP BY src UNION ALL SELECT src, lvl + 1, [sha256(array_to_string(l[i:i + 2], '')) FOR i IN range(1, len(l) + 1, 3)] FROM m WHERE len(l) > 1),
g AS (SELECT src, l[1] AS subroot, row_number() OVER (ORDER BY src) - 1 AS pos FROM m WHERE len(l) = 1),
u(lvl, l) AS (SELECT 0, list(subroot ORDER BY pos) FROM g UNION ALL SELECT lvl + 1, [sha256(array_to_string(l[i:i + 2], '')) FOR i IN range(1, len(l) + 1, 3)] FROM u WHERE len(l) > 1),
n AS (SELECT rid, m.lvl, l, floor(pos / 3 ** m.lvl)::BIGINT AS ix FROM r JOIN m USING (src) WHERE len(l) > 1
 UNION ALL SELECT rid, 1000 + u.lvl, l, floor(g.pos / 3 ** u.lvl)::BIGINT FROM r JOIN g USING (src), u WHERE len(l) > 1),
s AS (SELECT rid, lvl, array_to_string(l[ix - ix % 3 + 1:ix], '') AS a, array_to_string(l[ix + 2:ix - ix % 3 + 3], '') AS z FROM n),
p AS (SELECT rid, list({{'a': a, 'z': z}} ORDER BY lvl) AS steps, sha256(string_agg(a || z, '' ORDER BY lvl)) AS proof FROM s GROUP BY rid),
v(rid, k, h) AS (SELECT rid, 0, now FROM r UNION ALL SELECT v.rid, k + 1, sha256(steps[k + 1].a || h || steps[k + 1].z) FROM v JOIN p USING (rid) WHERE k < len(steps)),
w AS (SELECT rid, arg_max(h, k) AS folded FROM v GROUP BY rid)
SELECT doc_id, leaf, subroot, x.l[1] AS root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = x.l[1] AS verified
FROM r JOIN g USING (src) JOIN w USING (rid) LEFT JOIN p USING (rid), (SELECT l FROM u WHERE len(l) = 1) x"""


def oracle_sql() -> dict[str, str]:
    """The other results depend on learned models, mined rules or hash order; their tests use brute force instead."""
    return {"op2_near_dedup": OP2_SQL, "op9_decontaminate": OP9_SQL, "op12_merkle_manifest": OP12_SQL}
