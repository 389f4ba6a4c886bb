"""Queries over signed documents that Spark builds from the given tables; part of the catalog."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, t
from .functions import ed25519
from .operators import verification
from .sources.directory import read_directory, working_copies

_SEED = hashlib.sha256(b"veilmark example key").digest()
_KEY = ed25519.public_key(_SEED)
_FINGERPRINT = verification.key_fingerprint(_KEY)


def supplier_documents(s: SparkSession, d: str) -> DataFrame:
    """s_suppkey, document: each supplier's parts as artifacts, its counts by return flag as events, signed."""
    li = t(s, d, "lineitem")
    part = F.col("l_partkey").cast("string")
    parts = li.select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").distinct().groupBy("s_suppkey")
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("l_partkey", F.concat(F.lit("part/"), part).alias("path"), F.sha2(part.cast("binary"), 256).alias("sha256")))).alias("parts"))
    event = F.to_json(F.struct(F.lit("counted").alias("event_type"), F.struct(F.col("l_returnflag").alias("flag"), F.col("n")).alias("payload")))
    counts = li.groupBy(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag").agg(F.count("*").alias("n"))
    counts = counts.groupBy("s_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", event.alias("event")))), lambda e: e["event"]).alias("events"))
    parts = parts.withColumn("root", verification.merkle_root(F.transform("parts", lambda p: p["sha256"])))
    identity = F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("passport_id"), F.lit(_FINGERPRINT).alias("public_key_fingerprint"), F.col("root").alias("merkle_root"))
    artifacts = F.transform("parts", lambda p: F.struct(p["sha256"].alias("sha256"), p["path"].alias("path")))
    rows = t(s, d, "supplier").join(parts, "s_suppkey").join(counts, "s_suppkey")
    text = F.to_json(F.struct(F.col("s_name").alias("name"), identity.alias("identity"), artifacts.alias("artifacts")))
    return rows.select("s_suppkey", verification.sealed(_SEED)(text, F.col("events")).alias("document"))


@query("verify_documents", rf"""
WITH RECURSIVE p AS (SELECT DISTINCT l_suppkey k, l_partkey p FROM lineitem),
h AS (SELECT k, list(sha256(p::VARCHAR) ORDER BY p) l, string_agg('{{"path":"part/' || p || '","sha256":"' || sha256(p::VARCHAR) || '"}}', ',' ORDER BY p) a FROM p GROUP BY k),
m AS (SELECT k, list_transform(list_sort(l), lambda x: sha256('\x00'::BLOB || unhex(x))) l FROM h
 UNION ALL SELECT k, [CASE WHEN i < len(l) THEN sha256('\x01'::BLOB || unhex(l[i]) || unhex(l[i + 1])) ELSE l[i] END FOR i IN range(1, len(l) + 1, 2)] FROM m WHERE len(l) > 1),
e AS (SELECT l_suppkey k, count(DISTINCT l_returnflag) n, min(l_returnflag) f FROM lineitem GROUP BY 1),
d AS (SELECT s_suppkey, s_suppkey % 6 kind, n, f, '{{"artifacts":[' || a || '],"identity":{{"merkle_root":"' || m.l[1] || '","passport_id":"s' || s_suppkey || '","public_key_fingerprint":"{_FINGERPRINT}","signature":null}},"name":"' || s_name || '"}}' t
 FROM supplier JOIN h ON h.k = s_suppkey JOIN e ON e.k = s_suppkey JOIN m ON m.k = s_suppkey AND len(m.l) = 1),
x AS (SELECT *, CASE kind WHEN 1 THEN regexp_replace(t, '"sha256":"[0-9a-f]{{4}}', '"sha256":"0000', 'g') WHEN 4 THEN regexp_replace(t, '"merkle_root":"[0-9a-f]{{4}}', '"merkle_root":"0000') ELSE t END u FROM d)
SELECT s_suppkey, kind <> 3 AS parsed, CASE WHEN kind <> 3 THEN sha256(u) END AS payload_sha256, kind NOT IN (1, 3, 4) AS merkle_ok, kind <> 3 AS fingerprint_ok, kind NOT IN (1, 3, 4) AS signature_ok,
 CASE WHEN kind IN (1, 4) THEN '0:chain' WHEN kind = 3 THEN NULL WHEN kind = 2 AND f = 'A' THEN '0:signature' || CASE WHEN n > 1 THEN ',1:chain' ELSE '' END ELSE '' END AS problems,
 kind IN (0, 5) OR kind = 2 AND f <> 'A' AS verified FROM x""")
def verify_documents(s, d):
    """Every sixth document has changed artifacts, a changed event, a cut text or another root."""
    kind, text = F.col("s_suppkey") % 6, F.col("document")
    found = F.when(kind == 1, F.regexp_replace(text, '"sha256":"[0-9a-f]{4}', '"sha256":"0000')).when(kind == 2, F.replace(text, F.lit('"flag":"A"'), F.lit('"flag":"B"')))
    found = found.when(kind == 3, F.left(text, F.length(text) - 5)).when(kind == 4, F.regexp_replace(text, '"merkle_root":"[0-9a-f]{4}', '"merkle_root":"0000')).otherwise(text)
    rows = verification.verify_documents(supplier_documents(s, d).withColumn("document", found), _KEY)
    problems = F.array_join(F.transform("event_problems", lambda p: F.concat_ws(":", p["event"].cast("string"), p["problem"])), ",")
    return rows.select("s_suppkey", "parsed", "payload_sha256", "merkle_ok", "fingerprint_ok", "signature_ok", problems.alias("problems"), "verified")


@query("accept_events", """SELECT s_suppkey::VARCHAR AS id, s_suppkey % 3 = 0 AS accepted, CASE s_suppkey % 3 WHEN 1 THEN 'chain' WHEN 2 THEN 'signature' END AS reason
FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)""")
def accept_events(s, d):
    """Offers the last event of each document to the document without it, in two of three cases with another previous hash or body."""
    docs = supplier_documents(s, d)
    events = F.try_variant_get(verification.variant(F.col("document")), "$.events", "array<variant>")
    last = F.to_json(F.element_at(events, -1))
    kind = F.col("s_suppkey") % 3
    event = F.when(kind == 1, F.regexp_replace(last, '"prev_event_sha256":"[0-9a-f]{4}', '"prev_event_sha256":"0000')).when(kind == 2, F.replace(last, F.lit('"counted"'), F.lit('"other"'))).otherwise(last)
    rest = F.replace("document", last, F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(rest, r",\]", "]"), r'"events":\[,', '"events":[')
    key = F.col("s_suppkey").cast("string").alias("id")
    return verification.accept_events(docs.select(key, rest.alias("document")), docs.select(key, event.alias("event")), _KEY).select("id", "accepted", "reason")


def _folder(s: SparkSession) -> str:
    shared = s.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="veilmark-") if s.sparkContext.master.startswith("local") else s.conf.get("spark.sql.warehouse.dir"))
    return f"{shared}/documents-{uuid.uuid4().hex}"


@query("document_directory", """
WITH r AS (SELECT p_brand m, p_size v, max(p_partkey) k, count(*) n FROM part GROUP BY 1, 2)
SELECT m || '/' || v AS passport_id, CASE WHEN k % 2 = 0 THEN n::VARCHAR ELSE 'old' END AS version, k % 2 <> 0 AS archived FROM r WHERE CASE WHEN k % 2 = 0 THEN n > 1 ELSE k % 3 = 0 END""")
def document_directory(s, d):
    """Documents of part groups, all in the archive and half of them newer in the folder, among lines that are none; those that pass."""
    rows = t(s, d, "part").groupBy(F.col("p_brand").alias("m"), F.col("p_size").alias("v")).agg(F.max("p_partkey").alias("k"), F.count("*").alias("n"))

    def text(version, verdict):
        identity = F.struct(F.concat_ws("/", "m", F.col("v").cast("string")).alias("passport_id"), F.col("m").alias("model_name"), version.alias("version"), F.lit("2024-01-01").alias("created_at"))
        return F.to_json(F.struct(identity.alias("identity"), F.struct(F.when(verdict, "pass").otherwise("fail").alias("verdict")).alias("policy")))

    folder = _folder(s)
    rows.where("k % 2 = 0").select(text(F.col("n").cast("string"), F.col("n") > 1).alias("value")).write.text(folder)
    old = rows.select(text(F.lit("old"), F.col("k") % 3 == 0).alias("value"))
    old.union(rows.select(F.concat(F.lit('{"identity": '), F.col("m")))).write.text(f"{folder}/history")
    return working_copies(read_directory(s, folder, lines="true", suffix=".txt")).where("verdict = 'pass'").select("passport_id", "version", "archived")
