"""Queries over serialized objects and dependencies that Spark builds from the given tables; part of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, t
from .operators import artifacts

_PLANTED = [("collections", "OrderedDict"), ("posix", "system"), ("sklearn.tree._classes", "DecisionTree"), ("builtins", "eval"), ("numpy", "dtype"), ("subprocess", "Popen")]
_ENDS = [".pkl", ".safetensors", ".BIN", ".gguf", ""]


def _hex(text: str) -> Column:
    return F.unhex(F.lit(text))


def _short(text: str) -> Column:
    """A short text and its place in the memo, as opcodes."""
    return F.concat(_hex(f"8C{len(text):02X}"), F.lit(text).cast("binary"), _hex("94"))


def pickled_documents(s: SparkSession, d: str) -> DataFrame:
    """doc_id, path, content: each document's text as the argument of a planted callable, pickled; each seventh lacks its last two bytes."""
    docs, key = t(s, d, "documents"), F.pmod("doc_id", F.lit(len(_PLANTED)))
    planted = F.lit(None).cast("binary")
    for i, (module, name) in enumerate(_PLANTED):
        planted = F.when(key == i, F.concat(_short(module), _short(name))).otherwise(planted)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.lpad(F.hex(F.octet_length(text)), 8, "0")
    size = F.unhex(F.concat(*[F.substring(size, at, 2) for at in (7, 5, 3, 1)]))  # little end first
    end = F.when(F.col("doc_id") % 7 == 0, F.lit("").cast("binary")).otherwise(_hex("522E"))
    path = F.concat(F.lit("models/"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("doc_id") % len(_ENDS) + 1).cast("int")))
    return docs.select("doc_id", path.alias("path"), F.concat(_hex("8004"), planted, _hex("9358"), size, text, _hex("85"), end).alias("content"))


@query("artifact_findings", f"""
WITH p AS (SELECT 'models/' || doc_id || ['{"', '".join(_ENDS)}'][(doc_id % 5 + 1)::INT] AS location, doc_id % 5 AS e, doc_id % 7 = 0 AS cut, doc_id % 6 AS k FROM documents),
 f AS (SELECT location, unnest(CASE WHEN e IN (0, 2) THEN [CASE WHEN cut THEN {{'category': 'SCAN_ERROR', 'severity': 'high', 'details': 'truncated'}} END,
  CASE k WHEN 1 THEN {{'category': 'UNSAFE_PICKLE', 'severity': 'critical', 'details': 'posix.system'}} WHEN 3 THEN {{'category': 'UNSAFE_PICKLE', 'severity': 'critical', 'details': 'builtins.eval'}}
   WHEN 5 THEN {{'category': 'UNSAFE_PICKLE', 'severity': 'critical', 'details': 'subprocess.Popen'}} END,
  CASE WHEN NOT cut THEN {{'category': 'RAW_PICKLE_FORMAT', 'severity': 'low', 'details': CASE WHEN k = 2 THEN 'sklearn' ELSE '' END}} END]
  WHEN e = 1 THEN [{{'category': 'SAFE_FORMAT', 'severity': 'info', 'details': ''}}] ELSE [{{'category': 'UNKNOWN_FORMAT', 'severity': 'low', 'details': ''}}] END) AS x FROM p)
SELECT location, x.category AS category, x.severity AS severity, 1::BIGINT AS count, x.details AS details FROM f WHERE x IS NOT NULL""")
def artifact_findings(s, d):
    """Findings of the pickled documents."""
    files = pickled_documents(s, d).select(F.struct("doc_id", "path").alias("file"), "content")
    scanned = artifacts.scan_content(files, "file").select("file.path", "imports", "status")
    return artifacts.findings(scanned, "path").select("location", "category", "severity", "count", F.array_join("details", ",").alias("details"))


@query("dependency_findings", """
WITH v AS (SELECT 'V-' || l_orderkey AS id, 'p' || l_partkey AS name, '1.' || l_linenumber AS version, l_linenumber AS position, l_orderkey AS k, CASE WHEN l_returnflag = 'A' THEN 'CVE-' || l_orderkey END AS cve, '2.' || l_suppkey AS fix FROM lineitem),
 p AS (SELECT 'p' || p_partkey AS name, '1.' || (p_size % 4 + 1) AS version FROM part WHERE p_partkey <> 7),
 o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position, name, version, cve NULLS FIRST, fix) AS r FROM v JOIN p USING (name, version)),
 s AS (SELECT o_orderkey AS k, CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '5' THEN 'low' END AS severity FROM orders)
SELECT coalesce(cve, id) AS category, coalesce(severity, 'medium') AS severity, name || '==' || version AS location, fix, CASE WHEN severity IS NULL THEN 'unknown' ELSE 'ghsa' END AS source FROM o LEFT JOIN s USING (k) WHERE r = 1""")
def dependency_findings(s, d):
    """Parts as packages, line items as advisories for a version, orders with the severity of an advisory."""
    text = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    packages = t(s, d, "part").select(text("p", "p_partkey").alias("name"), F.concat(F.lit("1."), (F.col("p_size") % 4 + 1).cast("string")).alias("version"))
    aliases = F.array_compact(F.array(F.when(F.col("l_returnflag") == "A", text("CVE-", "l_orderkey")), text("GHSA-", "l_orderkey")))
    advisories = t(s, d, "lineitem").select(text("V-", "l_orderkey").alias("id"), text("p", "l_partkey").alias("name"), text("1.", "l_linenumber").alias("version"), F.col("l_linenumber").alias("position"), aliases.alias("aliases"), F.array(text("2.", "l_suppkey")).alias("fix_versions"))
    level = F.substring("o_orderpriority", 1, 1)
    severity = F.when(level == "1", "critical").when(level == "2", "high").when(level == "5", "low")
    severities = t(s, d, "orders").select(text("GHSA-", "o_orderkey").alias("id"), severity.alias("severity"))
    found = artifacts.dependency_findings(packages, advisories, severities, ("p7",))
    return found.select("category", "severity", "location", F.element_at("details.fix_versions", 1).alias("fix"), F.col("details.severity_source").alias("source"))
