"""Queries of the entity audit over the documents: gram losses, value grammars, remediation; part of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, t
from .functions import grammars
from .operators import audit, references, text
from .plans import remediation
from .plans.running import shared_folder, spread, stored


def _records(s: SparkSession, d: str) -> DataFrame:
    return text.detect_records(t(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"))


@query("gram_losses", """
WITH t AS (SELECT 'd' AS side, row_number() OVER () AS item_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
 c AS (SELECT side, item_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM t WHERE text <> ''),
 g AS (SELECT side, item_id, lag(ch, 3, ' ') OVER w || lag(ch, 2, ' ') OVER w || lag(ch, 1, ' ') OVER w || ch AS g FROM c WINDOW w AS (PARTITION BY side, item_id ORDER BY i)),
 n AS (SELECT g, count(*) n, sum(count(*)) OVER (PARTITION BY left(g, 3)) w FROM g WHERE side = 'd' GROUP BY g),
 w AS (SELECT DISTINCT left(g, 3) c, w FROM n),
 o AS (SELECT item_id, g FROM g WHERE side = 'b')
SELECT o.item_id, count(*)::BIGINT AS size, round(avg(-ln((coalesce(n.n, 0) + 0.1::DOUBLE) / (coalesce(w.w, 0) + 25.6::DOUBLE))), 6) AS loss
FROM o LEFT JOIN n USING (g) LEFT JOIN w ON w.c = left(o.g, 3) GROUP BY 1""")
def gram_losses(s, d):
    """How well the documents predict each benchmark item, character by character."""
    items = t(s, d, "benchmark").select(F.col("item_id").alias("id"), F.lit(0).alias("pos"), F.lit(0).alias("variant"), "text", F.lit(0).alias("start"), F.length("text").alias("end"))
    losses = audit.gram_losses(items, audit.gram_counts(t(s, d, "documents")))
    return losses.select(F.col("id").alias("item_id"), "size", F.round("loss", 6).alias("loss"))


@query("entity_audit")
def entity_audit(s, d):
    """A whole audit of the personal data in the documents: look-alikes, losses under the documents' own grams, evidence
    cross-fitted over two methods, correction, risk; findings by type and severity."""
    found = stored(audit.targets(_records(s, d), context=3), "audit-found")  # read several times, detected once
    asked = stored(references.references(found, 5, "synthetic"), "audit-targets")
    losses = audit.gram_losses(references.variants(asked), audit.gram_counts(t(s, d, "documents")))
    scores = stored(audit.evidence(losses, asked), "audit-scores")
    judged = stored(audit.gather(scores, ["loss", "reference"]), "audit-judged")
    found = audit.entity_risk(audit.benjamini_hochberg(judged))
    return found.groupBy("entity_type", "severity").agg(F.count("*").alias("n"))


_KINDS = {"CREDITCARDNUMBER": "card", "IBAN": "iban", "VEHICLEVIN": "vin", "SSN": "ssn", "MAC": "mac"}
_BYTES = ", ".join(f"(SELECT list_transform(range(64), lambda i: ('0x' || substr(sha256('0\x01{k}\x01' || c_name || '\x01' || (i // 32)), (2 * (i % 32) + 1)::INT, 2))::INT)) AS {n}" for k, n in _KINDS.items())
_SQL_VIN = "".join(f"WHEN '{c}' THEN {v} " for c, v in grammars.VIN_VALUES.items())


@query("value_grammars", f"""
WITH b AS (SELECT c_custkey, {_BYTES} FROM customer),
 d AS (SELECT c_custkey, '4' || array_to_string([x % 10 FOR x IN card[1:14]], '') AS c, array_to_string([x % 10 FOR x IN iban[1:18]], '') AS a,
  [substr('{grammars.VIN_LETTERS}', x % 33 + 1, 1) FOR x IN vin[1:17]] AS v,
  [ssn[i] * 65536 + ssn[i + 1] * 256 + ssn[i + 2] FOR i IN [1, 4, 7]] AS s, array_to_string([substr('0123456789abcdef', x % 16 + 1, 1) FOR x IN mac[1:12]], '') AS m FROM b)
SELECT c_custkey, c || ((10 - (SELECT sum(CASE WHEN i % 2 = 1 THEN (2 * y) // 10 + (2 * y) % 10 ELSE y END) FROM (SELECT i, substr(reverse(c), i::INT, 1)::INT y FROM range(1, 16) r(i))) % 10) % 10)::INT AS card,
 'DE' || lpad((98 - ((a || '131400')::HUGEINT % 97))::INT::VARCHAR, 2, '0') || a AS iban,
 array_to_string(v[1:8], '') || (SELECT CASE WHEN sum(w * x) % 11 = 10 THEN 'X' ELSE (sum(w * x) % 11)::INT::VARCHAR END FROM (SELECT {grammars.VIN_WEIGHTS}[i] w, CASE v[i] {_SQL_VIN} ELSE v[i]::INT END x FROM range(1, 18) r(i))) || array_to_string(v[10:17], '') AS vin,
 lpad((1 + s[1] % 898 + CASE WHEN 1 + s[1] % 898 >= 666 THEN 1 ELSE 0 END)::VARCHAR, 3, '0') || '-' || lpad((1 + s[2] % 99)::VARCHAR, 2, '0') || '-' || lpad((1 + s[3] % 9999)::VARCHAR, 4, '0') AS ssn,
 array_to_string([substr(m, i, 2) FOR i IN [1, 3, 5, 7, 9, 11]], ':') AS mac, true AS valid FROM d""")
def value_grammars(s, d):
    """Stand-ins of five types for each customer's name, and whether each passes its check."""
    made = spread(t(s, d, "customer").select("c_custkey", "c_name")).select("c_custkey", *[grammars.made(k, grammars.key_of(F.lit(k), F.col("c_name"))).alias(n) for k, n in _KINDS.items()])
    good = F.lit(True)
    for k, n in _KINDS.items():
        good = good & grammars.valid(k, F.col(n))
    return made.withColumn("valid", good)


@query("references")
def reference_values(s, d):
    """How many look-alikes, of the corpus and made, each personal value of the documents has."""
    found = stored(audit.targets(_records(s, d)).select("id", "pos", "entity_type", "value"), "references-found")  # read several times, detected once
    return references.references(found, 5).select("id", "pos", F.size("references").alias("n"))


@query("remediation_rounds")
def remediation_rounds(s, d):
    """Rounds over the personal data of the documents, from the first audit to the gate."""
    folder = shared_folder(s, "rounds")
    raw = _records(s, d)
    raw.write.parquet(f"{folder}/raw")
    raw = s.read.parquet(f"{folder}/raw")
    rounds = remediation.remediate(raw, remediation.gram_audit(raw, folder), folder)
    return rounds.withColumn("auc", F.round("auc", 6))
