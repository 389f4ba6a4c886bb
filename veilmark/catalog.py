"""Registered queries of the analytics operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import patterns as P
from .operators import anonymize, audit, drift, guard, leakage, metadata, ml, pii_scan, policy, profile, provenance, reid, text
from .plans import gate, preprocess
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: str, n: int = 6):
    return F.round(F.col(c), n).alias(c)


GATE = {"pii_columns_max": 0, "min_k_anonymity": {"warn": 10, "fail": 2}, "unique_record_fraction_max": {"warn": 0.0, "fail": 0.05}, "min_l_diversity": 2}


@query("privacy_gate", """
WITH s AS (SELECT count(*) n, count(DISTINCT c_acctbal) l FROM customer GROUP BY c_nationkey, c_mktsegment),
 e AS (SELECT min(n) k, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n) u, min(l) l FROM s)
SELECT 'pii_columns_max' AS rule, 1.0::DOUBLE AS observed, 'fail' AS result FROM e
UNION ALL SELECT 'min_k_anonymity', k::DOUBLE, CASE WHEN k < 2 THEN 'fail' WHEN k < 10 THEN 'warn' ELSE 'pass' END FROM e
UNION ALL SELECT 'unique_record_fraction_max', round(u, 6), CASE WHEN u > 0.05 THEN 'fail' WHEN u > 0 THEN 'warn' ELSE 'pass' END FROM e
UNION ALL SELECT 'min_l_diversity', l::DOUBLE, CASE WHEN l < 2 THEN 'fail' ELSE 'pass' END FROM e""")
def privacy_gate(s, d):
    return gate.privacy_gate(t(s, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal", GATE).select("rule", _r("observed"), "result")


@query("k_anonymity", "SELECT min(n)::BIGINT AS k_anonymity FROM (SELECT count(*) n FROM part GROUP BY p_brand, p_size)")
def k_anonymity(s, d):
    return reid.k_anonymity(t(s, d, "part"), ["p_brand", "p_size"])


@query("unique_fraction", "SELECT round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n), 6) AS unique_fraction FROM (SELECT count(*) n FROM part GROUP BY p_brand, p_type, p_size)")
def unique_fraction(s, d):
    return reid.unique_fraction(t(s, d, "part"), ["p_brand", "p_type", "p_size"]).select(_r("unique_fraction"))


@query("l_diversity", "SELECT min(l)::BIGINT AS l_diversity FROM (SELECT count(DISTINCT c_mktsegment) + max(CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END) l FROM customer GROUP BY c_nationkey)")
def l_diversity(s, d):
    return reid.l_diversity(t(s, d, "customer"), ["c_nationkey"], "c_mktsegment")


@query("at_risk", "SELECT coalesce(sum(CASE WHEN n < 5 THEN n END), 0)::BIGINT AS at_risk FROM (SELECT count(*) n FROM lineitem GROUP BY l_quantity, l_discount, l_returnflag)")
def at_risk(s, d):
    return reid.at_risk(t(s, d, "lineitem"), ["l_quantity", "l_discount", "l_returnflag"], 5)


@query("combination_uniqueness", """
WITH g AS (SELECT c_nationkey, c_mktsegment, round(c_acctbal / 1000)::BIGINT AS band, grouping_id(c_nationkey, c_mktsegment, round(c_acctbal / 1000)::BIGINT) g, count(*) n FROM customer
 GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), (round(c_acctbal / 1000)::BIGINT), (c_nationkey, c_mktsegment), (c_nationkey, round(c_acctbal / 1000)::BIGINT), (c_mktsegment, round(c_acctbal / 1000)::BIGINT), (c_nationkey, c_mktsegment, round(c_acctbal / 1000)::BIGINT)))
SELECT CASE g WHEN 3 THEN 'c_nationkey' WHEN 5 THEN 'c_mktsegment' WHEN 6 THEN 'band' WHEN 1 THEN 'c_nationkey,c_mktsegment' WHEN 2 THEN 'c_nationkey,band' WHEN 4 THEN 'c_mktsegment,band' ELSE 'c_nationkey,c_mktsegment,band' END AS columns,
 (CASE WHEN g = 0 THEN 3 WHEN g IN (1, 2, 4) THEN 2 ELSE 1 END)::INTEGER AS size, round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n), 6) AS unique_fraction FROM g GROUP BY g""")
def combination_uniqueness(s, d):
    df = t(s, d, "customer").select("c_nationkey", "c_mktsegment", F.round(F.col("c_acctbal") / 1000).cast("long").alias("band"))
    return reid.combination_uniqueness(df, df.columns).select("columns", "size", _r("unique_fraction"))


@query("risky_combinations", """
WITH b AS (SELECT c_nationkey, c_mktsegment, round(c_acctbal, -2) + 0 AS band FROM customer),
 s AS (SELECT grouping_id(c_nationkey, c_mktsegment, band) g, count(*) n FROM b
  GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), (band), (c_nationkey, c_mktsegment), (c_nationkey, band), (c_mktsegment, band), (c_nationkey, c_mktsegment, band))),
 u AS (SELECT g, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n) f FROM s GROUP BY g HAVING f > 0.01)
SELECT CASE g WHEN 3 THEN 'c_nationkey' WHEN 5 THEN 'c_mktsegment' WHEN 6 THEN 'band' WHEN 1 THEN 'c_nationkey,c_mktsegment' WHEN 2 THEN 'c_nationkey,band' WHEN 4 THEN 'c_mktsegment,band' ELSE 'c_nationkey,c_mktsegment,band' END AS columns,
 (3 - bit_count(g))::INTEGER AS size, f AS unique_fraction FROM u WHERE NOT EXISTS (SELECT 1 FROM u i WHERE i.g <> u.g AND (i.g & u.g) = u.g)""")
def risky_combinations(s, d):
    return reid.risky_combinations(t(s, d, "customer").select("c_nationkey", "c_mktsegment", F.round("c_acctbal", -2).alias("band")), ["c_nationkey", "c_mktsegment", "band"])


@query("reid_assessment", "SELECT 'c_nationkey,c_mktsegment' AS quasi_identifiers, min(n)::BIGINT AS k_anonymity, round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n), 6) AS unique_fraction, min(l)::BIGINT AS l_diversity FROM (SELECT count(*) n, count(DISTINCT round(c_acctbal)) l FROM customer GROUP BY c_nationkey, c_mktsegment)")
def reid_assessment(s, d):
    df = t(s, d, "customer").withColumn("band", F.round("c_acctbal"))
    return reid.assess(df, ["c_nationkey", "c_mktsegment"], "band").select("quasi_identifiers", "k_anonymity", _r("unique_fraction"), "l_diversity")


@query("suppress_small_groups", "SELECT o_orderkey FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) n FROM orders) WHERE n >= 3")
def suppress_small_groups(s, d):
    return reid.suppress_small_groups(t(s, d, "orders"), ["o_custkey", "o_orderpriority"], 3).select("o_orderkey")


@query("range_label", """SELECT label, count(*)::BIGINT AS n FROM (SELECT CASE WHEN floor(p_size / 10.0 + 1e-9) * 10 <= 10 THEN '<20' WHEN floor(p_size / 10.0 + 1e-9) * 10 >= 40 THEN '40+'
 ELSE (floor(p_size / 10.0 + 1e-9) * 10)::BIGINT || '-' || ((floor(p_size / 10.0 + 1e-9) * 10)::BIGINT + 9) END AS label FROM part) GROUP BY label""")
def range_label(s, d):
    rule = {"kind": "range", "width": 10, "low": 10, "high": 40, "integer": True}
    return t(s, d, "part").groupBy(anonymize.range_label(F.col("p_size"), rule).alias("label")).agg(F.count("*").alias("n"))


@query("prefix_label", "SELECT p_partkey, left(p_brand, 6) || repeat('*', greatest(length(p_brand) - 6, 0)::INTEGER) AS label FROM part")
def prefix_label(s, d):
    return t(s, d, "part").select("p_partkey", anonymize.prefix_label(F.col("p_brand"), 6).alias("label"))


@query("pool_label", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'other' END AS label FROM customer")
def pool_label(s, d):
    return t(s, d, "customer").select("c_custkey", anonymize.pool_label(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("label"))


@query("fit_generalization")
def fit_generalization(s, d):
    df = t(s, d, "customer").select(F.round("c_acctbal").alias("balance"), "c_nationkey", "c_mktsegment")
    rules = anonymize.fit_generalization(df, ["balance", "c_nationkey"], 1000, 5, label="c_mktsegment")
    return reid.at_risk(anonymize.apply_generalization(df, rules), ["balance", "c_nationkey"], 5)


@query("generalization_trials", """
WITH o AS (SELECT strftime(o_orderdate, '%Y%m%d') AS day, o_orderpriority AS pri, o_orderstatus AS y FROM orders),
 r AS (SELECT pri, row_number() OVER (ORDER BY count(*) DESC, pri) AS r FROM o GROUP BY 1),
 e AS (SELECT 'day' AS c, i, CASE WHEN i < 6 THEN 'prefix' ELSE 'suppress' END AS kind, CASE WHEN i < 6 THEN left(day, (6 - i)::INT) ELSE '*' END AS x, pri AS rest, y FROM o, range(0, 7) t(i)
  UNION ALL SELECT 'pri', i, CASE i WHEN 0 THEN 'none' WHEN 4 THEN 'suppress' ELSE 'pool' END, CASE WHEN i = 4 THEN '*' WHEN r.r <= 5 - i THEN pri ELSE 'other' END, left(day, 6), y FROM o JOIN r USING (pri), range(0, 5) t(i)),
 k AS (SELECT c, i, kind, sum(CASE WHEN n < 25 THEN n ELSE 0 END)::BIGINT AS at_risk FROM (SELECT c, i, kind, x, rest, count(*) n FROM e GROUP BY ALL) GROUP BY ALL),
 j AS (SELECT c, i, x, y, count(*) n FROM e GROUP BY ALL),
 m AS (SELECT *, sum(n) OVER (PARTITION BY c, i, x) nx, sum(n) OVER (PARTITION BY c, i, y) ny, sum(n) OVER (PARTITION BY c, i) t FROM j)
SELECT c AS "column", kind, i::INTEGER AS number, at_risk, round(sum(n / t * ln(n * t / (nx * ny))), 6) + 0.0 AS information FROM k JOIN m USING (c, i) GROUP BY ALL""")
def generalization_trials(s, d):
    """What each coarser rule for an order's day or priority would leave at risk and still tell about its status."""
    df = t(s, d, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("day"), F.col("o_orderpriority").alias("pri"), "o_orderstatus")
    return anonymize.first_trials(df, ["day", "pri"], 10, 25, "o_orderstatus").withColumn("information", F.round("information", 6) + 0.0)


@query("mutual_information", """WITH j AS (SELECT l_returnflag x, l_linestatus y, count(*) n FROM lineitem GROUP BY 1, 2), a AS (SELECT x, sum(n) nx FROM j GROUP BY x), b AS (SELECT y, sum(n) ny FROM j GROUP BY y), c AS (SELECT sum(n) t FROM j)
SELECT round(sum(n / t * ln(n * t / (nx * ny))), 6) AS information FROM j JOIN a USING (x) JOIN b USING (y), c""")
def mutual_information(s, d):
    return anonymize.information(t(s, d, "lineitem"), "l_returnflag", "l_linestatus").select(_r("information"))


def _halves(s, d):
    e = t(s, d, "events")
    return e.where("ts < timestamp'2024-01-16'"), e.where("ts >= timestamp'2024-01-16'")


def _flags(s, d):
    li = t(s, d, "lineitem")
    return li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'")


@query("psi_numeric", """WITH q AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) e FROM lineitem WHERE l_returnflag = 'A'),
 i AS (SELECT e[2:len(e) - 1] inner_edges FROM q),
 v AS (SELECT l_returnflag = 'A' r, len(list_filter(inner_edges, lambda x: x <= l_extendedprice)) bin FROM lineitem, i WHERE l_returnflag IN ('A', 'R')),
 c AS (SELECT bin, sum(CASE WHEN r THEN 1 ELSE 0 END) r, sum(CASE WHEN r THEN 0 ELSE 1 END) b FROM v GROUP BY bin), s AS (SELECT sum(r) n, sum(b) m FROM c)
SELECT round(sum((greatest(b / m, 1e-6) - greatest(r / n, 1e-6)) * ln(greatest(b / m, 1e-6) / greatest(r / n, 1e-6))), 6) AS psi FROM c, s""")
def psi_numeric(s, d):
    return drift.psi_numeric(*_flags(s, d), "l_extendedprice").select(_r("psi"))


@query("psi_categorical", """WITH c AS (SELECT event_type, sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END) r, sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END) b FROM events GROUP BY 1), s AS (SELECT sum(r) n, sum(b) m FROM c)
SELECT round(sum((greatest(b / m, 1e-6) - greatest(r / n, 1e-6)) * ln(greatest(b / m, 1e-6) / greatest(r / n, 1e-6))), 6) AS psi FROM c, s""")
def psi_categorical(s, d):
    return drift.psi_categorical(*_halves(s, d), "event_type").select(_r("psi"))


@query("two_sample_statistics", """WITH v AS (SELECT l_quantity x, l_returnflag = 'A' r FROM lineitem WHERE l_returnflag IN ('A', 'R')), c AS (SELECT x, sum(CASE WHEN r THEN 1 ELSE 0 END)::DOUBLE r, sum(CASE WHEN r THEN 0 ELSE 1 END)::DOUBLE b FROM v GROUP BY x),
 k AS (SELECT *, sum(r) OVER (ORDER BY x) cr, sum(b) OVER (ORDER BY x) cb, sum(r) OVER () n, sum(b) OVER () m FROM c), z AS (SELECT *, cr + cb - (r + b - 1) / 2 AS rank FROM k)
SELECT max(n)::BIGINT AS n, max(m)::BIGINT AS m, round(max(abs(cr / n - cb / m)), 6) AS ks, round(sum(r * rank) - max(n) * (max(n) + 1) / 2, 3) AS u FROM z""")
def two_sample_statistics(s, d):
    return drift.two_sample(*_flags(s, d), "l_quantity").select("n", "m", _r("ks"), _r("u", 3))


@query("chi_square", """WITH c AS (SELECT event_type, sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END)::DOUBLE r, sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END)::DOUBLE b FROM events GROUP BY 1), s AS (SELECT sum(r) n, sum(b) m FROM c)
SELECT round(sum((r - (r + b) * n / (n + m)) ** 2 / ((r + b) * n / (n + m)) + (b - (r + b) * m / (n + m)) ** 2 / ((r + b) * m / (n + m))), 6) AS chi2, count(*) - 1 AS dof FROM c, s""")
def chi_square(s, d):
    return drift.chi_square(*_halves(s, d), "event_type").select(_r("chi2"), F.col("dof").cast("long").alias("dof"))


@query("drift_report")
def drift_report(s, d):
    return drift.check_drift(*_halves(s, d), exclude=("event_id", "props"))


@query("schema_check", "SELECT 'o_orderstatus' AS \"column\", 'missing' AS problem, CAST(NULL AS DOUBLE) AS detail UNION ALL SELECT 'extra', 'unexpected', NULL")
def schema_check(s, d):
    o = t(s, d, "orders")
    return drift.check_schema(o.drop("o_comment"), o.drop("o_orderstatus").withColumn("extra", F.lit(1)))


@query("monitor")
def monitor(s, d):
    return gate.monitor(*_halves(s, d), exclude=("event_id", "props", "ts"))


@query("unseen_categories", "SELECT DISTINCT p_brand FROM part WHERE p_size > 25 EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_size <= 3")
def unseen_categories(s, d):
    p = t(s, d, "part")
    return drift.unseen_categories(p.where("p_size <= 3"), p.where("p_size > 25"), "p_brand")


@query("column_roles")
def column_roles(s, d):
    return profile.column_roles(t(s, d, "events"))


@query("infer_task", "SELECT 'binary' AS task, count(DISTINCT toxic)::BIGINT AS n_classes FROM labels")
def infer_task(s, d):
    return profile.infer_task(t(s, d, "labels"), "toxic")


@query("clean_rows", "WITH k AS (SELECT DISTINCT l.lang, l.source, q.quality FROM documents l LEFT JOIN labels q USING (doc_id) WHERE q.quality IS NOT NULL) SELECT lang, source, quality FROM k WHERE quality IN (SELECT quality FROM k GROUP BY quality HAVING count(*) >= 3)")
def clean_rows(s, d):
    df = t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left").select("lang", "source", "quality")
    return profile.clean_rows(df, "quality")


@query("apply_plan", "SELECT year(o_orderdate)::INTEGER AS o_orderdate_year, month(o_orderdate)::INTEGER AS o_orderdate_month, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def apply_plan(s, d):
    f = profile.apply_plan(t(s, d, "orders"), profile.FeaturePlan({"o_orderdate": "datetime", "o_totalprice": "numeric", "absent": "categorical"}))
    return f.groupBy("o_orderdate_year", "o_orderdate_month").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("pii_email", r"SELECT 'EMAIL' AS entity, count(*) FILTER (len(h) > 0)::BIGINT AS rows_hit, sum(len(h))::BIGINT AS values_hit FROM (SELECT regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}') h FROM documents)")
def pii_email(s, d):
    return pii_scan.value_hits(t(s, d, "documents"), "text", ["EMAIL"])


@query("pii_values")
def pii_values(s, d):
    return pii_scan.value_hits(t(s, d, "pages"), "html")


@query("pii_scan")
def pii_findings(s, d):
    return pii_scan.scan(t(s, d, "documents").select("doc_id", "text", "lang"), "documents", None)


@query("mask_email", r"""SELECT doc_id, left(e, 1) || '***@' || left(split_part(e, '@', 2), 1) || '***.' || regexp_extract(e, '([^.]*)$', 1) AS masked
FROM (SELECT doc_id, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}') e FROM documents) WHERE e <> ''""")
def mask_email(s, d):
    first = F.get(P.found_emails(F.col("text")), F.lit(0))
    return t(s, d, "documents").select("doc_id", first.alias("e")).where("e is not null").select("doc_id", P.masked(F.col("e"), "EMAIL").alias("masked"))


@query("detect_spans")
def detect_spans(s, d):
    return text.detect_records(t(s, d, "documents").select("doc_id", "text")).select("doc_id", F.inline("entities"))


def _records(s, d):
    return text.detect_records(t(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"))


@query("sanitize_mask")
def sanitize_mask(s, d):
    return text.sanitize(_records(s, d), "mask").select("id", F.sha2("text", 256).alias("sha256"))


@query("sanitize_surrogate")
def sanitize_surrogate(s, d):
    return text.sanitize(_records(s, d)).select("id", F.sha2("text", 256).alias("sha256"), F.size("entities").alias("n"))


@query("sanitize_drop")
def sanitize_drop(s, d):
    return text.sanitize(_records(s, d), "drop").select("id")


@query("guard_conversations")
def guard_conversations(s, d):
    return guard.guard_conversations(t(s, d, "conversations")).groupBy("outcome").agg(F.count("*").alias("turns"), F.sum("n_masked").alias("masked"))


@query("audit_targets")
def audit_targets(s, d):
    return audit.targets(_records(s, d)).select("id", "pos", "entity_type", "start", "end", F.length("value").alias("n"))


@query("holdout_split", "SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 10000 < 1000 AS holdout FROM documents")
def holdout_split(s, d):
    return text.split_holdout(t(s, d, "documents"), "doc_id").select("doc_id", "holdout")


@query("repeat_split", """WITH b AS (SELECT doc_id, ('0x' || substr(sha256('split:' || doc_id), 1, 8))::BIGINT % 5 p, ('0x' || substr(sha256('split-repeat:' || doc_id), 1, 8))::BIGINT % 4 r FROM documents)
SELECT doc_id, CASE WHEN p < 3 THEN 'train' WHEN p = 3 THEN 'holdout' ELSE 'unseen' END AS split, (CASE WHEN p < 3 THEN 1 << r ELSE 1 END)::BIGINT AS repeats FROM b""")
def repeat_split(s, d):
    return text.repeat_split(t(s, d, "documents"), "doc_id").select("doc_id", "split", "repeats")


def _scores(s, d):
    e = t(s, d, "events").where("event_type in ('purchase', 'view')")
    return e.select(F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("member"))


_CURVE = """WITH c AS (SELECT value s, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::DOUBLE p, sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END)::DOUBLE n FROM events WHERE event_type IN ('purchase', 'view') AND value IS NOT NULL GROUP BY 1)"""


@query("auc", _CURVE + ", r AS (SELECT *, sum(n) OVER (ORDER BY s) cn FROM c) SELECT round(sum(p * (cn - n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM r")
def auc(s, d):
    return leakage.auc(_scores(s, d)).select(_r("auc"))


@query("tpr_at_fpr", _CURVE + """, r AS (SELECT sum(p) OVER (ORDER BY s DESC) / sum(p) OVER () tpr, sum(n) OVER (ORDER BY s DESC) / sum(n) OVER () fpr FROM c)
SELECT level, round(coalesce(max(CASE WHEN fpr <= level THEN tpr END), 0), 6) AS tpr FROM r, (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.05::DOUBLE)) v(level) GROUP BY level""")
def tpr_at_fpr(s, d):
    return leakage.tpr_at_fpr(_scores(s, d)).select("level", _r("tpr"))


_CURVE_OF_TAX = "WITH c AS (SELECT -l_tax s, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) p, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1)"


@query("loss_threshold_attack", _CURVE_OF_TAX + """, a AS (SELECT *, sum(n) OVER (ORDER BY s) cn, sum(p) OVER (ORDER BY s DESC) / sum(p) OVER () tpr, sum(n) OVER (ORDER BY s DESC) / sum(n) OVER () fpr FROM c)
SELECT round(sum(p * (cn - n / 2)) / (sum(p) * sum(n)), 6) AS mia_auc, round(coalesce(max(CASE WHEN fpr <= 0.01 THEN tpr END), 0), 6) AS tpr_at_low_fpr,
 round(-sum(s * p) / sum(p), 6) AS member_loss, round(-sum(s * n) / sum(n), 6) AS other_loss FROM a""")
def loss_threshold_attack(s, d):
    a, b = _flags(s, d)
    loss = F.col("l_tax").alias("loss")
    return leakage.loss_threshold_attack(a.select(loss), b.select(loss)).select(*[_r(c) for c in ("mia_auc", "tpr_at_low_fpr", "member_loss", "other_loss")])


@query("binary_metrics", """WITH b AS (SELECT quality y, (n_chars > 1000)::INTEGER p, least(n_chars / 5000.0, 1)::DOUBLE q FROM documents JOIN labels USING (doc_id)), k AS (SELECT sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) tp, sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) fp, sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) fn, avg((y = p)::INTEGER) a, avg((q - y) ** 2) br, avg(p) pr FROM b)
SELECT round(a, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(br, 6) AS brier, round(pr, 6) AS positive_rate FROM k""")
def binary_metrics(s, d):
    df = t(s, d, "documents").join(t(s, d, "labels"), "doc_id").withColumn("p", (F.col("n_chars") > 1000).cast("int")).withColumn("q", F.least(F.col("n_chars") / 5000, F.lit(1.0)))
    m = leakage.binary_metrics(df, "quality", "p", "q")
    return m.select(*[_r(c) for c in m.columns])


@query("confusion", "SELECT quality AS label, toxic AS predicted, count(*)::BIGINT AS n FROM labels GROUP BY 1, 2")
def confusion(s, d):
    return leakage.confusion(t(s, d, "labels"), "quality", "toxic")


@query("regression_metrics", "WITH e AS (SELECT l_extendedprice y, l_extendedprice - l_quantity * 1500 e FROM lineitem) SELECT round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, round(stddev_pop(y), 4) AS baseline_rmse FROM e")
def regression_metrics(s, d):
    df = t(s, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return leakage.regression_metrics(df, "l_extendedprice", "p").select(_r("rmse", 4), _r("mae", 4), _r("r2"), _r("baseline_rmse", 4))


@query("generalization_gap", "SELECT round(avg(CASE WHEN doc_id % 2 = 0 THEN (quality = toxic)::INTEGER END) - avg(CASE WHEN doc_id % 2 = 1 THEN (quality = toxic)::INTEGER END), 6) AS generalization_gap FROM labels")
def generalization_gap(s, d):
    df = t(s, d, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("predicted"))
    return leakage.generalization_gap(df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1"), "accuracy").select(_r("generalization_gap"))


def _logs(s, d):
    return t(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("lp"))


@query("min_k", "SELECT vec_id, round(list_avg(list_sort(list_transform(embedding, lambda x: -abs(x::DOUBLE)))[1:greatest(1, round_even(len(embedding) * 0.2, 0)::INTEGER)]), 6) AS min_k FROM embeddings")
def min_k(s, d):
    return _logs(s, d).select("vec_id", F.round(audit.min_k(F.col("lp")), 6).alias("min_k"))


@query("log_mean_exp", "SELECT vec_id, round(ln(list_avg(list_transform(embedding, lambda x: exp(-abs(x::DOUBLE))))), 6) AS lme, round(list_avg(list_transform(embedding, lambda x: -abs(x::DOUBLE))), 6) AS loss FROM embeddings")
def log_mean_exp(s, d):
    return _logs(s, d).select("vec_id", F.round(audit.log_mean_exp(F.col("lp")), 6).alias("lme"), F.round(audit.mean_loss(F.col("lp")), 6).alias("loss"))


@query("reference_set", "SELECT vec_id, round(list_sum(list_transform(embedding[1:4], lambda x: -abs(x::DOUBLE))) - ln(list_avg(list_transform(embedding[5:8], lambda x: exp(-abs(x::DOUBLE))))), 6) AS llr FROM embeddings")
def reference_set(s, d):
    return _logs(s, d).select("vec_id", F.round(audit.reference_set(F.slice("lp", 1, 4), F.slice("lp", 5, 4)), 6).alias("llr"))


@query("robust_z", """WITH c AS (SELECT event_type, median(value) m, stddev_pop(value) sd FROM events GROUP BY 1), k AS (SELECT e.event_type, m, sd, 1.4826 * median(abs(value - m)) mad FROM events e JOIN c USING (event_type) GROUP BY ALL)
SELECT event_id, round((value - m) / CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1 END, 6) AS z FROM events JOIN k USING (event_type)""")
def robust_z(s, d):
    e = t(s, d, "events").select("event_id", F.col("event_type").alias("entity_type"), "value", F.col("value").alias("control"))
    return audit.standardize(e, "value", "control").select("event_id", _r("z"))


def _p_values(s, d):
    return t(s, d, "embeddings").select(F.col("vec_id").alias("entity"), F.when(F.col("label") % 2 == 0, "EMAIL").otherwise("SSN").alias("entity_type"), F.exp(-10 * F.abs(F.col("embedding")[0].cast("double"))).alias("p"))


_BH = """WITH b AS (SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'EMAIL' ELSE 'SSN' END kind, exp(-10 * abs(embedding[1]::DOUBLE)) p FROM embeddings), r AS (SELECT *, count(*) OVER (ORDER BY p) rk, count(*) OVER () n FROM b),
 q AS (SELECT *, least(1, min(p * n / rk) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) q FROM r)"""


@query("benjamini_hochberg", _BH + " SELECT vec_id AS entity, round(p, 6) AS p, round(q, 6) AS q FROM q")
def benjamini_hochberg(s, d):
    return audit.benjamini_hochberg(_p_values(s, d)).select("entity", _r("p"), _r("q"))


@query("severity_counts", _BH + """, k AS (SELECT CASE WHEN q > 0.05 THEN least(10 * (1 - p) * w, 3.9) ELSE 10 * (1 - p) * w END risk FROM (SELECT *, CASE kind WHEN 'EMAIL' THEN 0.8 ELSE 1.0 END w FROM q)),
 s AS (SELECT CASE WHEN round(risk, 2) >= 9 THEN 'critical' WHEN round(risk, 2) >= 7 THEN 'high' WHEN round(risk, 2) >= 4 THEN 'medium' WHEN round(risk, 2) >= 0.1 THEN 'low' ELSE 'info' END severity FROM k)
SELECT v.severity, count(s.severity)::BIGINT AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) v(severity) LEFT JOIN s USING (severity) GROUP BY 1""")
def severity_counts(s, d):
    return audit.severity_counts(audit.entity_risk(audit.benjamini_hochberg(_p_values(s, d))))


@query("top_findings", _BH + """, w AS (SELECT *, 10 * (1 - p) * CASE kind WHEN 'EMAIL' THEN 0.8 ELSE 1.0 END x FROM q),
 k AS (SELECT vec_id, q, round(CASE WHEN q > 0.05 THEN least(x, 3.9) ELSE x END, 2) risk FROM w)
SELECT vec_id AS entity, risk, CASE WHEN risk >= 9 THEN 'critical' WHEN risk >= 7 THEN 'high' WHEN risk >= 4 THEN 'medium' WHEN risk >= 0.1 THEN 'low' ELSE 'info' END AS severity FROM k ORDER BY risk DESC, q, vec_id LIMIT 20""")
def top_findings(s, d):
    return audit.top_findings(audit.entity_risk(audit.benjamini_hochberg(_p_values(s, d))), 20).select("entity", _r("risk"), "severity")


@query("type_strength", """WITH b AS (SELECT label, embedding[1]::DOUBLE m, embedding[2]::DOUBLE c FROM embeddings)
SELECT CAST(label AS VARCHAR) AS entity_type, round((SELECT avg(CASE WHEN x.m > y.c THEN 1.0 WHEN x.m = y.c THEN 0.5 ELSE 0 END) FROM b x, b y WHERE x.label = o.label AND y.label = o.label), 6) AS auc FROM b o GROUP BY label HAVING count(*) >= 10""")
def type_strength(s, d):
    e = t(s, d, "embeddings").select(F.col("label").cast("string").alias("entity_type"), F.col("embedding")[0].cast("double").alias("member"), F.col("embedding")[1].cast("double").alias("control"))
    return audit.type_strength(e).select("entity_type", _r("auc"))


_CHAIN = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, concat_ws('|', event_id, event_type) AS body FROM events),
 c AS (SELECT chain, seq, body, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || ':' || body) AS hash FROM e WHERE seq = 1
  UNION ALL SELECT e.chain, e.seq, e.body, c.hash, sha256(c.hash || ':' || e.body) FROM c JOIN e ON e.chain = c.chain AND e.seq = c.seq + 1)"""


@query("hash_chain", _CHAIN + " SELECT * FROM c")
def hash_chain(s, d):
    e = t(s, d, "events")
    return provenance.chain(e, "user_id", "event_id", F.concat_ws("|", "event_id", "event_type"))


@query("verify_chain", "SELECT user_id::VARCHAR AS chain, count(*)::BIGINT AS events, 0::BIGINT AS problems FROM events GROUP BY 1")
def verify_chain(s, d):
    return provenance.chain_status(hash_chain(s, d))


@query("verify_tampered_chain", """WITH e AS (SELECT user_id::VARCHAR AS chain, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
 kept AS (SELECT *, lag(seq, 1, 0) OVER (PARTITION BY chain ORDER BY seq) before FROM e WHERE event_id % 89 <> 0)
SELECT chain, seq, 'content' AS problem FROM kept WHERE event_id % 97 = 0
UNION ALL SELECT chain, seq, 'sequence ' || (before + 1) || ' missing' FROM kept WHERE seq <> before + 1
UNION ALL SELECT chain, seq, 'link' FROM kept WHERE seq <> before + 1""")
def verify_tampered_chain(s, d):
    """The chain's problems once some events are changed and others removed."""
    number = F.split("body", r"\|")[0].cast("long")
    log = hash_chain(s, d).where(number % 89 != 0)
    return provenance.verify_chain(log.withColumn("body", F.when(number % 97 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))))


@query("next_link", _CHAIN + " SELECT chain, max(seq) + 1 AS seq, arg_max(hash, seq) AS prev_hash FROM c GROUP BY chain")
def next_link(s, d):
    return provenance.next_link(hash_chain(s, d))


@query("merkle_root", r"""
WITH RECURSIVE m AS (SELECT list(sha256('\x00'::BLOB || unhex(h)) ORDER BY h) l FROM (SELECT sha256(p_name) h FROM part)
 UNION ALL SELECT [CASE WHEN i < len(l) THEN sha256('\x01'::BLOB || unhex(l[i]) || unhex(l[i + 1])) ELSE l[i] END FOR i IN range(1, len(l) + 1, 2)] FROM m WHERE len(l) > 1)
SELECT l[1] AS merkle_root FROM m WHERE len(l) = 1""")
def merkle_root(s, d):
    return provenance.merkle_levels(t(s, d, "part").select(F.sha2(F.col("p_name"), 256).alias("sha256")))


def _snapshots(s, d):
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("sha256"))
    return o.where("path % 10 <> 0"), o.where("path % 10 <> 1").withColumn("sha256", F.when(F.col("path") % 7 == 0, F.lit("X")).otherwise(F.col("sha256")))


@query("revision", """WITH a AS (SELECT o_orderkey k, o_orderstatus v FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END v FROM orders WHERE o_orderkey % 10 <> 1)
SELECT k AS path, 'added' AS change FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'removed' FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT a.k, 'changed' FROM a JOIN b USING (k) WHERE a.v <> b.v""")
def revision(s, d):
    return provenance.revision(*_snapshots(s, d))


@query("dataset_changes", """WITH a AS (SELECT o_orderkey k, o_orderstatus v FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END v FROM orders WHERE o_orderkey % 10 <> 1)
SELECT k AS path, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'unchanged' END AS status FROM a FULL JOIN b USING (k)""")
def dataset_changes(s, d):
    return provenance.dataset_changes(*_snapshots(s, d), key="path")


@query("artifact_status", """WITH a AS (SELECT o_orderkey k, o_orderstatus v FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END v FROM orders WHERE o_orderkey % 10 <> 1)
SELECT k AS path, CASE WHEN b.v IS NULL THEN 'missing' WHEN a.v = b.v THEN 'ok' ELSE 'modified' END AS status FROM a LEFT JOIN b USING (k)""")
def artifact_status(s, d):
    return provenance.artifact_status(*_snapshots(s, d))


@query("lineage", """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey child, 'r' || n_regionkey parent FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), w AS (SELECT 'c1' AS node, 0 AS depth UNION SELECT e.parent, w.depth + 1 FROM w JOIN e ON e.child = w.node) SELECT node, depth FROM w""")
def lineage(s, d):
    e = t(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return provenance.lineage(e.union(t(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"))), "c1")


_FAILURES = """WITH b AS (SELECT *, (event_type = 'purchase')::INTEGER ok FROM events WHERE event_type IN ('error', 'purchase')), g AS (SELECT *, sum(ok) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) seg FROM b),
 f AS (SELECT *, sum(1 - ok) OVER (PARTITION BY user_id, seg ORDER BY epoch_us(ts) RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW) failures FROM g)"""


@query("login_throttle", _FAILURES + " SELECT event_id, failures::BIGINT AS failures, failures >= 3 AS blocked FROM f")
def login_throttle(s, d):
    e = t(s, d, "events").where("event_type in ('error', 'purchase')")
    return provenance.login_throttle(e, "user_id", "ts", F.col("event_type") == "purchase", 3, 43_200).select("event_id", F.col("failures").cast("long").alias("failures"), "blocked")


@query("guard_stats", """WITH b AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type outcome, value x FROM events), r AS (SELECT day, outcome, list_sort(list(x) FILTER (x IS NOT NULL)) l, count(*) n FROM b GROUP BY 1, 2) SELECT day, outcome, n::BIGINT AS n, l[len(l) // 2 + 1] AS latency FROM r""")
def guard_stats(s, d):
    return metadata.guard_stats(t(s, d, "events"), F.to_date("ts").cast("string"), "event_type", "value", F.lit(False))


@query("dashboard", "SELECT o_orderstatus AS state, count(*)::BIGINT AS versions, sum(CASE WHEN o_orderstatus = 'findings' THEN 1 ELSE 0 END)::BIGINT AS findings FROM orders GROUP BY 1")
def dashboard(s, d):
    return metadata.dashboard(t(s, d, "orders").select(F.col("o_orderstatus").alias("state"), F.lit(1).alias("critical"), F.lit(0).alias("high")))


@query("models_summary", "SELECT event_type AS model, count(*)::BIGINT AS passports, max(ts) AS latest FROM events GROUP BY 1")
def models_summary(s, d):
    return metadata.models_summary(t(s, d, "events").select(F.col("event_type").alias("model"), F.col("ts").alias("created_at")))


@query("registry_search", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def registry_search(s, d):
    e = t(s, d, "events").withColumnRenamed("ts", "created_at")
    return metadata.search(e, 50, event_type="error").select("event_id")


@query("page", "SELECT event_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def page(s, d):
    return metadata.page(t(s, d, "events"), "event_id", 100, 50).select("event_id", "event_type")


@query("deployments", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def deployments(s, d):
    o = t(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("version_id"), F.col("o_orderdate").alias("created_at"))
    c = t(s, d, "customer").select(F.col("c_custkey").alias("version_id"), "c_name", F.col("c_nationkey").alias("model_id"))
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("model_id"), "n_name")
    return metadata.deployments(o, c, n).select("o_orderkey", "c_name", "n_name")


@query("newest_active", "SELECT o_custkey, max(o_orderdate) AS created_at FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def newest_active(s, d):
    o = t(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("x").alias("status"))
    return metadata.newest_active(o, ["o_custkey"]).select("o_custkey", "created_at")


@query("scoped", "SELECT count(*)::BIGINT AS n FROM documents WHERE source IN ('src1', '*')")
def scoped(s, d):
    return metadata.scoped(t(s, d, "documents").withColumnRenamed("source", "tenant_id"), "src1").agg(F.count("*").alias("n"))


@query("policy_worst", "SELECT 'fail' AS verdict")
def policy_worst(s, d):
    return policy.worst(privacy_gate(s, d))


@query("stratified_split")
def stratified_split(s, d):
    return ml.stratified_split(t(s, d, "documents").select("doc_id", "lang"), ["lang"], 0.2, "doc_id")


@query("table_types", "SELECT 'p_partkey' AS \"column\", 'bigint' AS kind UNION ALL SELECT 'p_retailprice', 'double' UNION ALL SELECT 'p_brand', 'string' UNION ALL SELECT 'code', 'string'")
def table_types(s, d):
    p = t(s, d, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), F.col("p_retailprice").cast("string").alias("p_retailprice"), "p_brand", F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("code"))
    return s.createDataFrame(profile.restore_types(p).dtypes, "column string, kind string")


@query("preprocess")
def preprocess_query(s, d):
    train, test, _ = preprocess.preprocess(t(s, d, "customer").select("c_nationkey", F.round("c_acctbal").alias("balance"), "c_mktsegment"), "c_mktsegment", 3, width=1000, requested=["c_nationkey", "balance"])
    return train.select(F.lit("train").alias("side")).union(test.select(F.lit("test"))).groupBy("side").agg(F.count("*").alias("rows"))


@query("set_operations", """SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'union all', count(*) FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)""")
def set_operations(s, d):
    a, b = t(s, d, "documents").select("doc_id"), t(s, d, "labels").select("doc_id")
    made = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "union all": a.union(b)}
    out = None
    for name, df in made.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.union(one)
    return out


@query("metric_deltas", "WITH m AS (SELECT event_type AS metric, round(avg(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN value END), 6) a, round(avg(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN value END), 6) b FROM events GROUP BY 1) SELECT 'all' AS split, metric, round(b - a, 5) AS delta FROM m")
def metric_deltas(s, d):
    mean = lambda e: e.groupBy(F.lit("all").alias("split"), F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    old, new = _halves(s, d)
    return provenance.metric_deltas(mean(old), mean(new)).select("split", "metric", _r("delta", 5))


@query("retry_after", _FAILURES + """, o AS (SELECT *, epoch_us(ts) // 1000000 AS second, lag(epoch_us(ts) // 1000000, 2) OVER (PARTITION BY user_id ORDER BY ts) oldest FROM f)
SELECT event_id, greatest(oldest + 43200 - second, 0)::BIGINT AS retry_after FROM o WHERE failures >= 3""")
def retry_after(s, d):
    e = t(s, d, "events").where("event_type in ('error', 'purchase')")
    return provenance.retry_after(e, "user_id", "ts", F.col("event_type") == "purchase", 3, 43_200).where("blocked").select("event_id", "retry_after")


@query("model_choice", """WITH f AS (SELECT CASE l_returnflag WHEN 'A' THEN 'linear' WHEN 'N' THEN 'boosting' ELSE 'forest' END AS family, l_linenumber AS setting, l_orderkey % 5 AS fold, -avg(l_tax) AS score, avg(l_discount) AS fit, avg(l_discount + (l_partkey % 9) / 100.0) AS train_fit FROM lineitem GROUP BY 1, 2, 3),
 t AS (SELECT family, setting, avg(score) AS score, stddev_pop(score) / sqrt(count(*)) AS error, avg(train_fit - fit) AS gap, CASE family WHEN 'linear' THEN 1 WHEN 'boosting' THEN 2 ELSE 3 END AS rank FROM f GROUP BY 1, 2),
 e AS (SELECT *, gap <= 0.04 OR (SELECT min(gap) FROM t) > 0.04 AND gap = (SELECT min(gap) FROM t) AS eligible FROM t),
 b AS (SELECT score - error AS bar FROM e WHERE eligible ORDER BY score DESC LIMIT 1),
 c AS (SELECT family, setting FROM e, b WHERE eligible AND score >= bar ORDER BY rank, score DESC, setting LIMIT 1)
SELECT e.family, e.setting, round(score, 6) AS score, round(error, 6) AS error, round(gap, 6) AS gap, eligible, c.setting IS NOT NULL AS chosen FROM e LEFT JOIN c ON c.family = e.family AND c.setting = e.setting""")
def model_choice(s, d):
    """The choice over cross-validation rows, with line items as folds of three families."""
    family = F.when(F.col("l_returnflag") == "A", "linear").when(F.col("l_returnflag") == "N", "boosting").otherwise("forest")
    folds = t(s, d, "lineitem").groupBy(family.alias("family"), F.col("l_linenumber").alias("setting"), (F.col("l_orderkey") % 5).alias("fold"))
    folds = folds.agg((-F.avg("l_tax")).alias("score"), F.avg("l_discount").alias("fit"), F.avg(F.col("l_discount") + F.col("l_partkey") % 9 / 100).alias("train_fit"))
    return ml.ranked(ml.cv_rows(folds), 0.04).select("family", "setting", _r("score"), _r("error"), _r("gap"), "eligible", "chosen")


from . import catalog_artifacts, catalog_audit, catalog_documents, catalog_guard  # noqa: E402, F401  these register their queries here


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
