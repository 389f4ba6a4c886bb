import pytest
from pyspark.sql import functions as F

from veilmark.functions import patterns as P
from veilmark.operators import guard, metadata, pii_scan, policy, provenance, text

SENTENCE = "Mail jo@ex.com, SSN 078-05-1120, card 4111 1111 1111 1111, call (202) 555-0143, from 10.0.0.1 on 2024-01-05."


def test_spans(spark):
    df = spark.createDataFrame([("a", SENTENCE), ("b", "😀 x@y.io"), ("c", None), ("d", "")], "id string, text string")
    got = {r.id: [(r2.entity_type, r2.start, r2.end) for r2 in r.entities] for r in text.detect_records(df).collect()}
    assert [k for k, *_ in got["a"]] == ["EMAIL", "SSN", "CREDITCARDNUMBER", "PHONENUMBER", "IPV4", "DATE"]
    assert got["b"] == [("EMAIL", 2, 8)] and got["c"] == got["d"] == []


def test_masks(spark):
    one = lambda v, k: spark.createDataFrame([(v,)], "x string").select(P.masked(F.col("x"), k)).first()[0]
    assert one("jane@gmail.com", "EMAIL") == "j***@g***.com"
    assert one("078-05-1120", "US_SSN") == "***-**-**20"
    assert one("Ann B", "PERSON_NAME") == "*** *"


def test_column_scan(spark):
    rows = [(f"p{i}", f"u{i}@mail.test", f"(202) 555-{i:04d}", f"{100 + i % 700:03d}-45-{1000 + i:04d}", f"10.0.{i % 250}.7", f"note {i}") for i in range(1, 201)]
    df = spark.createDataFrame(rows, "name string, contact string, phone string, ssn string, ip string, note string")
    got = {(r.location, r.category): r["count"] for r in pii_scan.scan(df, "d").collect()}
    assert got[("d:contact", "EMAIL")] == 200 and got[("d:phone", "PHONE")] == 200 and got[("d:ip", "IP_ADDRESS")] == 200
    assert ("d:name", "PERSON_NAME") in got and not any(loc == "d:note" for loc, _ in got)
    clean = spark.createDataFrame([("30-39", "021**", 40)] * 50, "age string, zip string, hours long")
    assert {r.category for r in pii_scan.scan(clean, "c").collect()} == {"ZIP_CODE"}


def test_sanitize(spark):
    df = text.detect_records(spark.createDataFrame([("1", "a@b.io and a@b.io"), ("2", "to a@b.io"), ("3", "plain")], "id string, text string"))
    got = {r.id: r for r in text.sanitize(df).collect()}
    first = got["1"].text.split(" and ")
    assert first[0] == first[1] == got["2"].text[3:] and "a@b.io" not in got["1"].text and got["3"].text == "plain"
    e = got["1"].entities[1]
    assert got["1"].text[e.start : e.end] == first[1]
    assert {r.text for r in text.sanitize(df, "mask").collect()} == {"[EMAIL] and [EMAIL]", "to [EMAIL]", "plain"}
    assert [r.id for r in text.sanitize(df, "drop").collect()] == ["3"]


def test_guard(spark):
    turns = [(1, 0, "user", "I am a@b.io"), (1, 1, "assistant", "Hi [EMAIL_1], SSN 078-05-1120"), (2, 0, "user", "on 2024-01-05")]
    got = {(r.conv_id, r.turn): r for r in guard.guard_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 0].text == "I am [EMAIL_1]" and got[1, 1].text == "Hi a@b.io, SSN [SSN]" and got[1, 1].n_leaked == 1
    assert got[2, 0].outcome == "passed"
    one = spark.createDataFrame([(1, 0, "user", "078-05-1120 a@b.io")], "conv_id long, turn long, role string, text string")
    blocked = guard.guard_conversations(one, guard.GuardPolicy(inbound={"SSN": "block"})).first()
    assert (blocked.outcome, blocked.text, blocked.n_masked) == ("blocked", "", 0)
    assert guard.restore("[EMAIL_1] [EMAIL_9]", {"[EMAIL_1]": 'q"@b.io'}, json_safe=True) == 'q\\"@b.io [EMAIL_9]'


def test_chain_tampering(spark):
    log = provenance.chain(spark.range(6).select((F.col("id") % 2).alias("t"), "id"), "t", "id", F.concat(F.lit("e"), "id"))
    assert provenance.verify_chain(log).count() == 0
    bad = log.withColumn("body", F.when((F.col("chain") == "0") & (F.col("seq") == 2), "evil").otherwise(F.col("body")))
    assert [(r.chain, r.seq, r.problem) for r in provenance.verify_chain(bad).collect()] == [("0", 2, "content")]
    gap = provenance.verify_chain(log.where("not (chain = '1' and seq = 2)")).collect()
    assert {r.problem for r in gap} == {"sequence 2 missing", "link"}


def test_merkle(spark):
    import hashlib

    leaves = [hashlib.sha256(bytes([i])).hexdigest() for i in range(5)]
    level = [hashlib.sha256(b"\0" + bytes.fromhex(h)).digest() for h in sorted(leaves)]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    df = spark.createDataFrame([(h,) for h in leaves], "sha256 string")
    assert provenance.merkle_levels(df).first()[0] == level[0].hex()
    assert provenance.merkle_levels(df.orderBy(F.desc("sha256"))).first()[0] == level[0].hex()


def test_revision_and_lineage(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1")], "path string, sha256 string")
    b = spark.createDataFrame([("y", "2"), ("z", "1")], "path string, sha256 string")
    assert {tuple(r) for r in provenance.revision(a, b).collect()} == {("z", "added"), ("x", "removed"), ("y", "changed")}
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", "c")], "child string, parent string")
    assert {tuple(r) for r in provenance.lineage(edges, "c").collect()} == {("c", 0), ("b", 1), ("a", 2)}


def test_throttle(spark):
    rows = [("u", t, ok) for t, ok in ((0, False), (10, False), (20, False), (30, True), (40, False), (940, False))]
    df = spark.createDataFrame(rows, "k string, s long, ok boolean").withColumn("at", F.timestamp_seconds("s"))
    got = {r.s: (r.failures, r.blocked) for r in provenance.login_throttle(df, "k", "at", F.col("ok"), 3, 900).collect()}
    assert got[20] == (3, True) and got[40] == (1, False) and got[940] == (1, False)


def test_policy(spark):
    rules = policy.rule_table(spark, {"min_k_anonymity": 5, "pii_columns_max": {"warn": 0, "fail": 2}, "unsafe_pickle": "fail", "mia_auc_max": 0.6})
    ev = spark.createDataFrame([("min_k_anonymity", 3.0), ("pii_columns_max", 1.0), ("unsafe_pickle", 0.0)], "rule string, observed double")
    got = policy.evaluate(rules, ev)
    assert {r.rule: r.result for r in got.collect()} == {"min_k_anonymity": "fail", "pii_columns_max": "warn", "unsafe_pickle": "pass", "mia_auc_max": "warn"}
    assert policy.worst(got).first().verdict == "fail" and policy.worst(got.limit(0)).first().verdict == "pass"
    with pytest.raises(ValueError, match="no such rule"):
        policy.rule_table(spark, {"nope": 1})


def test_metadata(spark):
    d = spark.createDataFrame([("m", "v1", "active", 1)], "model string, version_id string, status string, created_at int")
    new = spark.createDataFrame([("m", "v2", "x", 2)], d.schema)
    assert {(r.version_id, r.status) for r in metadata.deploy(d, new, ["model"]).collect()} == {("v1", "superseded"), ("v2", "active")}
    e = spark.createDataFrame([("a", "ok", float(x)) for x in (1, 2, 3, 4)], "day string, outcome string, ms double")
    assert metadata.guard_stats(e, F.col("day"), "outcome", "ms", F.lit(False)).first().latency == 3.0
