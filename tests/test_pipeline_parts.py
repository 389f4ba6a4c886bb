import pytest
from pyspark.sql import functions as F

from veilmark.functions import documents
from veilmark.operators import anonymize, metadata, profile, provenance, references, reid
from veilmark.plans import gate, preprocess
from veilmark.sources import tables
from veilmark.streaming import monitoring


def test_preprocess_and_replay(spark, tmp_path):
    df = tables.demo_table(spark, 500, 1).cache()
    train, test, manifest = preprocess.preprocess(df, "income", 4)
    assert set(manifest["drop"]) == {"email", "name", "phone"} and set(manifest["quasi_identifiers"]) == {"age", "zip", "gender"}
    for side in (train, test):
        assert side.count() > 0 and reid.k_anonymity(side, manifest["quasi_identifiers"]).first()[0] >= 4
    tables.demo_table(spark, 20, 2).coalesce(1).write.option("header", True).csv(str(tmp_path / "batch.csv"))
    recorded = preprocess.manifest_hash(manifest)
    assert preprocess.prepare_batch(spark, str(tmp_path / "batch.csv"), manifest, recorded, str(tmp_path / "out")) == 20
    with pytest.raises(ValueError, match="differs"):
        preprocess.certified(manifest | {"min_k": 1}, recorded)
    cleaner = preprocess.TableCleaner(profile.FeaturePlan({"age": "numeric"}))
    assert cleaner.transform(df).columns == ["age"]


def test_gate_and_monitor(spark):
    df = tables.demo_table(spark, 300, 1)
    got = {r.rule: r.result for r in gate.privacy_gate(df, ["age", "zip"], "income", {"pii_columns_max": 0, "min_k_anonymity": 5, "min_l_diversity": 2}).collect()}
    assert got == {"pii_columns_max": "fail", "min_k_anonymity": "fail", "min_l_diversity": "fail"}
    safe = anonymize.apply_generalization(df.drop("name", "email", "phone"), {"zip": {"kind": "suppress"}, "age": {"kind": "suppress"}})
    got = {r.rule: r.result for r in gate.privacy_gate(safe, ["age", "zip"], "income", {"pii_columns_max": 0, "min_k_anonymity": 5, "min_l_diversity": 2}).collect()}
    assert set(got.values()) == {"pass"}
    moved = tables.demo_table(spark, 300, 2, drift=2.0).select("hours_per_week")
    assert gate.monitor(df.select("hours_per_week"), moved).first().retrain


def test_references(spark):
    rows = [(str(i), 0, "EMAIL", f"user{i}@mail.test", "to ", " now") for i in range(8)]
    df = spark.createDataFrame(rows, "id string, pos int, entity_type string, value string, prefix string, suffix string")
    got = references.references(df, 3).collect()
    assert all(len(set(r.references)) == 3 and r.value not in r.references for r in got)
    v = references.variants(references.references(df, 2, "synthetic")).collect()
    assert len(v) == 24 and all(r.text[r.start : r.end] for r in v)
    scorer = references.NgramScorer(["abcabc"])
    assert sum(x[2] for x in scorer(["abc"])[0]) > sum(x[2] for x in scorer(["zzz"])[0])


def test_references_search_whole_cells(spark):
    from veilmark.functions.patterns import similar

    values = [f"user{i:04d}@mail.test" for i in range(400)] + [f"U{i:03d}rare@mail.test" for i in range(3)]
    rows = [(str(i), 0, "EMAIL", v, "", "") for i, v in enumerate(values)] + [("x", 0, "PIN", "12-4", "", ""), ("y", 0, "PIN", "long text", "", "")]
    df = spark.createDataFrame(rows, "id string, pos int, entity_type string, value string, prefix string, suffix string")
    got = references.references(df, 4, "corpus").collect()
    assert len(got) == len(rows) and all(r.value not in r.references for r in got)
    assert len({v for r in got for v in r.references}) > 300
    by = {r.value: r.references for r in got}
    assert all(set(by[v]) == set(values[400:]) - {v} for v in values[400:])
    assert by["12-4"] == ["long text"] and by["long text"] == ["12-4"]
    pairs = spark.createDataFrame([(v, x) for v in values for x in by[v]], "a string, b string")
    assert pairs.where(~similar(F.col("a"), F.col("b"))).count() == 0
    digits = spark.createDataFrame([(str(i), 0, "PIN", f"{i:02d}", "", "") for i in range(90)], df.schema)
    made = references.references(digits, 3, "synthetic").collect()
    assert len(made) == 90 and {v for r in made for v in r.references} and not {v for r in made for v in r.references} & {r.value for r in made}


def test_documents():
    assert documents.bump_minor("draft") == "draft.1" and documents.bump_minor("2.x") == "2.x.1"
    for wrong in ("=1", "a=1", ".b=1", "a.=1", "a.b"):
        with pytest.raises(ValueError):
            documents.parse_overrides([wrong])
    assert documents.bump_minor("1.4.2") == "1.5.0" and documents.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'.encode()
    assert documents.signing_payload({"x": 1, "identity": {"key": "k", "signature": "s"}, "events": [1]}) == b'{"identity":{"key":"k","signature":null},"x":1}'
    assert documents.parse_overrides(["a.b=1", "a.c=x"]) == {"a": {"b": 1, "c": "x"}}
    typed = {"yes": True, "Off": False, "oN": "oN", "~": None, "": None, "1_000": 1000, "010": 8, "0x1F": 31, "-0b11": -3, "1e3": "1e3", "1.5e+3": 1500.0, ".5": 0.5, "-.inf": float("-inf"), "NaN": "NaN", "[1, 2]": [1, 2], "[1": "[1", "'it''s'": "it's", '"a\\n"': "a\n", "2024-01": "2024-01"}
    assert {k: documents.scalar(k) for k in typed} == typed and documents.scalar(".nan") != documents.scalar(".nan")
    assert documents.flatten({"a": {"b": "x" * 7000, "c": 1}}) == {"a.b": "x" * 6000, "a.c": "1"}
    assert '"a" -> "b"' in documents.lineage_dot([("a", "b", "upstream")], {})
    assert documents.to_jsonld("d", [{"name": "s", "inputs": ["i"], "outputs": ["o"]}], ["u"])["@graph"][2]["prov:wasGeneratedBy"] == "d#stage-s"


def test_diligence_and_retry(spark):
    v = spark.createDataFrame([("2", "1", "1.1"), ("1", None, "1.0")], "version_id string, parent_id string, version string")
    d = spark.createDataFrame([("2", "a", None), ("2", "b", "yes")], "version_id string, name string, consent string")
    a = spark.createDataFrame([("2", True), ("2", False)], "version_id string, verified boolean")
    got = {r.version_id: r for r in metadata.diligence(v, d, a).collect()}
    assert (got["2"].parent_version, got["2"].unknown_consent, got["2"].verified) == ("1.0", 1, False)
    rows = spark.createDataFrame([("u", t) for t in (0, 10, 20)], "k string, s long").withColumn("at", F.timestamp_seconds("s"))
    waits = {r.s: r.retry_after for r in provenance.retry_after(rows, "k", "at", F.lit(False), 3, 900).collect()}
    assert waits == {0: 0, 10: 0, 20: 880}


def test_streaming_throttle_and_outcomes(spark, tmp_path):
    rows = spark.createDataFrame([("u", t, t == 30) for t in (0, 10, 20, 30, 40)], "key string, s long, success boolean").select("key", F.timestamp_seconds("s").alias("at"), "success")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = monitoring.throttle(stream, 3, 900).writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.failures for r in spark.sql("select failures from throttled order by at").collect()] == [1, 2, 3, 0, 1]
    q = monitoring.daily_outcomes(stream, "at", "success").writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.success: r.n for r in spark.sql("select * from daily").collect()} == {True: 1, False: 4}
