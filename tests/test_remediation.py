import pytest
from pyspark.sql import functions as F

from veilmark.operators import text
from veilmark.plans import remediation as R

RECORDS = [("1", "mail a@b.io or c@d.io, SSN 078-05-1120 😀"), ("2", "again a@b.io here"), ("3", "from 10.0.0.1"), ("4", "none"), ("5", None)]


@pytest.fixture()
def raw(spark, tmp_path):
    text.detect_records(spark.createDataFrame(RECORDS, "id string, text string")).write.parquet(str(tmp_path / "raw"))
    return spark.read.parquet(str(tmp_path / "raw"))


def by_memory(raw, kinds, auc):
    """Values of some types that the copy still holds are high findings; the attack's strengths are given, by round."""
    calls = []

    def run(train):
        calls.append({r.id: (r.text, [train_value(r, e) for e in r.entities]) for r in train.collect()})
        value = lambda df, name: df.select("id", F.posexplode("entities").alias("pos", "e"), F.col("text")).select("id", "pos", "e.*", F.expr("substring(text, e.start + 1, e.end - e.start)").alias(name))
        both = value(raw, "a").join(value(train, "b").select("id", "pos", "b"), ["id", "pos"]).where(F.col("a").eqNullSafe(F.col("b")) & F.col("entity_type").isin(kinds))
        strengths = raw.sparkSession.createDataFrame(auc[len(calls) - 1], "entity_type string, auc double")
        return both.select("id", "start", "end", "entity_type", F.lit("high").alias("severity")), strengths

    run.calls = calls
    return run


def train_value(r, e):
    return r.text[e.start : e.end]


def test_rounds_until_the_gate_passes(spark, raw, tmp_path):
    run = by_memory(raw, ["EMAIL"], [[(None, 0.9)], [(None, 0.7), ("IPV4", 0.8), ("EMAIL", 0.5)], [(None, 0.5)]])
    folder = str(tmp_path / "rounds")
    rounds = [r.asDict() for r in R.remediate(raw, run, folder).orderBy("round").collect()]
    assert [(r["version"], r["verdict"], r["high"], r["passed"]) for r in rounds] == [("1.0.0", "fail", 3, False), ("1.1.0", "fail", 0, False), ("1.2.0", "pass", 0, True)]
    assert rounds[0]["risky_types"] == ["EMAIL"] and rounds[0]["whole_types"] == [] and rounds[1]["whole_types"] == ["IPV4"]
    first, second, third = run.calls
    assert "078-05-1120" not in second["1"][0] and "a@b.io" not in second["1"][0] + second["2"][0]  # the SSN always, mails as found
    assert second["1"][1][0] == second["2"][1][0] and second["1"][0].endswith("😀")  # one stand-in for one value
    assert second["3"][0] == first["3"][0] and "10.0.0.1" not in third["3"][0] and third["1"] == second["1"]
    assert third["4"][0] == "none" and third["5"][0] is None
    counts = {r.entity_type: r.n for r in R.replaced_counts(raw, spark.read.parquet(f"{folder}/round=2/train")).collect()}
    assert counts == {"EMAIL": 3, "SSN": 1, "IPV4": 1}
    assert R.gate_passed(R.remediate(raw, None, folder))  # all rounds are read, no audit runs


def test_a_cut_run_goes_on(spark, raw, tmp_path):
    auc = [[(None, 0.9)], [(None, 0.9)], [(None, 0.5)]]
    folder = str(tmp_path / "rounds")
    broken = by_memory(raw, ["IPV4"], auc[:1])  # the second audit fails
    with pytest.raises(IndexError):
        R.remediate(raw, broken, folder)
    rest = by_memory(raw, ["IPV4"], auc[1:])
    rounds = R.remediate(raw, rest, folder).orderBy("round").collect()
    whole = R.remediate(raw, by_memory(raw, ["IPV4"], auc), str(tmp_path / "whole")).orderBy("round").collect()
    assert rounds == whole and len(rest.calls) == 2


def test_whole_types_when_risky_twice_and_the_last_round(spark, raw, tmp_path):
    """A type that stays risky (its values are kept by the strategy given) is replaced as a whole, and rounds end."""
    stubborn = lambda train: (raw.select("id", F.inline("entities")).where("entity_type = 'EMAIL' and id = '2'").select("id", "start", "end", "entity_type", F.lit("critical").alias("severity")), spark.createDataFrame([(None, 0.5)], "entity_type string, auc double"))
    rounds = R.remediate(raw, stubborn, str(tmp_path / "r"), R.Settings(max_rounds=2, strategy="mask", always=())).orderBy("round").collect()
    assert [(r.verdict, r.critical, list(r.whole_types)) for r in rounds] == [("fail", 1, []), ("fail", 1, ["EMAIL"]), ("fail", 1, ["EMAIL"])]
    train = {r.id: r.text for r in spark.read.parquet(str(tmp_path / "r/round=2/train")).collect()}
    assert train["2"] == "again [EMAIL] here" and train["1"].startswith("mail [EMAIL] or [EMAIL], SSN 078")


def test_gram_audit_finds_what_is_held_and_not_what_was_replaced(spark, tmp_path):
    r = [(str(i), f"the customer {i} wrote from {'abcdefgh'[i % 8] * 2}{i * 37 % 97}{'qrstuvwx'[i * 5 % 8]}@mail{i % 5}.net about order {i}") for i in range(60)]
    raw = text.detect_records(spark.createDataFrame(r, "id string, text string"))
    raw.write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    run = R.gram_audit(raw, str(tmp_path / "audit"))
    before, strengths = run(raw)
    assert before.where("severity in ('high', 'critical')").count() > 30 and strengths.where("entity_type is null").first().auc > 0.9
    done = text.sanitize(raw, make=R.generated)
    after, _ = run(done)
    assert after.count() == before.count() and after.agg(F.avg("risk")).first()[0] < before.agg(F.avg("risk")).first()[0]


def test_sanitize_chosen_spans_keeps_the_others(spark):
    df = text.detect_records(spark.createDataFrame([("1", "x@y.io to 10.0.0.1"), ("2", "x@y.io")], "id string, text string"))
    df = df.withColumn("c", F.expr("CASE WHEN id = '1' THEN array(named_struct('start', 0, 'end', 6)) END"))
    got = {r.id: r for r in text.sanitize(df, "mask", chosen="c").collect()}
    assert got["1"].text == "[EMAIL] to 10.0.0.1" and [(e.start, e.end, e.entity_type) for e in got["1"].entities] == [(0, 7, "EMAIL"), (11, 19, "IPV4")]
    assert got["2"].text == "x@y.io" and len(got["2"].entities) == 1
    assert [r.id for r in text.sanitize(df, "drop", chosen="c").collect()] == ["2"]
