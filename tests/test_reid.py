from pyspark.sql import functions as F

from veilmark.operators import reid

ROWS = [(34, "02139", "F", "high"), (34, "02139", "F", "low"), (34, "02139", "M", "high"), (51, "02139", "M", "low"), (51, "02139", "M", "low"), (29, "10001", "F", "high")]


def people(spark, n=6):
    return spark.createDataFrame(ROWS[:n], "age long, zip string, gender string, income string")


def test_k_and_unique(spark):
    df = people(spark)
    assert reid.k_anonymity(df, ["age", "zip"]).first()[0] == 1
    assert reid.unique_fraction(df, ["age", "zip", "gender"]).first()[0] == 2 / 6
    assert reid.k_anonymity(df.limit(0), ["age"]).first()[0] is None
    assert reid.unique_fraction(df.limit(0), ["age"]).first()[0] == 0


def test_null_is_a_class_and_a_value(spark):
    df = spark.createDataFrame([(None, "a"), (None, None), ("x", "a"), ("x", "a")], "q string, s string")
    assert reid.k_anonymity(df, ["q"]).first()[0] == 2
    assert reid.l_diversity(df, ["q"], "s").first()[0] == 1
    assert reid.suppress_small_groups(df.union(df.limit(1).withColumn("q", F.lit("solo"))), ["q"], 2).count() == 4


def test_l_diversity(spark):
    assert reid.l_diversity(people(spark, 5), ["zip"], "income").first()[0] == 2
    assert reid.l_diversity(people(spark), ["zip"], "income").first()[0] == 1


def test_minimal_combinations(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("a"), (F.col("id") % 20).alias("b"), F.col("id").alias("c"))
    found = {r["columns"]: r["unique_fraction"] for r in reid.risky_combinations(df, ["a", "b", "c"]).collect()}
    assert found == {"c": 1.0}
    df = spark.range(40).select((F.col("id") % 8).alias("a"), F.floor(F.col("id") / 8).alias("b"))
    assert {r["columns"] for r in reid.risky_combinations(df, ["a", "b"]).collect()} == {"a,b"}


def test_at_risk_and_assess(spark):
    df = people(spark)
    assert reid.at_risk(df, ["age", "zip"], 3).first()[0] == 3
    row = reid.assess(df, sensitive="income").first()
    assert row.quasi_identifiers == "age,zip,gender" and row.k_anonymity == 1
    assert reid.assess(df.select("income")).first().k_anonymity is None
