import collections
import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.operators import anonymize, profile, reid
from veilmark.plans.running import quantiles
from veilmark.sources import tables


def test_roles(spark):
    df = spark.range(400).select(
        F.col("id").alias("customer_id"), F.format_string("%,.2f", F.col("id") * 10.5).alias("amount"), F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("city"), F.col("id") % 5)).alias("city"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("signup"), F.lpad((F.col("id") % 90).cast("string"), 5, "0").alias("code"),
        F.concat(F.lit("free text "), F.col("id")).alias("comment"), F.lit("x").alias("constant"), F.lit(None).cast("string").alias("empty"), (F.col("id") % 2 == 0).alias("flag"),
    )
    got = {r.column: r.role or r.reason for r in profile.column_roles(df).collect()}
    assert got == {"customer_id": "row identifier", "amount": "numeric", "city": "categorical", "signup": "datetime", "code": "categorical", "comment": "high-cardinality text (identifier or free text)", "constant": "constant", "empty": "all values missing", "flag": "categorical"}
    out = profile.apply_plan(df, profile.infer_plan(df, exclude=("flag",)))
    assert "signup_dayofweek" in out.columns and out.first().signup_year == 2020


def test_tasks_and_cleaning(spark):
    df = spark.createDataFrame([(i % 20, "yes" if i % 2 else "no") for i in range(20)] + [(3, None), (1, "yes"), (99, "rare")], "x long, y string")
    assert profile.infer_task(df.where("y <> 'rare'"), "y").first().task == "binary"
    assert profile.infer_task(df, "x").first().task == "regression"
    assert profile.clean_rows(df, "y").count() == 20


def test_csv_codes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("zip,age,score\n02103,41,1.5\n10001,35,\n")
    df = tables.read_table(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"zip": "string", "age": "bigint", "score": "double"}
    assert [r.zip for r in df.collect()] == ["02103", "10001"]
    with pytest.raises(ValueError, match="unsupported"):
        tables.load_table(spark, "x.foo")


def test_labels(spark):
    rows = [(v, z) for v, z in ((18, "02139"), (42, "10001"), (79, "94110"), (None, None))]
    df = spark.createDataFrame(rows, "age long, zip string")
    rules = {"age": {"kind": "range", "width": 10, "low": 20, "high": 70, "integer": True}, "zip": {"kind": "prefix", "keep": 3}}
    assert [tuple(r) for r in anonymize.apply_generalization(df, rules).collect()] == [("<30", "021**"), ("40-49", "100**"), ("70+", "941**"), (None, None)]
    pooled = df.select(anonymize.pool_label(F.col("zip"), ["02139"]).alias("z"))
    assert [r.z for r in pooled.collect()] == ["02139", "other", "other", None]


def test_widths():
    assert anonymize.nice_width(50, 10) == 10 and anonymize.nice_width(2.4, 10) == 0.5 and anonymize.split_target(5, 0.25) == 20


@pytest.mark.parametrize("label", [None, "income"])
def test_fit_reaches_k(spark, label):
    df = spark.range(600).select((F.pmod(F.xxhash64("id"), F.lit(62)) + 18).alias("age"), F.when(F.col("id") % 2 == 0, "F").otherwise("M").alias("gender"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(6)).cast("string").alias("marital"), (F.col("id") % 3 == 0).cast("string").alias("income"))
    rules = anonymize.fit_generalization(df, ["age", "gender", "marital"], 10, 10, label=label)
    out = anonymize.apply_generalization(df, rules)
    assert reid.at_risk(out, ["age", "gender", "marital"], 10).first()[0] <= 6
    assert reid.k_anonymity(reid.suppress_small_groups(out, ["age", "gender", "marital"], 10), ["age", "gender", "marital"]).first()[0] >= 10


def _fit_by_brute_force(rows, columns, k, share, label):
    """The greedy fit over all rows with every label computed anew, in plain Python."""
    n, values = len(rows), {c: [r[c] for r in rows] for c in columns}

    def range_rule(c, w):
        known = sorted(v for v in values[c] if v is not None)
        q = [float(np.quantile(known, p)) for p in (0.05, 0.95)]
        low, high = (math.floor(x / w + 1e-9) * w for x in q)
        return ("range", w, low, max(high, low + w))

    def show(v, rule):
        if rule is None:
            return v if v is None else str(v)
        if rule[0] == "range":
            _, w, low, high = rule
            return None if v is None else min(max(math.floor(v / w) * w, low), high)
        if rule[0] == "pool":
            return None if v is None else v if v in rule[1] else "other"
        return "*"

    def ladder(c, rule):
        if rule is None:
            common = [v for v, _ in sorted(collections.Counter(v for v in values[c] if v is not None).items(), key=lambda x: (-x[1], x[0]))]
            return [("pool", common[:m]) for m in range(len(common) - 1, 1, -1)] + [("suppress",)]
        out = []
        while rule[3] > rule[2] + rule[1]:
            rule = range_rule(c, rule[1] * 2)
            out.append(rule)
        return [*out, ("suppress",)]

    def risk(rules):
        keys = collections.Counter(tuple(show(r[c], rules[c]) for c in columns) for r in rows)
        return sum(m for m in keys.values() if m < k)

    def told(c, rule):
        x = [show(v, rule) for v in values[c]]
        y = [r[label] for r in rows] if label else x
        h = lambda z: -sum(m / n * math.log(m / n) for m in collections.Counter(z).values())
        return h(x) + h(y) - h(zip(x, y, strict=True))

    rules = {c: range_rule(c, 10) if isinstance(rows[0][c], int) else None for c in columns}
    open_ = {c: ladder(c, rules[c]) for c in columns}
    while risk(rules) > share * n and any(open_.values()):
        choices = []
        for c in columns:
            for i, rule in enumerate(open_[c]):
                loss = max(told(c, rules[c]) - told(c, rule), 0.0)
                choices.append(((risk(rules) - risk({**rules, c: rule})) / (loss + 1e-3), -loss, -columns.index(c), -i))
        _, _, place, number = max(choices)
        c = columns[-place]
        rules[c], open_[c] = open_[c][-number], open_[c][1 - number :]
    return rules


@pytest.mark.parametrize("label", [None, "income"])
def test_fit_is_the_greedy_one(spark, label):
    made = random.Random(5)
    rows = [{"age": made.choice([None, *range(18, 90)]) if i else 40, "hours": int(made.gauss(40, 12)), "job": made.choice("aabbbcdddddefghh"), "income": made.choice(["x", "y"])} for i in range(700)]
    for r in rows:
        r["income"] = "z" if (r["age"] or 0) > 60 and made.random() < 0.7 else r["income"]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "age long, hours long, job string, income string")
    columns = ["age", "hours", "job"]
    got = anonymize.fit_generalization(df, columns, 10, 6, 0.02, label)
    want = _fit_by_brute_force(rows, columns, 6, 0.02, label)
    plain = lambda r: None if r is None else ("range", r["width"], r["low"], r["high"]) if r["kind"] == "range" else ("pool", sorted(r["keep"])) if r["kind"] == "pool" else ("suppress",)
    assert {c: plain(got.get(c)) for c in columns} == {c: ("pool", sorted(r[1])) if r and r[0] == "pool" else r for c, r in want.items()}


def test_quantiles(spark):
    made = random.Random(3)
    for values in ([made.gauss(0, 1) for _ in range(501)], [1.0] * 7, [made.randrange(5) * 1.0 for _ in range(100)], [4.0], []):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
        levels = [0.0, 0.05, 0.5, 0.77, 1.0]
        assert quantiles(df, F.col("x"), levels) == (df.agg(F.percentile("x", levels)).first()[0] or [])


def test_merged_counts_shrink_and_keep_every_label(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 1000).alias("x"), (F.col("id") % 3).cast("string").alias("y"))
    rules, options, counted, total = anonymize._prepared(df, ["x"], 10, "y")
    merged = anonymize._merged(counted, rules, options, ["x"])
    assert merged.count() <= 3 * 101 < counted.count() and merged.agg(F.sum("__n")).first()[0] == total == 5000


def test_information(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")] * 10, "p string, q string")
    assert abs(anonymize.information(df, "p", "q").first()[0] - 0.693147) < 1e-5
    assert abs(anonymize.information(df, "p").first()[0] - 0.693147) < 1e-5


def test_corpus(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "a", "text": "mail x@y.io now", "entities": [{"start": 5, "end": 11, "type": "email"}, {"start": 3, "end": 90, "type": "x"}]}\n\n{"source_text": "SSN 078-05-1120", "privacy_mask": [{"start": 4, "end": 15, "label": "SSN"}]}\n')
    rows = {r.id: r for r in tables.load_corpus(spark, str(tmp_path / "c.jsonl")).collect()}
    assert [(e.start, e.end, e.entity_type) for e in rows["a"].entities] == [(5, 11, "EMAIL")] and rows["1"].entities[0].entity_type == "SSN"
    (tmp_path / "t.txt").write_text("write to a@b.io\nnothing\n")
    got = {r.id: len(r.entities) for r in tables.load_corpus(spark, str(tmp_path / "t.txt"), True).collect()}
    assert got == {"0": 1, "1": 0}
    tables.write_corpus(tables.load_corpus(spark, str(tmp_path / "c.jsonl")), str(tmp_path / "out"))
    assert tables.file_hashes(spark, str(tmp_path / "c.jsonl")).count() == 1
    assert datetime.date.today() > datetime.date(2020, 1, 1)
