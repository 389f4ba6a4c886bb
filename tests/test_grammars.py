import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilmark.plans import running
from veilmark.functions import grammars as G
from veilmark.operators import audit, references


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def test_every_value_passes_its_check(spark):
    keys = spark.range(400).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    kinds = ["CREDITCARDNUMBER", "PHONEIMEI", "IBAN", "VEHICLEVIN", "SSN", "IPV4", "ETHEREUMADDRESS", "DATE"]
    rows = keys.select(*[G.made(k, G.key_of(F.lit(k), F.col("v"))).alias(k) for k in kinds]).collect()
    for r in rows:
        assert luhn(r.CREDITCARDNUMBER) and len(r.CREDITCARDNUMBER) == 16 and luhn(r.PHONEIMEI) and len(r.PHONEIMEI) == 15
        moved = r.IBAN[4:] + r.IBAN[:4]
        assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 and len(r.IBAN) == 22
        area, group, serial = map(int, r.SSN.split("-"))
        assert 0 < area < 900 and area != 666 and group and serial
        weighed = sum(w * (int(c) if c.isdigit() else G.VIN_VALUES[c]) for c, w in zip(r.VEHICLEVIN, G.VIN_WEIGHTS, strict=True))
        assert r.VEHICLEVIN[8] == "0123456789X"[weighed % 11]
        assert re.fullmatch("0x[0-9a-f]{40}", r.ETHEREUMADDRESS) and re.fullmatch(r"\d{4}-\d\d-\d\d", r.DATE)
    assert len({r.CREDITCARDNUMBER for r in rows}) == 400
    made = spark.createDataFrame(rows)
    assert made.where(~(G.valid("CREDITCARDNUMBER", F.col("CREDITCARDNUMBER")) & G.valid("IBAN", F.col("IBAN")) & G.valid("VEHICLEVIN", F.col("VEHICLEVIN")) & G.valid("SSN", F.col("SSN")) & G.valid("IPV4", F.col("IPV4")) & G.valid("PHONEIMEI", F.col("PHONEIMEI")))).isEmpty()


def test_checks_refuse_what_is_changed(spark):
    bad = [("CREDITCARDNUMBER", "4111111111111112"), ("IBAN", "DE89370400440532013001"), ("VEHICLEVIN", "1M8GDM9A1KP042788"), ("SSN", "666-12-1234"), ("IPV4", "1.2.3.256"), ("PHONEIMEI", "490154203237519")]
    good = [("CREDITCARDNUMBER", "4111 1111 1111 1111"), ("IBAN", "DE89370400440532013000"), ("VEHICLEVIN", "1M8GDM9AXKP042788"), ("SSN", "078-05-1120"), ("IPV4", "1.2.3.255"), ("PHONEIMEI", "490154203237518")]
    for rows, want in ((bad, False), (good, True)):
        for kind, value in rows:
            assert spark.range(1).select(G.valid(kind, F.lit(value))).first()[0] is want, (kind, value)


def test_every_type_makes_a_value(spark):
    kinds = spark.createDataFrame([(k,) for k in G.GRAMMARS] + [("OTHER",)], "kind string")
    got = {r.kind: r.v for r in kinds.withColumn("v", G.generated(F.lower("kind"), F.lit("x"))).collect()}
    assert len(got) == 57 and got.pop("OTHER") is None and all(got.values())


def test_references_are_like_the_value_and_new(spark):
    held = [("a", 0, "SSN", "123-45-6789"), ("a", 1, "CREDITCARDNUMBER", "4111111111111111"), ("b", 0, "AGE", "44"), ("b", 1, "XCODE", "Ab-12"), ("c", 0, "SEX", "male"), ("c", 1, "SEX", "female")]
    targets = spark.createDataFrame(held, "id string, pos int, entity_type string, value string")
    made = {(r.entity_type, r.value): r.made for r in references.outside_corpus(targets, 4).collect()}
    ssn, card, age, code = (made[k] for k in [("SSN", "123-45-6789"), ("CREDITCARDNUMBER", "4111111111111111"), ("AGE", "44"), ("XCODE", "Ab-12")])
    assert len(set(ssn)) == len(set(card)) == len(set(age)) == len(set(code)) == 4
    assert all(luhn(c) for c in card) and all(18 <= int(a) <= 90 and a != "44" for a in age) and all(re.fullmatch("[A-Z][a-z]-[0-9]{2}", c) for c in code)
    assert all("male" not in m and "female" not in m for (k, _), m in made.items() if k == "SEX")


def test_gram_losses_against_brute_force(spark):
    import math

    texts = [("1", "aé😀aé😀b"), ("2", "plain a@b.io"), ("3", None), ("4", "")]
    records = spark.createDataFrame(texts, "id string, text string")
    counts = audit.gram_counts(records)
    want = Counter(("   " + x)[i : i + 4] for _, x in texts if x for i in range(len(x)))
    assert {r.context + r.next: r.n for r in counts.collect()} == dict(want)
    spans = [("1", 0, 0, texts[0][1], 2, 6), ("2", 0, 0, texts[1][1], 0, 5), ("2", 1, 0, "xyz", 0, 3), ("2", 2, 0, "xyz", 1, 1)]
    got = {(r.id, r.pos): (r.loss, r.size) for r in audit.gram_losses(spark.createDataFrame(spans, "id string, pos int, variant int, text string, start int, end int"), counts).collect()}
    whole = Counter()
    for g, n in want.items():
        whole[g[:3]] += n
    for i, pos, _, x, a, b in spans[:3]:
        grams = [("   " + x)[k : k + 4] for k in range(a, b)]
        loss = [-math.log((want[g] + 0.1) / (whole[g[:3]] + 25.6)) for g in grams]
        assert got[i, pos] == (pytest.approx(sum(loss) / len(loss)), b - a)
    assert ("2", 2) not in got


def test_dear_rows_are_dealt_over_all_tasks(spark):
    """Short values in one partition are drawn for in many tasks."""
    from veilmark.operators import references

    targets = spark.createDataFrame([("EMAIL", f"a{i}@b.example") for i in range(200)], "entity_type string, value string").coalesce(1)
    plan = references.outside_corpus(targets, 2)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan or "Repartition" in plan
    assert running.spread(targets).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
