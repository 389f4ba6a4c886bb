import random
import sys
from pathlib import Path

from pyspark.sql import functions as F

from veilmark.llm import language_id, packing, queries, toxicity

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op8_language_id(spark, sf).join(docs, "doc_id")
    held = got.where("held_out")
    assert held.count() > 20 and held.where("lang = lang_pred").count() >= 0.95 * held.count()
    assert got.where("score < 0 or score > 1").count() == 0 and got.count() == docs.count()


def test_language_edges(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)] + [(90, None, "en"), (91, "", "de"), (92, "123 !", None), (93, "the and the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(3))
    got = {r.doc_id: r for r in language_id.predict(spark, df, language_id.train(spark, df), F.col("doc_id")).collect()}
    assert got[0].lang_pred == "en" and got[1].lang_pred == "de" and got[93].lang_pred == "en"
    assert [(got[i].lang_pred, got[i].score) for i in (90, 91, 92)] == [("und", 0.0)] * 3
    empty = language_id.train(spark, df.limit(0))
    assert {r.lang_pred for r in language_id.predict(spark, df, empty, F.col("doc_id")).collect()} == {"und"}


def toxic_rows(n=400):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{r.randrange(300)}" for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            w[r.randrange(40)] = r.choice(["vilest", "grossly"])
            w[r.randrange(40)] = r.choice(["nastyone", "nastytwo", "nastyfour"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad), int(bad and i % 10 == 0)))
    return docs, labels


def test_toxicity_chain(spark):
    docs, labels = toxic_rows()
    docs += [(900, None), (901, ""), (902, "w1 vilest nastythree w3"), (None, "w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("flagged", F.lit("clash"))
    lab = spark.createDataFrame([*[(i, s, t) for i, t, s in labels], (None, 1, 1), (5, 0, None)], "doc_id long, severe int, toxic int")
    model = toxicity.train(spark, d, lab, ["severe", "toxic"])
    got = {r.doc_id: r for r in toxicity.predict(spark, d, model).collect()}
    assert all(got[i].flagged == (i % 5 == 0) for i in range(400))
    assert got[902].flagged and not got[900].flagged and not got[901].flagged and 0 <= got[902].p_severe <= 1
    assert len(model.links) == 2 and len(model.links[1][3]) == 1
    none = toxicity.train(spark, d, lab.limit(0), ["severe", "toxic"])
    assert toxicity.predict(spark, d, none).where("flagged").count() == 0


def test_toxicity_held_out(spark):
    """Recall and precision on labelled texts that the chain was not trained on (a twentieth of the toxic ones shows no toxic word)."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(spark, docs, labels.where(~held), ["low_quality", "toxic"])
    got = {r.doc_id: r.flagged for r in toxicity.predict(spark, docs, model).collect()}
    known = {r.doc_id: r.toxic for r in labels.where(held).collect()}
    toxic = [got[i] for i, t in known.items() if t]
    assert sum(toxic) >= 0.86 * len(toxic) and sum(got[i] for i, t in known.items() if not t) <= 0.005 * len(known)


def test_last_link_uses_earlier_probabilities(spark):
    """Toxic here is what an earlier category says of a text together with its words; the verdict changes without the chain."""
    docs, labels = toxic_rows(600)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, bad, bad) for i, bad, _ in labels], "doc_id long, rude int, toxic int")
    model = toxicity.train(spark, d, lab, ["rude", "toxic"])
    assert model.links[1][3][0] > 0
    used, weights, intercept, _ = model.links[1]
    cut = toxicity.ToxicityModel(model.categories, [model.links[0], (used, weights, intercept, [0.0])], model.params)
    one, two = ({r.doc_id: r.p_toxic for r in toxicity.predict(spark, d, m).collect()} for m in (model, cut))
    assert any(abs(one[i] - two[i]) > 0.02 for i in one)
    assert toxicity.predict(spark, d.limit(0), model).count() == 0


def brute(histogram, buckets):
    lengths = sorted(histogram)

    def best(i, k):  # least padding of lengths[i:] with k ranges
        if i == len(lengths):
            return 0
        if k == 0:
            return float("inf")
        return min(sum((lengths[j] - x) * histogram[x] for x in lengths[i : j + 1]) + best(j + 1, k - 1) for j in range(i, len(lengths)))

    return best(0, buckets)


def test_boundaries_are_optimal():
    r = random.Random(4)
    for _ in range(20):
        h = {r.randrange(1, 60): r.randrange(1, 9) for _ in range(8)}
        ends = packing.bucket_boundaries(h, 3)
        assert len(ends) <= 3 and ends[-1] == max(h)
        assert sum((min(e for e in ends if e >= x) - x) * n for x, n in h.items()) == brute(h, 3)
    assert packing.bucket_boundaries({}, 3) == []


def test_packing_round_trip(spark):
    r = random.Random(5)
    docs = [(i, " ".join(["w"] * r.choice([1, 5, 20, 90, 230]))) for i in range(300)] + [(900, None), (901, " \n"), (None, "a b"), (7, "a b c"), (7, "a b c")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    p = packing.PackingParams(max_tokens=100, buckets=3, batch_tokens=400, block_rows=37)
    rows = packing.pack(spark, df, p).collect()
    full = [x for x in rows if x.bucket is not None]
    assert sum(x.n_tokens for x in full) == sum(len((t or "").split()) for _, t in docs)
    assert len({(x.bucket, x.batch, x.slot) for x in full}) == len(full) and {x.doc_id for x in rows if x.bucket is None} == {900, 901}
    for b in {x.bucket for x in full}:
        own = [x for x in full if x.bucket == b]
        size = max(1, 400 // b)
        assert all(x.n_tokens <= b and x.slot < size for x in own)
        assert sorted(x.batch * size + x.slot for x in own) == list(range(len(own)))
    assert packing.pack(spark, df.limit(0), p).count() == 0
