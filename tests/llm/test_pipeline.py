import re

import corpus_pipeline
from test_dedup import components, contaminated, shingles

from veilmark.llm import quality


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns = docs.columns
    quality_kept = corpus_pipeline.quality_stage(spark, docs, sf).cache()
    rows, learned = quality.judged(spark, docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert quality_kept.columns == columns and {r.doc_id for r in quality_kept.collect()} == {r.doc_id for r in rows.where("q_kept").collect()}
    one = corpus_pipeline.dedup_stage(spark, quality_kept, sf).cache()
    want = {i for i, c in components({r.doc_id: shingles(r.text) for r in quality_kept.collect()}, 80, 100).items() if i == c}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == want
    clean = corpus_pipeline.decontamination_stage(spark, one, sf).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = contaminated([(r.doc_id, r.text) for r in one.collect()], items)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {i for i, x in bad.items() if not x[3]}
    safe = corpus_pipeline.secrets_stage(spark, clean, sf).cache()
    assert safe.columns == columns and safe.count() == clean.count()
    assert not any(re.search(r"[0-9a-f]{24}", r.text) or r.n_chars != len(r.text) for r in safe.collect())
    packed = corpus_pipeline.packing_stage(spark, safe, sf)
    assert packed.agg({"n_tokens": "sum"}).first()[0] == sum(len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text) if w]) for r in safe.collect())


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "text_hash", "piece", "first_word", "n_tokens", "bucket", "batch", "slot"] and out.count() > 0


def test_stages_judge_each_row(spark, sf):
    """Null and repeated ids, null texts, clashing columns and an empty table go through every stage."""
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [" ".join(f"plain{i}x{j}" for j in range(60)) for i in range(4)]
    rows = [(None, items[0], 1), (None, clean[0], 2), (5, clean[1], 3), (5, clean[1], 3), (5, clean[2], 4), (5, items[1], 5), (6, None, 6), (7, "", 7), (8, clean[3] + " password=hunter2222", 8)]
    docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, n_shingles int, component_id string, row int")
    one = corpus_pipeline.dedup_stage(spark, docs, sf)
    assert one.columns == docs.columns and sorted(r.n_shingles for r in one.collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    left = corpus_pipeline.decontamination_stage(spark, docs, sf)
    assert left.columns == docs.columns and sorted(r.n_shingles for r in left.collect()) == [2, 3, 3, 4, 6, 7, 8]
    safe = {r.row: r.text for r in corpus_pipeline.secrets_stage(spark, docs, sf).collect()}
    assert safe[8].endswith("[SECRET]") and safe[6] is None and safe[7] == "" and safe[1] == clean[0]
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns and not {6, 7} & {r.n_shingles for r in kept.collect()}
    packed = corpus_pipeline.packing_stage(spark, docs, sf).collect()
    assert len(packed) == len(rows) and sum(r.bucket is None for r in packed) == 2 and len({(r.doc_id, r.text_hash) for r in packed}) == 8
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
