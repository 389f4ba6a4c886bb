"""Merkle manifest against a brute-force tree and against SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from veilmark.llm import queries
from veilmark.llm.manifest import ManifestParams, document_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def joined(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    shown = [(None if v is None else str(v)) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)]
    return joined("-" if v is None else f"{len(v.encode())}:{v}" for v in shown)


def tree(nodes):
    """The root, and for each node the siblings on either side, level by level."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for at in range(len(nodes)):
            first = at - at % 3
            for i in members[at]:
                paths[i].append((nodes[first:at], nodes[at + 1 : first + 3]))
        members = [sum(members[a : a + 3], []) for a in range(0, len(nodes), 3)]
        nodes = [joined(nodes[a : a + 3]) for a in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        now = r["text"]
        if now is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            now = now.replace("\n", "")
        groups.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, now), r["doc_id"]))
    trees = [tree([x[2] for x in sorted(groups[g])]) for g in sorted(groups)]
    root, above = tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), rest in zip(sorted(groups), trees, above, strict=True):
        for x, path in zip(sorted(groups[g]), paths, strict=True):
            folded = x[3]
            for left, right in path + rest:
                folded = joined([*left, folded, *right])
            out.append((x[4], x[2], subroot, root, joined(s for a, b in path + rest for s in a + b), folded, folded == root))
    return sorted(out, key=str)


def found(spark, docs, params=ManifestParams()):
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = document_manifest(spark, docs, altered, params).withColumn("proof", F.sha2(F.array_join("proof", ""), 256))
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.mark.parametrize("params", [ManifestParams(), ManifestParams(block_levels=1, top_nodes=4), ManifestParams(block_levels=2, top_nodes=1), ManifestParams(block_levels=3, top_nodes=15)], ids=str)
def test_against_brute_force(spark, sf, params):
    """Also where the top tree is too large for the driver and is reduced inside and over the groups first."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([r.asDict() for r in docs.collect()])
    assert found(spark, docs, params) == want and not all(r[-1] for r in want)


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.OP12_SQL).df()
    got = queries.op12_merkle_manifest(spark, sf).toPandas()
    assert sorted(map(str, got[sorted(got)].itertuples(index=False, name=None))) == sorted(map(str, want[sorted(want)].itertuples(index=False, name=None)))


def test_edges(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, a hot and lone sources, clashing columns, empty table."""
    rows = [(i, f"t{i}\n\nü", "en", "hot", i) for i in range(40)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (7, "", "en", None, 0), (7, "a\nb", "en", "lone", 3), (7, "a\nb", "en", "hot", 3), (7, "c", None, "hot", None), (3, "x\n" * 200_000, "en", "", 9), (5, "\n", "en", "é", 1), (-4, "neg\n", "en", "z", 4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute([r.asDict() for r in docs.collect()])
    for params in (ManifestParams(), ManifestParams(block_levels=1, top_nodes=2)):
        assert found(spark, docs, params) == want
    clash = docs.withColumns({"leaf": F.lit("x"), "proof": F.lit(1), "block": F.lit(2), "grp": F.lit(3), "root": F.lit(None)})
    assert found(spark, clash) == want
    assert found(spark, docs.limit(0)) == [] and document_manifest(spark, docs.where("doc_id = -4")).first().proof == []


def test_tampering_shows(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}", 6) for i in range(30)], SCHEMA)
    changed = F.when(F.col("doc_id") == 11, F.lit("text 12")).otherwise(F.col("text"))
    assert [r.doc_id for r in document_manifest(spark, docs, changed).collect() if not r.verified] == [11]
    assert all(r.verified for r in document_manifest(spark, docs).collect())
