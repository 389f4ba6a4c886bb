"""Projection forest: recall and scores against brute force."""

import numpy as np
from pyspark.sql import functions as F

from veilmark.llm import queries
from veilmark.llm.neighbours import ForestParams, nearest

SCHEMA = "id long, vector array<float>"


def brute(rows, queries_of, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float32).astype(float)
    out = {}
    for i, v in queries_of:
        scores = (x * np.array(v, dtype=np.float32).astype(float)).sum(axis=1)
        order = [o for o in np.lexsort((ids, -scores)) if ids[o] != i][:k]
        out[i] = [(int(ids[o]), float(scores[o])) for o in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = found(queries.op11_nearest(spark, sf))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) == 1.0 and got == want  # a small table is searched whole


def test_recall_of_deep_trees(spark):
    """Unequal norms, clusters and copies; leaves far smaller than the table, shelves in parts."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 24)) * r.uniform(0.5, 3, size=(40, 1))
    x = (centres[r.integers(0, 40, 6000)] + r.normal(size=(6000, 24)) * 0.6).astype(np.float32)
    x[:1500] = x[0]  # a quarter of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    p = ForestParams(leaf_rows=32, least_seen=64, shelf_rows=256, part_rows=150, sample_rows=2000)
    asked = [row for row in rows if row[0] % 60 == 0]
    got, want = found(nearest(spark, df, df.where("id % 60 = 0"), p)), brute(rows, asked)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q, mine in got.items():
        known = dict(brute(rows, [(q, rows[q][1])], len(rows))[q])
        assert all(known[i] == s for i, s in mine) and mine == sorted(mine, key=lambda t: (-t[1], t[0]))
    assert [s for _, s in got[0]] == [s for _, s in got[60]] and all(i != q for q, mine in got.items() for i, _ in mine)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 3), 1.0, 0.0]) for i in range(9)]  # ties
    bad = [(20, None), (40, []), (60, [0.0, 0.0, 0.0]), (80, [1.0, None, 1.0]), (100, [nan, 1.0, 1.0]), (120, [inf, 1.0, 1.0]), (140, [1.0, 2.0]), (None, [9.0, 9.0, 9.0])]
    twice = [(0, [5.0, 0.0, 0.0]), (4, good[4][1])]
    df = spark.createDataFrame([(*r, "x") for r in good + bad + twice], "id long, vector array<float>, name string")
    lists = nearest(spark, df, df.where("id % 20 = 0")).collect()
    # id 0 stands for two vectors, with a list for each; the repeated row of id 4 counts once
    by_rank = sorted((r["rank"], r.vec_id) for r in lists)
    assert {r.query_id for r in lists} == {0} and len(lists) == 16 and by_rank[:2] == [(1, 2), (1, 5)] or by_rank[:2] == [(1, 1), (1, 2)]
    assert not {r.vec_id for r in lists} & {0, 20, 40, 60, 80, 100, 120, 140, None}
    wide = df.select("id", F.col("vector").cast("array<double>").alias("vector"))
    assert sorted(map(tuple, nearest(spark, wide, wide.where("id % 20 = 0")).collect())) == sorted(map(tuple, lists))
    assert nearest(spark, df.limit(0), df.limit(0)).collect() == [] and nearest(spark, df, df.where("id = 60")).collect() == []
    assert nearest(spark, df.where("id = 1"), df.where("id = 1")).collect() == []


def test_parts_are_searched_exactly_whatever_the_scale():
    """A part's answers are the best of the leaves each query visits, with copies, ties and tiny or huge numbers."""
    import pyarrow as pa

    from veilmark.llm import forest_kernels as kernels

    r = np.random.default_rng(5)
    for scale in (1.0, 1e-18, 1e25):
        x = r.normal(size=(900, 8)) * scale
        x[40:80], x[100:140] = x[0], x[0] * (1 + 1e-12)  # equal, and equal but in the last places
        leaf = r.integers(0, 12, 900)
        ids = [sorted(r.choice(10_000, r.integers(1, 6), replace=False).tolist()) for _ in range(900)]
        q = np.vstack([x[0], r.normal(size=(29, 8)) * scale])
        visits = [sorted(r.choice(14, r.integers(1, 13), replace=False).tolist()) for _ in range(30)]
        names = [bytes([k]) for k in range(30)]
        left = pa.table({"leaf": pa.array(leaf, pa.int32()), "ids": pa.array(ids, pa.list_(pa.int64())), "vector": pa.array(x.tolist())})
        right = pa.table({"name": pa.array(names, pa.binary()), "vector": pa.array(q.tolist()), "leaves": pa.array(visits, pa.list_(pa.int32()))})
        out = kernels.reranker(7)(left, right)
        got = {n: [(f["worse"], f["id"]) for f in v] for n, v in zip(out["name"].to_pylist(), out["found"].to_pylist())}
        for k in range(30):
            want = sorted((-s, i) for row in np.flatnonzero(np.isin(leaf, visits[k])) for s in [(x[row] * q[k]).sum()] for i in ids[row])[:7]
            assert got.get(names[k], []) == want
        # lists of one name from several parts, with what they share once
        batch = out.to_batches()[0]
        (merged,) = kernels.merger(5, flush=20)([batch, batch.slice(3), batch])
        assert {n: [(f["worse"], f["id"]) for f in v] for n, v in zip(merged["name"].to_pylist(), merged["found"].to_pylist())} == {n: sorted(set(v))[:5] for n, v in got.items()}


def test_executors_need_no_package_for_the_forest():
    import pickle
    import pickletools

    from veilmark.llm import forest_kernels as kernels

    sample = np.random.default_rng(1).normal(size=(200, 6))
    forest = kernels.fit(sample, 2, 3, float((sample**2).sum(axis=1).max()), 0)
    assert not any("veilmark" in str(arg) for _, arg, _ in pickletools.genops(pickle.dumps(forest.state())))
    again = kernels.Forest(*forest.state())
    assert (again.leaves_of(sample) == forest.leaves_of(sample)).all()
    # the first leaf visited of a tree is where a query falls; all leaves are visited once
    order = forest.order(sample[:5])
    assert (np.sort(order, axis=1) == np.arange(16)).all()
