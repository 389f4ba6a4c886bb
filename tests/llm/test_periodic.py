"""Periodic runs against a comparison of every word with every other."""

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilmark.llm import queries, run_kernels
from veilmark.llm.periodic import RunParams, periodic_runs, strongest


def brute(words, least=24, times=3):
    """(start, length, period) of all runs: for each period the stretches where words that far apart are equal."""
    ids = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words])
    best = {}
    for q in range(1, len(a) // times + 1):
        same = np.concatenate(([0], a[:-q] == a[q:], [0])).astype(int)
        edges = np.flatnonzero(np.diff(same))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s + q >= max(least, times * q):
                best.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(words, h):
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=12), st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(0, 60), st.lists(st.sampled_from("ab"), max_size=40), st.sampled_from([(24, 3), (6, 3), (8, 2), (5, 2)]))
def test_runs(head, period, n, tail, bounds):
    words = [w.encode() for w in head + [period[i % len(period)] for i in range(n)] + tail + period * 2]
    p = RunParams(*bounds)
    hashes = np.array([hash(w) for w in words], dtype=np.int64).view(np.uint64)
    assert run_kernels.runs_of(words, run_kernels.recurring(hashes, np.array([0, len(words)]), p.gram_words), p) == brute(words, *bounds)


def test_ordered_sets():
    r = np.random.default_rng(1)
    values = r.permutation(5000).tolist()
    ends, have = run_kernels.Ends(values[0]), [values[0]]
    for x in values[1:]:
        before = max((v for v in have if v < x), default=None) if len(have) < 900 else ...
        got = ends.add(x)
        assert before is ... or got[0] == before
        have.append(x)
    assert list(ends) == sorted(values) and len(ends.chunks) > 5


def test_long_texts():
    """A word a hundred thousand times, and a period of a third of the text: one run each, without quadratic work."""
    for n, q in ((100_000, 1), (60_000, 20_000)):
        base = [f"w{i}" for i in range(q)]
        assert run_kernels.find_runs([base[i % q] for i in range(n)], 24, 3) == {(0, n): q}


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert got.keys() == docs.keys()
    hit = 0
    for i, text in docs.items():
        words = planted(split(text), zlib.crc32(str(i).encode()))
        runs, r = brute(words), got[i]
        hit += bool(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{q}\n" for a, b, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert hit > len(docs) / 20


def test_edges(spark):
    rows = [(None, "x " * 30), (1, None), (2, ""), (3, " \t\n"), (4, "A a " * 20), (4, "A a " * 20), (5, "plain words only"), (6, "k v  " * 12 + "k"), (7, "\u001cq " * 24)]
    docs = spark.createDataFrame([(*r, "c", 9) for r in rows], "doc_id long, text string, runs string, n_words int")
    got = periodic_runs(docs).collect()
    show = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got)
    want = sorted((str(i), len(split(t)), brute(split(t)), collapsed(split(t), brute(split(t)))) for i, t in rows)
    assert show == want and periodic_runs(docs.limit(0)).collect() == []


def test_strongest(spark):
    kind = "array<struct<start:long,length:long,period:long>>"
    rows = [([(0, 24, 8), (30, 30, 10), (90, 31, 10)],), ([(5, 24, 8), (5, 48, 16)],), ([],)]
    got = [tuple(r.b) if r.b else None for r in spark.createDataFrame(rows, f"r {kind}").select(strongest(F.col("r")).alias("b")).collect()]
    assert got == [(90, 31, 10), (5, 24, 8), None]
