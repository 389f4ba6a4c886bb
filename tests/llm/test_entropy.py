"""Window entropy against a recount of every window, in time linear in the token, and secrets that only entropy finds."""

import collections
import math
import random
import re
import time

from pyspark.sql import functions as F

from veilmark.llm import secrets


def recount(text, window):
    best = -1.0
    for i in range(len(text) - window + 1):
        best = max(best, math.log2(window) - sum(n * math.log2(n) for n in collections.Counter(text[i : i + window]).values()) / window)
    return best


def test_every_window(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(secrets.ALPHABET[:k]) for _ in range(n)) for k, n in ((3, 19), (3, 20), (2, 50), (67, 60), (67, 300), (1, 40), (30, 21), (5, 7), (67, 7))] + [""]
    for window in (20, 7, 1, 33):
        got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(secrets.window_entropy(F.col("t"), window).alias("e")).collect()]
        assert all(abs(a - recount(t, window)) < 1e-9 for a, t in zip(got, texts, strict=True)), window


def token(n, seed=0):
    r = random.Random(seed)
    return "".join(r.choice(secrets.ALPHABET) for _ in range(n))


def test_long_tokens(spark):
    """One token of 64,000 and one of a million characters, found and redacted; and a long slug of words, which is none."""
    docs = spark.createDataFrame([(1, f"see {token(64_000)} end"), (2, f"see {token(1_000_000)} end"), (3, "word/" * 200_000 + "12")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.spans for r in secrets.secret_spans(docs).collect()}
    assert got == {1: "entropy:4:64004", 2: "entropy:4:1000004", 3: ""}
    shown = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    assert shown[1] == shown[2] == "see [SECRET] end" and len(shown[3]) == 1_000_002
    assert time.time() - began < 120


def test_slugs_are_allowed(spark):
    """The last allow pattern, which has no group, fits what words between single separators fit."""
    plain = re.compile(r"^/?([A-Za-z]+[/_-])*[A-Za-z]*[0-9]{0,4}/?$")
    r = random.Random(2)
    texts = ["".join(r.choice("ab/_-19") for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(secrets.SecretParams().allow[2]).alias("ok")).collect()
    assert all(x.ok == bool(plain.match(x.t)) for x in got if len(x.t) > 2), [(x.t, x.ok) for x in got if x.ok != bool(plain.match(x.t))][:9]


def test_only_entropy_finds(spark):
    """Random tokens without a base pattern among words, slugs, dates, UUIDs and numbers: precision and recall."""
    r = random.Random(7)
    rows = []
    for i in range(60):
        rows.append((i, f"deploy with {token(32, i)}1a today"))
        word = "/".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(8))
        rows.append((1000 + i, r.choice([f"path {word}/{i}", f"id 123e4567-e89b-12d3-a456-4266141740{i:02d}", f"run 2024-01-0{i % 9}/2024_02_11/000{i}", f"name {'_'.join(['value'] * 6)}{i}", "plain words only"])))
    got = {x.doc_id: x.n_entropy for x in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] > 0 for i in range(60)) >= 57 and not any(n for i, n in got.items() if i >= 1000)


def test_empty_table(spark):
    assert secrets.secret_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
