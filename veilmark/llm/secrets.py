"""Secret scan: fixed credential patterns plus sliding-window Shannon entropy.

Candidate strings are long runs of one token alphabet with a digit and a letter.  A window slides over each; its character counts are carried
along and changed by the character that enters and the one that leaves, and so is the sum of c log2 c over them, so a step costs the
same whatever the candidate's length and the window's.  A candidate whose best window reaches the
threshold of its character class (hexadecimal or base64) is a secret unless an allow-list pattern fits it or a
fixed pattern already covers part of it.

Defined results: a null text is empty and has no spans; a null doc_id stays null; repeated rows each give a row;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

# The credential patterns and the least lengths of their matches.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "entropy")

_TOKEN = "A-Za-z0-9+/_=-"
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
CANDIDATE = rf"(?<![{_TOKEN}])(?=[A-Za-z+/_=-]*+[0-9])[{_TOKEN}]{{20,}}+"


@dataclass(frozen=True)
class SecretParams:
    window: int = 20
    hex_bits: float = 2.9
    base64_bits: float = 3.7
    #: candidates that fit one of these are no secrets: UUIDs, dates and numbers, paths and slugs of plain words
    allow: tuple[str, ...] = (
        r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
        r"^[0-9/_=+-]+$",
        # words between single separators; without groups, which Java matches by recursion
        r"^(?!.*[/_-]{2}.)(?!.*[/_-][_-]$)/?(?![/_-])[A-Za-z/_-]*+[0-9]{0,4}/?$",
    )


def _codes(text: Column) -> Column:
    """The place of each character in the token alphabet; all characters outside it share the one behind."""
    place = F.create_map(*[F.lit(x) for i, c in enumerate(ALPHABET) for x in (c, i)])
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(place, c), F.lit(len(ALPHABET))))


def window_entropy(text: Column, window: int) -> Column:
    """Largest Shannon entropy (bits a character) of any window of the text, by incremental counts; -1 for shorter texts.

    The text is split once.  What is carried from character to character are the window's counts, packed into a few whole numbers, and the sum of
    c log2 c over them: the character that enters and the one that leaves change a count each, and the sum by what that count adds.
    """
    # f[c] = c log2 c; the entropy of a window of n characters is log2 n - sum f[c] / n
    f = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    bits = (window + 1).bit_length()
    each = 60 // bits  # counts in one whole number
    words = -(-(len(ALPHABET) + 1) // each)
    shift = lambda code: (code % each) * bits

    def count(held: Column, code: Column) -> Column:
        moved = F.call_function("shiftright", F.get(held, F.floor(code / each).cast("int")), shift(code))
        return moved.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def added(held: Column, code: Column, sign: int) -> Column:
        one = F.call_function("shiftleft", F.lit(sign).cast("long"), shift(code))
        return F.transform(held, lambda v, j: F.when(j == F.floor(code / each), v + one).otherwise(v))

    def step(acc: Column, x: Column) -> Column:
        out = count(acc["held"], x["out"])
        less = acc["sum"] + F.coalesce(F.get(f, out - 1) - F.get(f, out), F.lit(0.0))
        had = count(acc["held"], x["code"]) - F.coalesce((x["code"] == x["out"]).cast("int"), F.lit(0))
        more = less + F.get(f, had + 1) - F.get(f, had)
        held = F.when(x["out"].isNull(), acc["held"]).otherwise(added(acc["held"], x["out"], -1))
        full = F.when(acc["i"] + 1 >= window, F.lit(math.log2(window)) - more / window).otherwise(-1.0)
        return F.struct(added(held, x["code"], 1).alias("held"), more.alias("sum"), (acc["i"] + 1).alias("i"), F.greatest(acc["best"], full).alias("best"))

    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("held"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1.0).alias("best"))
    moves = lambda codes: F.transform(codes, lambda c, i: F.struct(c.alias("code"), F.get(codes, i - window).alias("out")))
    best = spans.bound(_codes(text), lambda codes: F.aggregate(moves(codes), zero, step, lambda acc: acc["best"]))
    return F.when(F.length(text) >= window, best).otherwise(-1.0)


def find_secrets(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """docs with secret_assign, secret_access, secret_hex and secret_entropy (arrays of spans) added."""
    p = params
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumn("secret_assign", spans.matches(text, ASSIGN, lambda h: F.length(F.regexp_extract(h, ASSIGN, 1)) >= ASSIGN_LEAST))
    docs = docs.withColumn("secret_access", spans.matches(text, ACCESS)).withColumn("secret_hex", spans.matches(text, HEX))
    docs = docs.withColumn("secret_entropy", spans.matches(text, CANDIDATE))

    def random(s: Column) -> Column:
        hit = s["hit"]
        allowed = F.lit(False)
        for pattern in p.allow:
            allowed = allowed | hit.rlike(pattern)
        base = spans.overlaps(s, F.col("secret_assign")) | spans.overlaps(s, F.col("secret_access")) | spans.overlaps(s, F.col("secret_hex"))
        hexed = window_entropy(F.lower(hit), p.window) >= p.hex_bits
        wide = window_entropy(hit, p.window) >= p.base64_bits
        return F.when(allowed | base | ~hit.rlike("[A-Za-z]"), F.lit(False)).otherwise(F.when(hit.rlike("^[0-9a-fA-F]+$"), hexed).otherwise(wide))

    return docs.withColumn("secret_entropy", F.filter("secret_entropy", random))


def secret_spans(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    found = find_secrets(docs.select("doc_id", "text"), params)
    kinds = [spans.tagged(F.col(f"secret_{k}"), i, k, by_start=True) for i, k in enumerate(KINDS)]
    found = found.select("doc_id", *[F.size(f"secret_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.concat(*kinds[:3]).alias("base"), kinds[3].alias("more"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans.listed(F.concat("base", "more")).alias("spans"), "n_entropy")


def redact_secrets(docs: DataFrame, params: SecretParams = SecretParams(), mark: str = "[SECRET]") -> DataFrame:
    """docs whose text has every span, overlapping ones joined, replaced by the mark; other columns stay."""
    columns = docs.columns
    found = find_secrets(docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")), params)
    every = F.array_sort(F.concat(*[F.transform(f"secret_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]))
    found = found.withColumn("secret_all", every)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        before = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(acc["out"], F.array(before, F.lit(mark)))).otherwise(acc["out"]).alias("out"))

    rest = F.aggregate("secret_all", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    found = found.withColumn("text", F.when(F.size("secret_all") > 0, rest).otherwise(F.col("text")))
    return found.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns])
