"""Match positions in code points from SQL functions alone.

``split`` with limit -1 gives the text between the matches of a pattern and ``regexp_extract_all`` the matches;
running sums of both lengths are the positions.  Sums run inside blocks of matches and over the blocks, so that
no array grows by one match at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,hit:string,gap:string>>"


_BLOCK = 128


def matches(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, end, hit, gap>> of the leftmost non-overlapping matches that pass keep(hit);
    gap is the text between a match and the one before it.  Texts without a match cost one regex pass."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), lambda x: x["hit"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["gap"].alias("gap")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    def placed(at: Column, some: Column) -> Column:
        return F.aggregate(some, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    def blocks(both: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(both), F.lit(_BLOCK)), lambda at: F.slice(both, at, F.lit(_BLOCK)))
        wide = F.transform(cut, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"])))
        starts = F.aggregate(wide, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        return F.flatten(F.transform(F.arrays_zip(cut.alias("block"), F.slice(starts, 1, F.size(wide)).alias("at")), lambda x: placed(x["at"], x["block"])))

    found = bound(both, lambda b: F.when(F.size(b) <= _BLOCK, placed(F.lit(0), b)).otherwise(blocks(b)))
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["hit"]))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def tagged(spans: Column, order: int, kind: str, by_start: bool) -> Column:
    """Spans as structs that sort by (start, kind order) or (kind order, start)."""
    keys = ["start", "rank"] if by_start else ["rank", "start"]

    def one(s: Column) -> Column:
        parts = {"start": s["start"].alias("start"), "rank": F.lit(order).alias("rank")}
        return F.struct(*[parts[k] for k in keys], s["end"].alias("end"), F.lit(kind).alias("kind"))

    return F.transform(spans, one)


def listed(spans: Column) -> Column:
    """kind:start:end of sorted tagged spans, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps(s: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
