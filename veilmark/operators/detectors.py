"""Span detectors as plug-ins: what finds personal values in a text, by name, for detection, sanitising and the guard, and as a table function in SQL.

A detector is a function from a text to (start, end, type) in code points with a hint, a pattern without which a text holds none of
its spans; texts that fit no hint never leave the JVM.  Of overlapping spans those of the detector named first stay, and of one detector's
own the earlier and then the longer; empty spans and such beyond the text are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult

from ..functions import patterns as P

SPANS = "array<struct<start:int,end:int,entity_type:string>>"
_SPAN_FIELDS = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("entity_type", T.StringType())]
_SPANS = T.ArrayType(T.StructType(_SPAN_FIELDS))

Span = tuple[int, int, str]


@dataclass(frozen=True)
class Detector:
    name: str
    find: Callable[[str], Iterable[Span]]
    #: Java regular expression; None: any text may hold a span
    hint: str | None = None


#: every pattern needs an @, a digit, or the two colons of an IPv6 address of letters
PATTERNS = Detector("patterns", P.detect_spans, r"@|(?U)\d|:[0-9A-Fa-f]{0,4}:")
REGISTRY: dict[str, Detector] = {"patterns": PATTERNS}


def register(detector: Detector) -> Detector:
    """Makes a detector known by its name; a name can't be taken twice by unlike detectors."""
    if REGISTRY.setdefault(detector.name, detector) != detector:
        raise ValueError(f"there is another detector named {detector.name}")
    return detector


def pattern_detector(name: str, entity_type: str, pattern: str) -> Detector:
    """A detector of a regular expression that Python and Java read alike."""
    compiled = re.compile(pattern)
    return Detector(name, lambda text: ((m.start(), m.end(), entity_type) for m in compiled.finditer(text)), f"(?U){pattern}")


def listed_detector(name: str, values: dict[str, str]) -> Detector:
    """A detector of whole words or phrases, each with its type; upper and lower case are told apart, longer phrases win."""
    ordered = sorted(values, key=lambda v: (-len(v), v))
    compiled = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, ordered)) + r")(?!\w)")
    return Detector(name, lambda text: ((m.start(), m.end(), values[m[0]]) for m in compiled.finditer(text)), None)


def known(detectors: Sequence[Detector | str]) -> list[Detector]:
    """The detectors, given as such or by name."""
    unknown = [d for d in detectors if isinstance(d, str) and d not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown detectors: {', '.join(unknown)}")
    return [REGISTRY[d] if isinstance(d, str) else d for d in detectors]


def merged(detectors: Sequence[Detector], text: str | None) -> list[Span]:
    """Non-overlapping spans in order of their start."""
    taken: list[Span] = []
    for detector in detectors:
        for start, end, kind in sorted(detector.find(text) if text else (), key=lambda s: (s[0], -s[1])):
            if 0 <= start < end <= len(text) and not any(start < e and s < end for s, e, _ in taken):
                taken.append((start, end, kind))
    return sorted(taken)


def maybe(text: Column, detectors: Sequence[Detector]) -> Column:
    """Whether a text may hold a span."""
    hints = [d.hint for d in detectors]
    fits = F.lit(True) if None in hints else F.lit(False)
    for hint in hints:
        fits = fits if hint is None else fits | text.rlike(hint)
    return F.coalesce(fits & text.isNotNull(), F.lit(False))


def spans(text: Column, detectors: Sequence[Detector | str] = ("patterns",)) -> Column:
    """Array of spans of a text; none of null."""
    wanted = known(detectors)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "entity_type": k} for a, b, k in merged(wanted, t)])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    found = F.pandas_udf(run, _SPANS)(F.when(maybe(text, wanted), text))
    return F.coalesce(found, F.array().cast(SPANS))


def register_table_function(spark: SparkSession, name: str = "find_spans") -> None:
    """``SELECT * FROM find_spans(TABLE(t), 'column', 'patterns,names')``: the table's columns, then start, end and entity_type, a row for each span.

    The columns follow the table given; detectors are those registered when this is called.
    """
    registry = dict(REGISTRY)

    class FindSpans:
        def __init__(self) -> None:
            self.detectors: dict[str, list[Detector]] = {}

        @staticmethod
        def analyze(table: AnalyzeArgument, column: AnalyzeArgument, detectors: AnalyzeArgument) -> AnalyzeResult:
            wrong = [d for d in detectors.value.split(",") if d not in registry]
            if wrong or column.value not in table.dataType.names:
                raise ValueError(f"unknown detectors {wrong}" if wrong else f"no column {column.value}")
            return AnalyzeResult(T.StructType([*table.dataType.fields, *_SPAN_FIELDS]))

        def eval(self, table: T.Row, column: str, detectors: str) -> Iterator[tuple]:
            wanted = self.detectors.setdefault(detectors, [registry[d] for d in detectors.split(",")])
            for span in merged(wanted, table[column]):
                yield (*table, *span)

    spark.udtf.register(name, F.udtf(FindSpans))
