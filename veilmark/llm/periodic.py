"""Periodic runs: stretches of words that repeat with some period, found by a suffix automaton.

The automaton of a text's words is built once; end positions move up its suffix links in ordered sets, smaller sets into larger ones, and
each pair of neighbours that is new in a state whose length reaches their distance is the seed of a square, which is extended
to a run: a stretch with a smallest period, of ``least_words`` words and ``least_periods`` periods or more, that no neighbouring word extends.

A run of 24 words and three periods repeats each of its words inside a stretch of 16 words that occurs twice, one period apart.  So automata are
built only over stretches of words that lie in such; what lies outside can be in no run.  Sixteen-word stretches are compared by hash, which can
only let in more words; the automaton itself compares words.

Memory: a text is one row and its automaton is built in one task, a few hundred bytes for each word of its longest recurring stretch.

Defined results: a null or blank text has no words and no runs and collapses to the empty text; words of one run that another still
needs are dropped too if either drops them; repeated rows each give a row; a null doc_id stays null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import run_kernels as kernels
from .spans import bound
from .staging import ship

ship(kernels, __name__)

WORD = r"[^\x20\x09-\x0D]+"  # fixed value


@dataclass(frozen=True)
class RunParams:
    least_words: int = 24
    least_periods: int = 3

    @property
    def gram_words(self) -> int:
        """The largest power of two that every run repeats as a whole: two thirds of the least length."""
        common = self.least_words - self.least_words // self.least_periods
        return 1 << (max(1, common).bit_length() - 1)


def periodic_runs(docs: DataFrame, params: RunParams = RunParams()) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period), collapsed (the text without repetitions)
    of each row of docs(doc_id, text)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([rows.schema.fields[0], *StructType.fromDDL(f"n_words long, runs {kernels.RUNS}, collapsed string").fields])
    return rows.mapInArrow(kernels.finder(params), schema)


def strongest(runs: Column) -> Column:
    """The run with the most periods (exactly compared); ties go to the smaller start, then period; null without runs."""
    better = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"])
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best)))


def planted(text: Column, number: Column) -> Column:
    """The text, or for every tenth number its words from some place on as a repetition: word i as word a + (i - a) mod p."""
    g = F.floor(number / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        times = F.ceil((n - a) / p)
        tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times.cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int"))), " ")).otherwise(text)

    return F.when(number % 10 == 0, bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), repeat)).otherwise(text)
