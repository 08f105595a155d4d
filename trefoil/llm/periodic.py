"""Periodic runs of words, caught online.

A *catcher* stands over each completed block of L = 1, 2, 4, ... words (blocks of L words start at multiples of L) and waits
for the block to come again 2 L to 4 L words later (1 to 3 words for L = 1). Every square of period p has such a block, of the
one L with 2 L <= p < 4 L, inside its first half. When the appended word completes a return at distance p, the comparison
is carried to the left at once (less than 2 L words) and one word to the right with each further word. As soon as 2 p words
agree, a square is reported; all squares of one comparison are one run, which is closed by the first word that differs.
A return inside a longer comparison whose period divides p is that comparison over again and is not followed.

Only four blocks of each size are watched at a time, and a word meets only those that end in the same word, so a text of
n words costs about n dictionary look-ups and log(n) comparisons a word at worst. A document is one row and is read whole in
one task: memory grows with the longest text (some 30 bytes a word), not with the table. Nothing is shuffled or broadcast.

Defined cases: a null, empty or blank text has no words and no runs; a very long text is treated whole; runs may overlap and
are ordered by start, then period (no two share both); rows that repeat a doc_id or a text are rows of their own; a
null doc_id is never edited by the query; an empty table gives no rows; further columns are kept, and a column named
``_periodic`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from trefoil.llm import common as C

#: A run of the query has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Rows turned into Arrow at a time.
ROWS = 256
_WORD = re.compile(C.WORD)
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Catchers:
    """The online state of one text: append words, then ``close``."""

    def __init__(self) -> None:
        self.codes: dict[str, bytes] = {}
        self.seen: list[bytes] = []
        self.text = bytearray()
        #: Period -> first word of the stretch that still agrees with itself so many words before.
        self.live: dict[int, int] = {}
        #: Last word of a block -> {(first word, L): block}.
        self.waiting: dict[bytes, dict[tuple[int, int], bytes]] = {}
        #: (start, period) of the first square of each run, in the order of their last words.
        self.squares: list[tuple[int, int]] = []
        self.runs: list[tuple[int, int, int]] = []

    def extend(self, words: Iterable[str]) -> None:
        codes, seen, text, live, waiting = self.codes, self.seen, self.text, self.live, self.waiting
        at = len(seen)
        for word in words:
            code = codes.get(word)
            if code is None:
                code = codes[word] = len(codes).to_bytes(4, "little")
            seen.append(code)
            text += code
            if live:
                self._advance(at, code)
            for period in (1, 2, 3):
                if period <= at and seen[at - period] is code and period not in live:
                    self._follow(at - period, period, at)
            for (first, size), block in waiting.get(code, {}).items():
                period = at + 1 - size - first
                if 2 * size <= period < 4 * size and period not in live and text.startswith(block, 4 * (at + 1 - size)):
                    self._follow(first, period, at)
            at += 1
            size = 2
            while at % size == 0:
                first = at - size
                waiting.setdefault(code, {})[first, size] = bytes(text[4 * first:])
                old = first - 4 * size
                if old >= 0:
                    del waiting[seen[old + size - 1]][old, size]
                size *= 2

    def _follow(self, first: int, period: int, at: int) -> None:
        """Words ``first`` and on came again ``period`` words later, up to word ``at``."""
        live, seen = self.live, self.seen
        for shorter, start in live.items():
            if start <= first and period % shorter == 0:
                return
        while first and seen[first - 1] is seen[first - 1 + period]:
            first -= 1
        live[period] = first
        if at + 1 - first >= 2 * period:
            self.squares.append((first, period))

    def _advance(self, at: int, code: bytes) -> None:
        seen, ended = self.seen, []
        for period, first in self.live.items():
            if seen[at - period] is not code:
                ended.append(period)
            elif at + 1 - first == 2 * period:
                self.squares.append((first, period))
        if ended:
            self._end(ended, at)

    def _end(self, periods: list[int], at: int) -> None:
        """These comparisons end before word ``at``. One whose length holds two periods is a run, unless a divisor of its
        period has the same stretch."""
        live = self.live
        for period in periods:
            first = live[period]
            if at - first >= 2 * period and not any(p < period and period % p == 0 and live[p] == first for p in live):
                self.runs.append((first, at - first, period))
        for period in periods:
            del live[period]

    def close(self) -> list[tuple[int, int, int]]:
        """All runs as (start, length, period), by start and period."""
        self._end(list(self.live), len(self.seen))
        self.runs.sort(key=lambda r: (r[0], r[2]))
        return self.runs


def runs_of(words: list[str], least_words: int = 2, least_periods: float = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with at least so many words and periods (two periods make a run)."""
    state = Catchers()
    state.extend(words)
    return [r for r in state.close() if r[1] >= max(least_words, least_periods * r[2])]


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without what a run holds after its first period."""
    if not runs:
        return words
    change = [0] * (len(words) + 1)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept, depth = [], 0
    for word, step in zip(words, change):
        depth += step
        if not depth:
            kept.append(word)
    return kept


def periodic(docs: DataFrame, least_words: int = 2, least_periods: float = 2) -> DataFrame:
    """``docs`` with a struct ``_periodic``: the runs of the text's words, and the collapsed text (its kept words joined by
    one space)."""
    if least_periods < 2:
        raise ValueError(f"a run has two periods at least, not {least_periods}")
    docs = docs.drop("_periodic")
    kind = f"struct<runs:array<{RUN}>,collapsed:string>"
    field = StructType.fromDDL(f"_periodic {kind}")["_periodic"]
    out, arrow = StructType([*docs.schema.fields, field]), to_arrow_type(field.dataType)
    names, place = out.names, docs.columns.index("text")

    def found(text: str | None) -> dict:
        words = _WORD.findall(text or "")
        runs = runs_of(words, least_words, least_periods)
        return {"runs": [dict(zip(("start", "length", "period"), r)) for r in runs], "collapsed": " ".join(collapse(words, runs))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                result = pa.array([found(t.as_py()) for t in part.column(place)], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, result], names)

    return docs.mapInArrow(run, out)


def strongest(runs: Column) -> Column:
    """The run with the greatest length for its period; ties go to the smaller start, then period. Null without runs."""

    def order(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        first = (left > right) | ((left == right) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
        return F.when(first, -1).otherwise(1)

    return F.get(F.array_sort(runs, order), 0)


def edited(docs: DataFrame) -> Column:
    """The query's text: for one doc_id in ten the words from a place on repeat with a period, both from crc32(doc_id)."""
    code = F.crc32(docs["doc_id"].cast("string"))
    turn = F.floor(code / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        place = F.struct((turn % n).cast("int").alias("a"))
        period = lambda a: (1 + F.floor((n - a) / (3 + turn % 8))).cast("int")
        return C.let(place, lambda s: C.let(F.struct(s["a"].alias("a"), period(s["a"]).alias("p")), lambda s: F.transform(
            words, lambda word, i: F.when(i < s["a"], word).otherwise(F.get(words, s["a"] + (i - s["a"]) % s["p"])))))

    text = C.text_of(docs)
    again = C.let(C.words(text), lambda words: F.when(F.size(words) > 0, F.array_join(repeat(words), " ")).otherwise(""))
    return F.when(code % 10 == 0, again).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    found = periodic(docs.select("doc_id", edited(docs).alias("text")), LEAST_WORDS, LEAST_PERIODS)
    runs = F.col("_periodic.runs")
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    best = found.withColumn("_best", strongest(runs))
    return best.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("_periodic.collapsed"), 256).alias("collapsed_sha256"))
