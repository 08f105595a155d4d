"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds a row) and selectivity (share rejected) are estimated on a bounded sample, read REPEATS times in
one task; the time of the same job without the rule is subtracted, so that job start and reading don't count. Rules then run in the order of rejection per cost as one CASE, whose later branches are not computed for a rejected row. The order changes
the time only: a row is kept if it passes all rules.

Base columns are always returned. Words covered by repeated 3-word windows are found by sorting the windows' 64-bit
hashes within the row. Defined cases: a null, empty or blank text has no words and fails the base; repeated rows are
judged alike; an empty table gives no rows (and the rules keep their given order); further columns are passed by.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trefoil.llm import common as C

SAMPLE_ROWS = 1000
REPEATS = 20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    name: str
    passes: Column


def repeat_words(found: Column) -> Column:
    """How many words stand in 3-word windows that occur twice or more in ``found``."""

    def counted(all_words: Column) -> Column:
        n = F.size(all_words)
        windows = F.when(n >= 3, F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(all_words, i), F.get(all_words, i + 1), F.get(all_words, i + 2)),
        )).otherwise(F.array().cast("array<bigint>"))
        return C.let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        starts = C.let(ordered, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"])))
        # A window adds three words, or fewer if the next one starts within it.
        return C.let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3))), F.lit(0), lambda a, x: a + x))

    return C.let(found, counted)


def base(docs: DataFrame) -> DataFrame:
    """``docs`` with the base columns and base_failed."""
    rows = docs.withColumn("_text", C.text_of(docs))
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(C.WORD))
    both = C.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counts = C.let(C.words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    rows = rows.withColumn("_counts", counts).withColumns({
        "n_words": F.col("_counts.n").cast("long"),
        "word_chars": F.char_length(F.regexp_replace(text, C.SPACE + "+", "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": both.cast("long"), "n_repeat_words": F.col("_counts.r").cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("_counts")


def rules() -> list[Rule]:
    """The method's rules over the base columns and ``_text``, all in whole numbers."""
    n, text = F.col("n_words"), F.col("_text")
    gone = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") <= 3 * n),
        Rule("word_length", (2 * F.col("word_chars") >= 5 * n) & (F.col("word_chars") <= 14 * n)),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") <= 5 * F.size(F.split(text, "\n"))),
        Rule("shouting", 10 * gone("[A-Z]+") <= 5 * gone("[A-Za-z]+")),
        Rule("exclaiming", 10 * gone("!+") <= 5 * n),
        Rule("letters", 10 * gone(r"\p{L}+") >= 5 * F.col("word_chars")),
    ]


def estimate(sample: DataFrame, todo: list[Rule], repeats: int = REPEATS) -> dict[str, tuple[float, float]]:
    """Seconds and rejections a row of each rule on the stored ``sample``."""
    n = max(1, sample.count()) * repeats
    rows = sample.coalesce(1).withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    read = F.sum(F.octet_length("_text")).alias("read")  # the empty job reads the texts too

    def timed(*found: Column) -> tuple[float, int]:
        best, rejected = float("inf"), 0
        for _ in range(3):  # the first time includes code generation
            at = time.perf_counter()
            rejected = rows.agg(read, *found).first()[-1] or 0
            best = min(best, time.perf_counter() - at)
        return best, rejected

    empty, _ = timed(F.count(F.lit(1)).alias("n"))
    out = {}
    for rule in todo:
        took, rejected = timed(F.sum(F.when(rule.passes, 0).otherwise(1)).alias("n"))
        out[rule.name] = (max(0.0, took - empty) / n, rejected / n)
    return out


def ordered(todo: list[Rule], found: dict[str, tuple[float, float]]) -> list[Rule]:
    """Rules by rejection per cost, the most first; ties keep the given order."""
    return sorted(todo, key=lambda r: -found[r.name][1] / max(found[r.name][0], 1e-9))


def cascade(docs: DataFrame, todo: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """``docs`` with base columns, base_failed and kept."""
    todo = rules() if todo is None else todo
    n = docs.count()
    part = docs.sample(min(1.0, 2.0 * sample_rows / max(n, 1)), seed).limit(sample_rows)
    sample = C.stored(base(part), "rules")
    order = ordered(todo, estimate(sample, todo))
    C.dropped(sample)
    rows = base(docs)
    kept = F.when(F.col("base_failed"), F.lit(False))
    for rule in order:
        kept = kept.when(~rule.passes, F.lit(False))
    return rows.withColumn("kept", kept.otherwise(F.lit(True))).drop("_text")


def op8_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cascade(C.documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
