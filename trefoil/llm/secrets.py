"""Secret scans: three base patterns, and sliding-window entropy over candidate strings, all in DataFrame functions.

Base kinds (``assign``, ``access``, ``hex``) are leftmost, non-overlapping matches over the whole text. The entropy scan
takes candidate strings (long runs of one character class), slides a window of WINDOW characters over each with
incremental counts, and joins windows whose Shannon entropy reaches the class's threshold into spans of kind
``entropy_hex`` or ``entropy_base64``. The allow-list acts at three places: windows that touch an allowed word (a
counted-up alphabet, "example" and the like) don't count, so a key joined to such a word is still found; candidates that
are UUIDs as a whole are passed over; and so are spans without digits or without letters. Of a span that meets base
spans the parts outside them stay; base spans always stay. Positions are code points, ends exclusive.

Defined cases: a null or empty text has no spans; a very long candidate is cut into blocks that overlap by a window, and
the time grows with n log n of a text's matches and characters; spans that start together are in the order of kinds;
repeated rows are scanned alike; an empty table gives no rows; further columns are passed by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trefoil.llm import common as C

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]

WINDOW = 20
#: Candidate pattern, alphabet and least entropy in bits a character.
CLASSES = {
    "entropy_hex": (r"[0-9A-F]{20,}", "0123456789ABCDEF", 3.0),
    "entropy_base64": (r"[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.75),
}
#: Characters of a candidate that one fold takes; blocks overlap by WINDOW - 1.
BLOCK = 256
#: Words that say a string is no secret, and a key that manuals print: blanked before candidates are cut.
WORDS = (
    "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "abcdefghijklmnopqrstuvwxyz", "abcdefghijkl", "0123456789",
    "example", "sample", "dummy", "placeholder", "changeme",
)
#: Candidates, and spans, that are no secrets: UUIDs; no digit or no letter.
ALLOWED = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
ALLOWED_SPANS = (r"[^0-9]*", r"[0-9+/_-]*")
#: Code points of a text that are cut out together, so that a piece is found without reading from the start.
CHUNK = 4096
#: Entropies are compared as whole numbers of 2^-20 bits, so that every engine decides alike.
UNIT = 1 << 20
_SPAN = "struct<start:int,kind:int,end:int>"


def terms() -> list[int]:
    """c * log2(c) for counts 0 to WINDOW, in units."""
    return [round(c * math.log2(c) * UNIT) if c else 0 for c in range(WINDOW + 1)]


def most(bits: float) -> int:
    """The largest sum of terms at which a window still has ``bits`` of entropy."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * UNIT)


def located(text: Column, pattern: str) -> Column:
    """All matches as ``start, end, hit``: running sums of the text between matches and of the matches give the places."""
    pieces, hits = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The piece after the last match has no hit.
    sizes = F.zip_with(pieces, hits, lambda p, h: F.struct(
        F.char_length(p).alias("gap"), F.coalesce(F.char_length(h), F.lit(0)).alias("size"), h.alias("hit")))

    def placed(x: Column) -> Column:
        ends = C.running(F.transform(x, lambda p: p["gap"] + p["size"]), lambda a, b: a + b)
        spans = F.zip_with(x, ends, lambda p, end: F.struct(
            (end - p["size"]).alias("start"), end.alias("end"), p["hit"].alias("hit")))
        return F.filter(spans, lambda s: s["hit"].isNotNull())

    return C.let(sizes, placed)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def base_spans(text: Column, kind: str) -> Column:
    none = F.array().cast(f"array<{_SPAN}>")
    if kind == "assign":
        values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
        long = F.zip_with(located(text, ASSIGN), values, lambda x, v: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), (F.char_length(v) >= 6).alias("ok")))
        return F.when(text.rlike(ASSIGN), _spans(F.filter(long, lambda x: x["ok"]), 0)).otherwise(none)
    if kind == "access":
        long = F.filter(located(text, ACCESS), lambda x: F.char_length(x["hit"]) >= 20)
        return F.when(text.contains("AKIA"), _spans(long, 1)).otherwise(none)
    return F.when(text.rlike(HEX), _spans(located(text, HEX), 2)).otherwise(none)


def hot_windows(codes: Column, alphabet: str, bits: float) -> Column:
    """``a, b`` of the joined windows of a candidate that reach ``bits``; ``codes`` are its characters' places in the class's
    alphabet. A step of the fold moves the window by one character: two counts change, and with them two terms of the sum.
    Counts are letters of a string, so that a step copies it and computes two of its places only."""
    table = F.array(*[F.lit(t) for t in terms()])
    zero = F.from_json(
        F.lit('{"n":0,"counts":"%s","sum":0,"runs":[]}' % ("A" * len(alphabet))),
        "struct<n:int,counts:string,sum:bigint,runs:array<struct<a:int,b:int>>>")
    count = lambda counts, code: F.ascii(F.substring(counts, code + 1, F.lit(1))) - 65
    with_count = lambda counts, code, k: F.overlay(counts, F.char(k + 65), code + 1, F.lit(1))

    def fold(block: Column, offset: Column) -> Column:
        def step(acc: Column, code: Column) -> Column:
            gone = F.when(acc["n"] >= WINDOW, F.get(block, acc["n"] - WINDOW))
            was, gone_was = count(acc["counts"], code), count(acc["counts"], gone)
            change = F.get(table, was + 1) - F.get(table, was) + F.coalesce(
                F.get(table, gone_was - 1) - F.get(table, gone_was), F.lit(0))
            same = F.coalesce(gone == code, F.lit(False))
            total = F.when(same, acc["sum"]).otherwise(acc["sum"] + change).cast("long")
            left = F.when(gone.isNull(), acc["counts"]).otherwise(with_count(acc["counts"], gone, gone_was - 1))
            counts = F.when(same, acc["counts"]).otherwise(with_count(left, code, was + 1))
            end, start = offset + acc["n"] + 1, offset + acc["n"] + 1 - WINDOW
            last = F.get(acc["runs"], F.size(acc["runs"]) - 1)
            grown = F.when(
                last.isNotNull() & (last["b"] >= start),
                F.concat(F.slice(acc["runs"], 1, F.greatest(F.size(acc["runs"]) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), end.alias("b")))),
            ).otherwise(F.concat(acc["runs"], F.array(F.struct(start.alias("a"), end.alias("b")))))
            hot = (acc["n"] + 1 >= WINDOW) & (total <= F.lit(most(bits)))
            return F.struct(
                (acc["n"] + 1).alias("n"), counts.alias("counts"), total.alias("sum"), F.when(hot, grown).otherwise(acc["runs"]).alias("runs"))

        return F.aggregate(block, zero, step)["runs"]

    def blocks(x: Column) -> Column:
        # A block holds the windows that end in it.
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(BLOCK)), lambda at: C.let(
            F.greatest(at - (WINDOW - 1), F.lit(0)), lambda first: C.let(
                F.slice(x, first + 1, at + BLOCK - first), lambda block: fold(block, first)))))

    def joined(runs: Column) -> Column:
        # Runs are in order by both ends; those of neighbouring blocks may meet.
        opens = F.filter(runs, lambda r, i: F.coalesce(F.get(runs, i - 1)["b"] < r["a"], F.lit(True)))
        closes = F.filter(runs, lambda r, i: F.coalesce(F.get(runs, i + 1)["a"] > r["b"], F.lit(True)))
        return F.zip_with(opens, closes, lambda r, s: F.struct(r["a"].alias("a"), s["b"].alias("b")))

    return C.let(codes, lambda x: C.let(blocks(x), joined))


def blanked(text: Column) -> Column:
    """The text with allowed words as blanks, places unchanged."""
    for word in WORDS:
        text = F.regexp_replace(text, f"(?i){word}", " " * len(word))
    return text


def entropy_spans(text: Column, kind: str) -> Column:
    pattern, alphabet, bits = CLASSES[kind]
    number = KINDS.index(kind)

    def runs(x: Column) -> Column:
        letters = F.filter(F.split(x["hit"], ""), lambda c: c != "")
        hot = hot_windows(F.transform(letters, lambda c: F.position(c, F.lit(alphabet)) - 1), alphabet, bits)
        telling = F.filter(hot, lambda w: C.let(
            F.substring(x["hit"], w["a"] + 1, w["b"] - w["a"]),
            lambda s: ~(s.rlike(f"^(?:{ALLOWED_SPANS[0]})$") | s.rlike(f"^(?:{ALLOWED_SPANS[1]})$"))))
        return F.transform(telling, lambda w: F.struct(
            (x["start"] + w["a"]).alias("start"), F.lit(number).alias("kind"), (x["start"] + w["b"]).alias("end")))

    found = F.filter(located(blanked(text), pattern), lambda x: ~x["hit"].rlike(f"^(?:{ALLOWED})$"))
    return F.when(text.rlike(pattern), F.flatten(F.transform(found, runs))).otherwise(F.array().cast(f"array<{_SPAN}>"))


def outside(spans: Column, base: Column, kind: int) -> Column:
    """The parts of ``spans`` (of one kind, apart from each other) that no span of ``base`` covers. Both give places where
    their depth changes; in order of places, running sums tell the depths of the piece that follows."""
    change = lambda at, own, other: F.struct(at.alias("at"), F.lit(own).alias("own"), F.lit(other).alias("other"))
    places = F.array_sort(F.concat(
        F.transform(spans, lambda x: change(x["start"], 1, 0)), F.transform(spans, lambda x: change(x["end"], -1, 0)),
        F.transform(base, lambda x: change(x["start"], 0, 1)), F.transform(base, lambda x: change(x["end"], 0, -1))))

    def pieces(p: Column) -> Column:
        depth = lambda name: C.running(F.transform(p, lambda x: x[name]), lambda a, b: a + b)
        cut = F.transform(F.arrays_zip(p.alias("p"), depth("own").alias("own"), depth("other").alias("other")), lambda x, i: F.struct(
            x["p"]["at"].alias("start"), F.get(p, i + 1)["at"].alias("end"), (x["own"] > 0).alias("own"), (x["other"] == 0).alias("free")))
        return F.transform(
            F.filter(cut, lambda x: x["own"] & x["free"] & (x["start"] < x["end"])),
            lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(C.let(places, pieces))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` (a sorted array of base spans) and ``_spans`` (all spans): start, kind, end."""
    rows = docs.withColumn("_text", C.text_of(docs))
    text = F.col("_text")
    rows = rows.withColumn("_base", F.array_sort(F.concat(*[base_spans(text, k) for k in KINDS[:3]])))
    for n, kind in enumerate(KINDS[3:]):
        rows = rows.withColumn(f"_added{n}", entropy_spans(text, kind))
    free = [outside(F.col(f"_added{n}"), F.col("_base"), n + 3) for n in range(len(CLASSES))]
    added = [f"_added{n}" for n in range(len(CLASSES))]
    return rows.withColumn("_spans", F.array_sort(F.concat("_base", *free))).drop("_text", *added)


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with ``mask`` for each of the sorted ``spans``; spans that overlap share one."""
    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))

    def cleaned(pieces: Column, upto: Column) -> Column:
        before = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0))
        # A span opens a mask if it starts at or after the ends of all before it.
        gaps = F.filter(F.transform(spans, lambda x, i: F.struct(before(i).alias("a"), x["start"].alias("b"))), lambda g: g["a"] <= g["b"])
        last = F.struct(F.element_at(upto, -1).alias("a"), F.lit(2**31 - 1 - CHUNK).alias("b"))

        def piece(g: Column) -> Column:
            first = F.floor(g["a"] / CHUNK).cast("int")
            many = F.least(F.floor(g["b"] / CHUNK).cast("int"), F.size(pieces)) - first + 1
            held = F.slice(pieces, first + 1, F.greatest(many, F.lit(0)))
            return F.array_join(F.transform(held, lambda c, i: C.let((first + i) * CHUNK, lambda at: F.substring(
                c, F.greatest(g["a"] - at, F.lit(0)) + 1, F.least(g["b"] - at, F.lit(CHUNK)) - F.greatest(g["a"] - at, F.lit(0))))), "")

        return F.array_join(F.transform(F.concat(gaps, F.array(last)), piece), mask)

    ends = C.running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    return C.let(chunks, lambda pieces: C.let(ends, lambda upto: cleaned(pieces, upto)))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mask``, and n_chars to match if there is such a column."""
    clean = F.when(F.size("_spans") > 0, masked(F.col("text"), F.col("_spans"), mask))
    found = scan(docs.select("text", F.struct(*docs.columns).alias("_row")))
    some = F.size("_spans") > 0
    row = F.when(some, F.col("_row").withField("text", clean)).otherwise(F.col("_row"))
    if "n_chars" in docs.columns:
        count = F.char_length(clean).cast(docs.schema["n_chars"].dataType)
        row = F.when(some, F.col("_row").withField("text", clean).withField("n_chars", count)).otherwise(F.col("_row"))
    return found.select(row.alias("_row")).select("_row.*")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id", count(0), count(1), count(2), F.sha2(spelled(F.col("_base")), 256).alias("base_sha256"),
        spelled(F.col("_spans")).alias("spans"))
