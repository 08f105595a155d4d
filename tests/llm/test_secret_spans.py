"""Secret scan: brute force over made-up texts, many matches in one text, spans that meet base spans; costs of rules."""

import math
import random
import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from trefoil.llm import cascade, oracles, secrets

KEY = "aB3dE5fG7hJ9kL2mN4pQ6rS8tU1vW0xY7zC5"
INNER = "0f1e2d3c4b5a69788796a5b4c3d2e1f0"


def _scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secrets.scan(docs).select("doc_id", secrets.spelled(F.col("_spans"))).collect()
    return [r[1] for r in sorted(rows)]


def _brute(text):
    base = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, text)]
    covered = {i for a, _, b in base for i in range(a, b)}
    blank = text
    for word in secrets.WORDS:
        blank = re.sub(f"(?i){word}", " " * len(word), blank)
    added = []
    for kind, (pattern, _, bits) in secrets.CLASSES.items():
        for m in re.finditer(pattern, blank):
            if re.fullmatch(secrets.ALLOWED, m[0]):
                continue
            hot = set()
            for w in range(len(m[0]) - secrets.WINDOW + 1):
                counts = Counter(m[0][w:w + secrets.WINDOW]).values()
                if sum(secrets.terms()[c] for c in counts) <= secrets.most(bits):
                    hot |= set(range(w, w + secrets.WINDOW))
            for run in _runs(hot):
                if not any(re.fullmatch(r, m[0][run[0]:run[1]]) for r in secrets.ALLOWED_SPANS):
                    added += [(a, secrets.KINDS.index(kind), b) for a, b in _runs({m.start() + i for i in range(*run)} - covered)]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + added))


def _runs(places):
    out = []
    for i in sorted(places):
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return out


def _texts():
    rng = random.Random(5)
    alphabet = secrets.CLASSES["entropy_base64"][1]
    made = lambda n, of=alphabet: "".join(rng.choices(of, k=n))
    texts = ["", "é " + KEY, f"{KEY}-sample", f"{KEY}/EXAMPLE {KEY}", f"{KEY}{INNER}{KEY[::-1]}", f"東 {KEY}AKIA{'Q' * 20} token={KEY}"]
    texts += [made(n) for n in (19, 20, 21, 255, 256, 257, 275, 276, 700, 2000)]
    texts += ["a" * 300 + made(40) + "b" * 300 + made(30), made(900, "0123456789ABCDEF"), "ab" * 400 + made(25)]
    for _ in range(40):
        texts.append(" ".join(rng.choice([made(rng.randint(3, 60)), made(30, "0123456789abcdef"), "api_key = " + made(30), "AKIA" + made(18, "ABC123"),
                                          "example", made(26, "abc"), "dummy" + made(30), "naïve"]) for _ in range(12)))
    return texts


def test_spans_equal_brute_force(spark):
    assert _scan(spark, _texts()) == [_brute(t) for t in _texts()]


def test_spans_equal_sql(spark):
    texts = _texts()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = con.execute(f"SELECT doc_id, spans FROM ({oracles.OP3}) ORDER BY doc_id").fetchall()
    assert [r[1] for r in got] == _scan(spark, texts)


def test_part_outside_a_base_span_is_found_and_redacted(spark):
    text = f"see {KEY}{INNER}{KEY[::-1]} end"
    kinds = [s.split(":")[0] for s in _scan(spark, [text])[0].split(",")]
    assert kinds == ["entropy_base64", "hex", "entropy_base64"]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.redact(docs).first()["text"] == "see [secret][secret][secret] end"


def test_key_joined_to_an_allowed_word_is_found(spark):
    one, two = _scan(spark, [f"see {KEY}-sample end", "see EXAMPLEKEY1234567890abcd end"])
    assert one.startswith("entropy_base64:4:") and two == ""


def test_masks_at_every_place(spark):
    rng = random.Random(1)
    for size in (1, 50, secrets.CHUNK - 1, secrets.CHUNK, secrets.CHUNK + 1, 3 * secrets.CHUNK):
        text = "".join(rng.choices("abé東𝄞", k=size))
        for many in (1, 3, 40):
            spans = sorted((a, 0, rng.randint(a + 1, size)) for a in (rng.randrange(size) for _ in range(many)))
            want, at = "", 0
            for a, _, b in spans:
                if a >= at:
                    want += text[at:a] + "#"
                at = max(at, b)
            row = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,kind:int,end:int>>")
            assert row.select(secrets.masked(F.col("t"), F.col("s"), "#")).first()[0] == want + text[at:]


def test_many_matches_in_one_text(spark):
    times = []
    for many in (12_500, 50_000):
        text = f"{KEY} {INNER} token=abcdefg " * (many // 2)
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        at = time.perf_counter()
        clean = secrets.redact(docs).first()["text"]
        times.append(time.perf_counter() - at)
        assert clean == "[secret] [secret] [secret] " * (many // 2)
    assert times[1] < 10 * times[0]  # 16 times if it grew with the square


def test_costly_rule_ranks_below_a_cheap_one(spark):
    docs = spark.createDataFrame([(i, "some words, ABC and more. " * 200) for i in range(300)], "doc_id long, text string")
    sample = cascade.C.stored(cascade.base(docs), "test-rules")
    cheap = cascade.Rule("cheap", F.col("n_symbols") < F.col("n_words"))
    costly = cascade.Rule("costly", F.char_length(F.regexp_replace("_text", r"(?i)[a-z]+\.", "")) > F.col("n_words"))
    found = cascade.estimate(sample, [costly, cheap])
    assert found["costly"][0] > 5 * found["cheap"][0]
    even = {name: (cost, 0.5) for name, (cost, _) in found.items()}
    assert [r.name for r in cascade.ordered([costly, cheap], even)] == ["cheap", "costly"]
