"""Operators 11 to 13 against brute force on messy rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from .conftest import rows

from trefoil.llm import common, importance, periodic, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(found):
    return sorted(found, key=repr)


# -- 11 ---------------------------------------------------------------------------------------------


def brute_runs(w, least_words=2, least_periods=2):
    """Every maximal stretch with period q that has no smaller period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j - i >= q and length >= max(least_words, least_periods * q):
                if not any(all(w[x] == w[x + s] for x in range(i, i + length - s)) for s in range(1, q)):
                    out.append((i, length, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts_with_runs(seed, n):
    rng = random.Random(seed)
    for t in range(n):
        letters, w = "abcde"[:rng.choice([1, 2, 2, 3, 5])], []
        size = rng.randint(0, 70)
        while len(w) < size:
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            w += unit * (rng.randint(1, 6) if t % 3 else 1)
            if rng.random() < 0.5:
                w.pop()
        yield w


def test_catchers_find_all_runs():
    for w in texts_with_runs(1, 3000):
        want = brute_runs(w)
        assert periodic.runs_of(w) == want
        state = periodic.Catchers()
        state.extend(w)
        state.close()
        assert {(s, q) for s, _, q in want} <= set(state.squares)  # each run began with a square
        assert all(w[s:s + q] == w[s + q:s + 2 * q] for s, q in state.squares)


def test_catchers_are_online():
    """A square is reported with its last word, whatever the pieces in which words arrive."""
    w = list("abcabcabx") + ["y"] * 3
    state = periodic.Catchers()
    reported = []
    for word in w:
        before = len(state.squares)
        state.extend([word])
        reported += [(len(state.seen), s) for s in state.squares[before:]]
    assert reported == [(6, (0, 3)), (11, (9, 1))]
    assert state.close() == [(0, 8, 3), (9, 3, 1)]


def test_catchers_on_long_texts():
    assert periodic.runs_of(["a"] * 50_000) == [(0, 50_000, 1)]
    assert periodic.runs_of([str(i % 700) for i in range(30_000)]) == [(0, 30_000, 700)]
    half = [str(i) for i in range(9_000)]
    assert periodic.runs_of(half + half) == [(0, 18_000, 9_000)]


def edited_words(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def periodic_row(doc_id, text):
    w = edited_words(doc_id, text)
    runs = brute_runs(w, 6, 4) if len(w) <= 1000 else periodic.runs_of(w, 6, 4)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_periodic_query(spark, messy, tmp_path):
    got = periodic.op11_periodic_runs(spark, messy).collect()
    assert ordered(map(tuple, got)) == ordered(periodic_row(r[0], r[1]) for r in rows())
    more = [(i, " ".join(w)) for i, w in enumerate(texts_with_runs(9, 400))] + [(500 + i, f"x{i} y z " * i) for i in range(40)]
    spark.createDataFrame(more, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = [periodic_row(*r) for r in more]
    assert ordered(map(tuple, got)) == ordered(want) and sum(r[1] > 0 for r in want) > 100


def test_periodic_keeps_columns(spark, messy):
    docs = common.documents(spark, messy).withColumn("_periodic", common.F.lit(1))
    got = periodic.periodic(docs, 6, 4)
    assert got.columns == docs.columns and got.count() == len(rows())
    spam = got.where("doc_id = 10").first()["_periodic"]
    assert spam["collapsed"] == "spam" and tuple(spam["runs"][0]) == (0, 800, 1)
    with pytest.raises(ValueError):
        periodic.periodic(docs, 2, 1.5)


def test_strongest_run_ties(spark):
    runs = [[(5, 12, 3), (0, 8, 2)], [(9, 12, 3), (9, 8, 2)], [(1, 9, 2), (2, 5, 1)], []]
    df = spark.createDataFrame([(r,) for r in runs], f"runs array<{periodic.RUN}>")
    got = [r[0] for r in df.select(periodic.strongest(common.F.col("runs"))).collect()]
    assert [None if r is None else tuple(r) for r in got] == [(0, 8, 2), (9, 8, 2), (2, 5, 1), None]


# -- 12 ---------------------------------------------------------------------------------------------


def features(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(w), [" ".join(w[i:i + n]).encode() for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def importance_rows(docs, target):
    found = [(d, *features(t)) for d, t in docs]
    raw, aim = (Counter(zlib.crc32(f) % 10_000 for fs in all_ for f in fs) for all_ in ([f for _, _, f in found], [features(t)[1] for t in target]))
    S, T = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log(((aim[b] + 1) * (S + 10_000)) / ((raw[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for d, n, fs in found:
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f) % 10_000] for f in fs)
        out.append([d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(able[:5 * len(able) // 100])}
    return [(r[0], r[2], r[3], r[4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize("piece", [importance.PIECE_BYTES, 50])
def test_importance_query(spark, messy, tmp_path, monkeypatch, piece):
    """Several pieces a text change nothing (the cut is a default argument, so it is set there)."""
    monkeypatch.setattr(importance.pieces, "__defaults__", (piece,))
    docs = [(r[0], r[1]) for r in rows() if piece > 99 or len(r[1] or "") < 9000]
    docs += [(100 + i, f"Common words {i % 7} and a{i} Zürich № {i} " * (i % 9)) for i in range(120)]
    docs += [(7000, docs[-1][1]), (7000, docs[-1][1])]
    target = ["common WORDS and a Zürich", None, "", "no spam here, naïve 東京"] * 3
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = importance.op12_importance_resampling(spark, str(tmp_path)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert ordered(map(tuple, got)) == ordered(importance_rows(docs, target))


def test_importance_draw_keeps_rows(spark, messy):
    docs = common.documents(spark, messy)
    drawn = importance.resample(docs, docs.where("doc_id = 11"), percent=30)
    assert drawn.columns == docs.columns
    ids = [r["doc_id"] for r in drawn.collect()]
    assert 11 in ids and len(ids) >= 3 and set(ids).isdisjoint({1, 2, 3, 4})
    assert importance.resample(docs, docs, percent=0).count() == 0


def test_interned_table_tells_bytes_apart(monkeypatch):
    """Equal keys with different bytes get different slots."""
    text = b"aa bb aa cc bb aa averyveryverylongwordthatneedsmanylanes averyveryverylongwordthatneedsmanylanex"
    start, end, _, _ = importance.occurrences(text, len(text), 1)
    monkeypatch.setattr(importance, "xxh64", lambda text, words, start, length, seed: np.full(len(start), 5, np.uint64))
    table = importance.Interned(text, start, end, 10_000)
    found = [text[a:b] for a, b in zip(start, end)]
    assert len(table.used) == len(set(found))
    for word, slot in zip(found, table.slot):
        assert table.count[slot] == found.count(word) and table.bucket[slot] == zlib.crc32(word) % 10_000
        assert [table.slot[i] == slot for i, w in enumerate(found)] == [w == word for w in found]


def test_vectorised_hashes_equal_the_libraries():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 256, 2000).astype(np.uint8).tobytes()
    words = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), strides=(1,))
    start, size = rng.integers(0, 1900, 4000), rng.integers(0, 80, 4000)
    want = [xxhash.xxh64_intdigest(text[a:a + n], 42) for a, n in zip(start.tolist(), size.tolist())]
    assert (importance.xxh64(text, words, start, size, 42) == np.array(want, np.uint64)).all()
    want = [zlib.crc32(text[a:a + n]) for a, n in zip(start.tolist(), size.tolist())]
    assert (importance.crc32(text, words, start, size) == np.array(want, np.uint32)).all()


# -- 13 ---------------------------------------------------------------------------------------------

URLS = [
    (1, "https://WWW.Example.com/en/x?q=/fr/"), (2, "http://a.example.com/en/1"), (3, "http://example.com/en"), (4, "http://notexample.com/en/"),
    (5, "http://x.net/fr/1#top"), (6, "http://x.net/de/1"), (7, None), (8, ""), (9, "mailto:a@b.com"), (10, "http://com"), (11, "http://com/"),
    (12, "https://x.com?a=/en/"), (13, "ftp://É.COM/É"), (14, "http://a://b.net/es/"), (15, "http://x.org/" + "a" * 50_000), (16, "http:///en/"),
    (17, "http://m.www.example.com/en/1"), (18, "https://x.net/es/1"), (None, "http://x.net/es/1"), (18, "https://x.net/es/1"), (19, "http://a.com\n/en/"),
]


def url_row(page_id, url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return page_id, host, path, best and best.host + best.path, best and best.verdict


def test_url_query(spark, tmp_path):
    data = [(i, u, "<html>", "h", 1) for i, u in URLS]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, host string, _rule int").repartition(2)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = urls.op13_url_filter(spark, str(tmp_path)).collect()
    want = [url_row(*u) for u in URLS]
    assert ordered((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == ordered(w[:4] for w in want)
    assert ordered((r["page_id"], r["host"], r["path"], r["verdict"]) for r in got if r["rule"]) == ordered((w[0], w[1], w[2], w[4]) for w in want if w[3])
    assert {r["verdict"] for r in got} == {"allow", "block"}
    assert ordered(got) == ordered(urls.op13_url_filter(spark, str(tmp_path)).collect())
    model = urls.train(spark.createDataFrame([("a.b", "/", "block")], "host string, path string, verdict string"))
    kept = urls.keep_allowed(pages, model, urls.RULES)
    assert kept.columns == pages.columns and kept.where("page_id = 18").count() == 0


def test_url_model_learns_what_rules_say(spark):
    """Held out: a quarter of the ruled URLs, by hash."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    ruled = urls.parts(pages, urls.RULES).where("_rule is not null").selectExpr("_host AS host", "_path AS path", "_verdict AS verdict")
    fold = common.F.pmod(common.F.xxhash64("host", "path"), common.F.lit(4)) == 0
    model = urls.train(ruled.where(~fold))
    held = ruled.where(fold).collect()
    right = (model.score([(r["host"], r["path"]) for r in held]) > 0.5) == np.array([r["verdict"] == "block" for r in held])
    assert len(held) > 200 and right.mean() > 0.95


def test_url_model_without_labels_allows(spark):
    model = urls.train(spark.createDataFrame([], "host string, path string, verdict string"))
    assert model.score([("x.org", "/"), ("", "")]).tolist() == [0.5, 0.5]


def test_url_rules_prefer_the_longer_host(spark):
    rules = [urls.Rule("b.com", "/", "allow"), urls.Rule("com", "/b/", "block")]
    page = spark.createDataFrame([(1, "http://b.com/b/")], "page_id long, url string")
    assert urls.parts(page, rules).first()["_rule"] == "b.com/"
    with pytest.raises(ValueError):
        urls.matched(common.F.lit("a"), common.F.lit("b"), rules * 300)
