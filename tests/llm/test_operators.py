"""Each operator against brute force on messy rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from .conftest import _sentences, rows

from trefoil.llm import anchors, bpe, cascade, common, imatch, mixing, quality, ring, secrets, simhash, suffix
from trefoil.llm.components import components
from trefoil.llm.oracles import ORACLES
from trefoil.llm.queries import QUERIES


def ordered(found):
    return sorted(found, key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).collect() == []


@pytest.mark.parametrize("name", ["op1_mix_sources", "op3_secret_scan", "op8_rule_cascade"])
def test_against_sql(spark, messy, name):
    """Rows that share a doc_id are told apart by their rows' values; SQL that joins on doc_id gets a table without them."""
    con = duckdb.connect()
    docs = common.documents(spark, messy).where("doc_id is not null and doc_id not in (12, 14)")
    folder = f"{messy}-{name}"
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, folder)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert ordered(tuple(r[c] for c in names) for r in got.collect()) == ordered(cur.fetchall())


def test_mix_comes_near_its_targets(spark, sf):
    got = mixing.op1_mix_sources(spark, sf).toPandas()
    by = got.assign(source=common.documents(spark, sf).toPandas().set_index("doc_id").source.reindex(got.doc_id).values).groupby("source")
    assert (abs(by.taken.sum() - by.target.first()) <= by["size"].max()).all()
    assert (got.taken <= 3 * got["size"]).all() and abs(by.target.first().sum() - got["size"].sum()) < 1e-6


def test_water_fill_clamps_and_reshares(spark):
    table = spark.createDataFrame([("a", 10, 1.0), ("b", 100, 10.0), ("c", 1000, 1.0), ("z", 0, 5.0)], "source string, size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.water_fill(table, 2.0).collect()}
    assert got["z"] == 0 and got["b"] == 200 and got["a"] == 20 and abs(got["c"] - 890) < 1e-9


def test_mix_keeps_columns(spark, messy):
    docs = common.documents(spark, messy)
    assert mixing.mix(docs).columns == docs.columns


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, messy):
    table = [(r[0], fingerprint(r[1])) for r in rows()]
    parent = list(range(len(table)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(table)):
        for j in range(i):
            if (table[i][1] ^ table[j][1]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(table):
        least[root(i)].append(doc)
    want = [(d, f"{f:016x}", min((x for x in least[root(i)] if x is not None), default=None)) for i, (d, f) in enumerate(table)]
    got = simhash.op2_simhash_near_dedup(spark, messy).select("doc_id", "fingerprint", "component_id").collect()
    assert ordered(map(tuple, got)) == ordered(want)


@pytest.mark.parametrize("crowd", [1, 40])
def test_links_connect_all_near_fingerprints(spark, crowd):
    rng = random.Random(5)
    found = {rng.getrandbits(64) for _ in range(40)}
    for center in list(found)[:4]:
        at = center
        for _ in range(25):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                at ^= 1 << b
            found.add(at)
            at = rng.choice([center, at])
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in found)
    links = simhash.link(spark.createDataFrame([(f,) for f in signed], "fp long"), crowd=crowd)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    label = {f: f for f in signed}
    for _ in signed:
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                    label[a] = min(label[a], label[b])
        if all(label[a] == label[label[a]] for a in signed):
            pass
    assert {f: got.get(f, f) for f in signed} == label


def test_one_row_a_component_stays(spark, messy):
    docs = common.documents(spark, messy)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    names = Counter(r["component"] for r in simhash.near_classes(docs).select("component").distinct().collect())
    assert kept.count() == len(names)


def test_secret_positions():
    assert secrets.most(4.0) < secrets.most(3.0)


def test_secrets_are_redacted(spark, messy):
    docs = common.documents(spark, messy)
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    text = clean.where("doc_id = 8").first()["text"]
    assert "a1b2c3" not in text and "AKIA" not in text and "[secret]" in text
    untouched = {r[1] for r in rows()} - {r["text"] for r in clean.collect()}
    assert len(untouched) == 1  # only the text with secrets changed


@pytest.mark.parametrize("text,kind,expected", [
    ("see 9F86D081884C7D659A2FEAA0C55AD015 end", "entropy_hex", True),
    ("see aB3dE5fG7hJ9kL2mN4pQ6rS8tU end", "entropy_base64", True),
    ("see abcdefghijklmnopqrstuvwxyz012345 end", "entropy_base64", False),
    ("see donaudampfschifffahrtsgesellschaft end", "entropy_base64", False),
    ("see 123e4567-e89b-12d3-a456-426614174000 end", "entropy_base64", False),
])
def test_entropy_windows(spark, text, kind, expected):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = secrets.scan(docs).select(secrets.spelled(secrets.F.col("_spans"))).first()[0]
    assert (kind in spans) == expected


def test_pu_model_finds_the_prior_and_the_junk():
    rng = np.random.default_rng(3)
    draw = lambda good, n: np.hstack([rng.normal(2 if good else -2, 1, (n, 2)), rng.normal(0, 1, (n, quality.WIDTH - 2))])
    web = np.vstack([draw(True, 1600), draw(False, 400)])
    model = quality.fit(draw(True, 1500), web)
    assert 0.7 < model.prior < 0.92
    assert (model.score(draw(True, 500)) >= 0.7).mean() > 0.95 and (model.score(draw(False, 500)) < 0.7).mean() > 0.95


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = quality.op4_pu_quality(spark, folder).toPandas().merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and held[held.quality == 1].predicted.mean() > 0.95


def test_quality_of_messy_rows(spark, messy):
    got = quality.op4_pu_quality(spark, messy).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_ring_fill_is_sequential_bounded_loads():
    rng = random.Random(2)
    counts, owners = [rng.randint(0, 9) for _ in range(24)], [rng.randrange(4) for _ in range(24)]
    owners[:4] = range(4)
    total = sum(counts)
    quotas = [total // 4 + (s < total % 4) for s in range(4)]
    room, want = list(quotas), {}
    over = []
    for arc, n in enumerate(counts):
        for at in range(n):
            if room[owners[arc]]:
                want[arc, at] = owners[arc]
                room[owners[arc]] -= 1
            else:
                over.append((arc, at))
    for arc, at in over:
        step = arc
        while not room[owners[step]]:
            step = (step + 1) % 24
        want[arc, at] = owners[step]
        room[owners[step]] -= 1
    got = {(arc, i): s for arc, a, b, s in ring.fill(counts, owners, quotas) for i in range(a, b)}
    assert got == want and not any(room)


def test_ring_shards(spark, messy):
    got = ring.op5_ring_shards(spark, messy).collect()
    assert ordered((r["doc_id"], r["size"]) for r in got) == ordered((r[0], len((r[1] or "").encode()) + 1) for r in rows())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_ring_moves_few_rows(spark):
    table = spark.range(4000).select("id", ring.F.xxhash64("id").alias("h"))
    place = lambda n: {r["id"]: r["shard"] for r in ring.place(table, ring.F.col("h"), ["id"], shards=n).collect()}
    old, new = place(8), place(9)
    assert sum(old[i] != new[i] for i in old) < 0.45 * len(old)  # a modulo would move eight in nine


def encoding():
    ranks = {}
    import base64

    for line in Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes().splitlines():
        a, b = line.split()
        ranks[base64.b64decode(a)] = int(b)
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(50_000, 2000), (40, 25), (7, 3)])
def test_bpe_in_chunks(spark, messy, chunk, overlap):
    enc, vocabulary = encoding(), bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = common.documents(spark, messy)
    if chunk < 100:
        docs = docs.where("doc_id is null or doc_id not in (9, 11)")
    odd = spark.createDataFrame([(100, "it's  we'll\n\n  x  !!'s 123abc　  é" * 9), (101, "  " * 90 + "end")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    want = []
    for r in docs.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = bpe.digests(docs, vocabulary, chunk, overlap).select("doc_id", *bpe.DIGEST).collect()
    assert ordered(map(tuple, got)) == ordered(want)
    back = bpe.decode(bpe.encode(docs, vocabulary, chunk, overlap), vocabulary).collect()
    assert ordered((r["doc_id"], bytes(r["bytes"])) for r in back) == ordered((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect())


def _x(data, seed=42):
    h = xxhash.xxh64_intdigest(data, seed % (1 << 64))
    return h - (1 << 64) if h >> 63 else h


def _imatch(texts):
    """Brute-force fingerprints of (doc_id, text) rows."""
    import re

    long = lambda v, n=8: (v % (1 << 8 * n)).to_bytes(n, "little")
    terms = lambda t: {_x(w.encode()) for w in re.split(imatch._SPLIT, t.lower()) if w}
    texts = sorted(((d, t or "") for d, t in texts), key=lambda r: (r[0] is None, -(r[0] or 0), _x(r[1].encode())))
    distinct = {t for _, t in texts}
    df = Counter(h for t in distinct for h in terms(t))
    low, high = (max(2, share * len(distinct)) for share in (imatch.LEAST, imatch.MOST))
    band, common = ({h for h, c in df.items() if low <= c <= high}, {h for h, c in df.items() if c >= low and c > high})

    def slots(t):
        own = terms(t)
        use = own & band or own - common or own
        out = []
        for family in range(imatch.TIMES):
            for scale in range(imatch.SCALES):
                mine = sorted(h for h in use if _x(long(family, 4), _x(long(h))) % (2 << scale) == 0)
                seed = 42
                for h in mine:
                    seed = _x(long(h), seed)
                out.append(f"{seed & 0xFFFFFFFF:08x}{'+' if len(mine) > imatch.FULL else ''}" if mine else "-")
        return out if any(x != "-" for x in out) else [f"text-{_x(t.encode()) % (1 << 64):x}"]

    def near(a, b, same):
        told = [(x, y) for x, y in zip(a + [None] * (len(b) - len(a)), b + [None] * (len(a) - len(b)))
                if not (x == y == "-" or (x or "").endswith("+") or (y or "").endswith("+"))]
        return sum(x == y for x, y in told) / len(told) if told else float(same)

    n, out = len(texts), []
    for i, (d, t) in enumerate(texts):
        nxt = texts[(i + 1) % n][1]
        k = len(t) // 3
        edited = t[:len(t) - k] + nxt[:k]
        a, b, c = slots(t), slots(edited), slots(nxt)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), ",".join(a), ",".join(b),
                    round(near(a, b, t == edited), 9), round(near(a, c, t == nxt), 9)))
    return out


def _rounded(rows):
    return ordered((*r[:5], round(r[5], 9), round(r[6], 9)) for r in rows)


def test_imatch(spark, messy, monkeypatch):
    """Null and repeated ids included; buckets hold about three rows, so ids are cut over several."""
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 3)
    docs = common.documents(spark, messy).select("doc_id", "text")
    assert _rounded(imatch.op7_imatch(spark, messy).collect()) == ordered(_imatch([tuple(r) for r in docs.collect()]))
    more = docs.unionByName(spark.range(40).selectExpr("if(id < 25, null, 16) AS doc_id", "concat('same words here ', id, ' and there ', id % 5) AS text"))
    more.write.mode("overwrite").parquet(f"{messy}-imatch/documents.parquet")
    got = imatch.op7_imatch(spark, f"{messy}-imatch").collect()
    assert _rounded(got) == ordered(_imatch([tuple(r) for r in more.collect()]))
    cut = imatch.neighbours(more.withColumn("doc_id", imatch.F.col("doc_id").cast("long"))).where("not _extra")
    assert cut.where("doc_id is null").select("_bucket").distinct().count() > 3


def test_imatch_of_a_text_that_fills_a_third(spark, tmp_path):
    """The copies keep their near matching: frequency counts distinct texts."""
    docs = common.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text")
    one = docs.where("length(text) between 900 and 1500").orderBy("doc_id").first()["text"]
    ids = spark.range(500).select((imatch.F.col("id") * 2 + 50_000).alias("doc_id"), imatch.F.lit(one).alias("text"))
    spread = docs.withColumn("doc_id", imatch.F.col("doc_id") * 2 + 50_001).unionByName(ids)
    spread.write.parquet(f"{tmp_path}/documents.parquet")
    got = imatch.op7_imatch(spark, str(tmp_path)).toPandas()
    copies = got[got.doc_id % 2 == 0]
    assert len(copies) == 500 and not copies.fingerprint.str.startswith("text-").any()
    apart = copies[copies.near_next < 1]
    assert len(apart) > 300 and apart.near_edited.mean() > 0.25 > apart.near_next.mean()


def test_imatch_tells_edits_from_neighbours(spark):
    got = imatch.op7_imatch(spark, "/root/testdata/sf0.01").toPandas()
    assert got.near_edited.mean() > 0.25 and got.near_next.mean() < 0.05


def test_rules_keep_their_result_in_any_order(spark, messy):
    docs = common.documents(spark, messy).select("doc_id", "text")
    todo = cascade.rules()
    one, two = (ordered((r["doc_id"], r["n_words"], r["kept"]) for r in cascade.cascade(docs, t, 10).collect()) for t in (todo, todo[::-1]))
    assert one == two
    found = {r.name: (1.0, i / 10) for i, r in enumerate(todo)}
    assert [r.name for r in cascade.ordered(todo, found)] == [r.name for r in todo[::-1]]


def test_word_windows(spark, messy):
    words = [(r[0], (r[1] or "").encode().split()) for r in rows()]
    seen = Counter(tuple(w[i:i + 35]) for _, w in words for i in range(len(w) - 34))
    want = []
    for doc, w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone[i:i + 35] = True
        want.append((doc, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    got = anchors.op9_block_anchors(spark, messy).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert ordered(map(tuple, got)) == ordered(want)


def test_words_that_fool_polynomial_hashes(spark):
    """Doubling patterns collide in every polynomial hash modulo 2^64; here they end otherwise equal windows."""
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: 98, 98: 97})
    same = _sentences(20, 34)
    texts = [(1, f"{same} {word}"), (2, f"{same} {word.translate({97: 98, 98: 97})}"), (3, f"{word} {same}"), (4, f"{same} {word} end")]
    got = anchors.without_repeats(spark.createDataFrame(texts, "doc_id long, text string"), segments=4).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 35, 2: 0, 3: 0, 4: 35}


def test_byte_windows(spark, messy):
    texts = [(r[0], (r[1] or "").encode()) for r in rows()]
    top = 1 << 62
    least = {}
    for doc, t in texts:
        for i in range(len(t) - 49):
            k = t[i:i + 50]
            least[k] = min(least.get(k, top), top if doc is None else doc)
    want = []
    for doc, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if least[t[i:i + 50]] < (top if doc is None else doc):
                gone[i:i + 50] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    got = suffix.op10_suffix_dedup(spark, messy).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert ordered(map(tuple, got)) == ordered(want)


def test_hot_join_splits_keys(spark):
    left = spark.range(6000).selectExpr("id", "if(id < 3000, 1, id) AS k")
    right = left.groupBy("k").count().withColumnRenamed("count", "n")
    assert common.join_hot(left, right, "k", "n", 6000).count() == 6000


def test_search(spark):
    points = [1, 5, 9, 9, 20]
    got = [r[0] for r in spark.range(25).select(common.search(points, common.F.col("id"))).collect()]
    assert got == [sum(p <= v for p in points) for v in range(25)]
