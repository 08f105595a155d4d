"""The pipeline's stages on messy rows, each against brute force on its own input."""

import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline as P
from trefoil.llm import common, mixing, quality, secrets, simhash

from .test_operators import encoding


def test_stages(spark, messy):
    docs = common.documents(spark, messy)
    for (name, stage), check in zip(P.STAGES, (_good, _first, _clean, _mixed, _encoded)):
        out = common.stored(stage(spark, docs, messy), name)
        if check is not _encoded:
            assert out.columns == docs.columns
        check(spark, docs, out, messy)
        docs = out
    assert Counter(map(str, P.run(spark, messy).collect())) == Counter(map(str, docs.collect()))


def _good(spark, docs, out, folder):
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = [r for r in docs.collect() if model.score(quality.features(r["text"])[None])[0] >= quality.THRESHOLD]
    assert Counter(want) == Counter(out.collect())


def _first(spark, docs, out, folder):
    assert out.count() == simhash.near_classes(docs).select("component").distinct().count()
    assert not Counter(out.collect()) - Counter(docs.collect())


def _clean(spark, docs, out, folder):
    assert out.count() == docs.count()
    assert secrets.scan(out).selectExpr("max(size(_base))").first()[0] in (0, None)


def _mixed(spark, docs, out, folder):
    sizes = mixing.sized(docs)
    plan = mixing.plan_mix(sizes, mixing.turn_weights(sizes))
    copies = {(r["doc_id"], r["source"]): r["_copies"] for r in mixing.with_copies(sizes, plan).collect()}
    have = Counter(docs.collect())
    assert Counter(out.collect()) == Counter({r: n * copies[r["doc_id"], r["source"]] for r, n in have.items() if copies[r["doc_id"], r["source"]]})


def _encoded(spark, docs, out, folder):
    enc, want = encoding(), []
    for r in docs.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()))
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in out.collect()) == Counter(want)


def test_empty(spark, nothing):
    assert P.run(spark, nothing).collect() == []
