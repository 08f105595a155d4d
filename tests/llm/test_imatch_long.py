"""I-Match on texts that fill every subset down to 1/256 of the lexicon."""

import random

from trefoil.llm import imatch


def test_long_texts_are_told_apart(spark, tmp_path):
    rng = random.Random(4)
    lexicon = [f"w{i}" for i in range(12_000)]
    one, two = rng.sample(lexicon, 6000), rng.sample(lexicon, 6000)
    texts = [(i, " ".join(t)) for i, t in enumerate((one, two, lexicon, lexicon[::-1]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = imatch.fingerprints(docs, *imatch.lexicon(docs, most=1.0))
    got = {r["doc_id"]: r for r in found.select(
        "doc_id", "_own", imatch.likeness(imatch.F.col("_own"), imatch.F.col("_following"), imatch.F.lit(False)).alias("near")).collect()}
    assert all(sum(x != "-" and not x.endswith("+") for x in r["_own"]) >= 6 for r in got.values())
    assert got[0]["_own"] != got[1]["_own"] and got[1]["near"] < 0.5  # two different texts
    assert got[3]["_own"] == got[2]["_own"] and got[3]["near"] == 1.0  # the same terms in another order


def test_full_slots_are_no_likeness(spark):
    pair = spark.range(1).selectExpr("array('5f+', '-', '6e+') AS a", "array('5f+', '-', '7d+') AS b")
    near = lambda same: pair.select(imatch.likeness(imatch.F.col("a"), imatch.F.col("b"), imatch.F.lit(same))).first()[0]
    assert near(False) == 0.0 and near(True) == 1.0
