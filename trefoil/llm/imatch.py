"""I-Match fingerprints over an inverse-document-frequency band, with randomised lexicon subsets.

Terms are runs of ASCII letters, digits and non-ASCII characters of the lower-cased text, held as 64-bit hashes. Document
frequency counts distinct texts, so copies weigh nothing. The lexicon keeps the terms found in at least LEAST and at most MOST
of them (and in two at least). As every text has a bounded mean number of terms t, at most t / LEAST terms can reach
the band, whatever the corpus: that bounds the broadcast. TIMES families of random subsets of the lexicon hold a half, a quarter, ...
of its terms, down to 1 / 65,536, so that also the longest texts have subsets of few terms; the subsets of a
family are nested, a term's place in it being the number of trailing zero bits of one hash. A slot of a fingerprint is the
hash of the document's sorted distinct terms of that subset; a slot with more than FULL terms is marked with ``+``, because any edit
changes it. Two fingerprints are as alike as the share of equal slots among those that are marked in neither and not
empty in both; if there are none, only equal texts are alike. A text without any term in the band falls back to its terms
outside the lexicon (the rarest), or, if all are too common, to those; a text without terms is fingerprinted by its whole content.

A document's neighbour (the next lower doc_id) comes by a window over buckets of consecutive ids; each bucket also gets
the first document of the following one, so texts are shuffled once and never sorted globally. An id that many rows share (null
among them) is cut over several buckets by the hash of the text.

Defined cases: a null text is empty; a null doc_id comes last in the order; rows that repeat a doc_id follow each other by the
hash of their text; the only document is its own neighbour; very long texts are read whole; an empty table gives no rows;
further columns are passed by.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trefoil.llm import common as C

LEAST, MOST = 0.002, 0.02
SCALES, TIMES = 16, 6
SLOTS = SCALES * TIMES
FULL = 3
#: Bits of one family's place in a term's packed places.
PLACE = 5
#: Ids in a bucket of neighbours, and buckets at most.
BUCKET_ROWS, BUCKETS = 64, 16384
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NO_ID = -(1 << 63)


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's terms."""
    found = F.transform(F.split(F.lower(text), _SPLIT), lambda t: F.xxhash64(t))
    return F.array_remove(F.array_distinct(found), F.xxhash64(F.lit("")))


def places(h: Column) -> Column:
    """In each family, how many of its nested subsets hold the term: trailing zero bits of a hash, SCALES at most. Packed."""
    packed = F.lit(0).cast("long")
    for family in range(TIMES):
        x = F.xxhash64(h, F.lit(family)).bitwiseOR(F.lit(1 << SCALES).cast("long"))
        zeros = F.log2(x.bitwiseAND(-x).cast("double")).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(zeros, PLACE * family))
    return packed


def frequencies(docs: DataFrame) -> tuple[DataFrame, int]:
    """``h, df`` over the distinct texts, and their number. A row counts as one part in as many as its text has copies, so texts
    need not be gathered; the sums are whole numbers again."""
    rows = docs.select(C.text_of(docs).alias("text")).withColumn("_text", F.md5("text"))
    copies = C.stored(rows.groupBy("_text").agg(F.count("*").alias("_n")), "imatch_copies")
    texts = copies.count()
    joined = C.join_by_size(rows, copies.where("_n > 1"), "_text", F.monotonically_increasing_id())
    terms = joined.select(F.explode(term_hashes(F.col("text"))).alias("h"), (1.0 / F.coalesce("_n", F.lit(1))).alias("part"))
    return terms.groupBy("h").agg(F.round(F.sum("part")).cast("long").alias("df")), texts


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> tuple[DataFrame, Column]:
    """``h, places`` of the band's terms, stored, and an array of the terms above the band (at most mean terms / ``most``)."""
    df, texts = frequencies(docs)
    low, high = max(2.0, least * texts), max(2.0, most * texts)
    found = C.stored(df.where(F.col("df") >= low), "lexicon")
    common = [r["h"] for r in found.where(F.col("df") > high).select("h").orderBy("h").collect()]
    return found.where(F.col("df") <= high).select("h", places(F.col("h")).alias("places")), F.from_json(F.lit(json.dumps(common)), "array<bigint>")


def neighbours(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``_bucket, _rn, _extra, _next``: the text of the next lower doc_id, after the last the
    first. Rows with ``_extra`` stand in for the following bucket's first row; drop them in the end."""
    spark = docs.sparkSession
    rows = docs.withColumn("_id", F.coalesce("doc_id", F.lit(_NO_ID))).withColumn("text", C.text_of(docs)).withColumn("_h", F.xxhash64("text"))
    ids = rows.select("_id", "_h")
    total = ids.count()
    parts = max(1, min(BUCKETS, total // BUCKET_ROWS))
    points = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        points = sorted(ids.agg(F.percentile_approx("_id", shares, 20 * parts).alias("p")).first()["p"])
    # Buckets go down with the id. An id that is a point several times has so many buckets, dealt by the hash.
    upto = C.search(points, F.col("_id"))
    below = F.when(F.col("_id") == _NO_ID, 0).otherwise(C.search(points, F.col("_id") - 1))
    share = F.floor((F.shiftright("_h", 32) + (1 << 31)) * F.greatest(upto - below, F.lit(1)) / (1 << 32)).cast("int")
    bucket = F.lit(len(points)) - upto + share
    first = F.min(F.struct(F.bitwise_not(F.col("_id")).alias("i"), "_h"))
    heads = ids.groupBy(bucket.alias("b")).agg(first.alias("head")).orderBy("b").collect()  # one a bucket
    following = [(~heads[(i + 1) % len(heads)]["head"]["i"], heads[(i + 1) % len(heads)]["head"]["_h"], r["b"]) for i, r in enumerate(heads)]
    donors = C.rows_of(spark, following, "_id bigint, _h bigint, _for int")
    rows = rows.join(F.broadcast(donors), ["_id", "_h"], "left")
    places = F.filter(
        F.array(F.struct(bucket.alias("b"), F.lit(False).alias("extra")), F.struct(F.col("_for").alias("b"), F.lit(True).alias("extra"))),
        lambda x: x["b"].isNotNull())
    placed = rows.withColumn("_p", F.explode(places)).withColumns({"_bucket": F.col("_p.b"), "_extra": F.col("_p.extra")}).drop("_p", "_for")
    order = Window.partitionBy("_bucket").orderBy("_extra", F.desc("_id"), "_h")
    return placed.withColumns({"_rn": F.row_number().over(order), "_next": F.lead("text").over(order)}).drop("_id", "_h")


def slots_of(found: Column, other: Column, common: Column, whole: Column) -> Column:
    """The slots of a fingerprint, from its band terms (h, places), else from ``other``, the hashes of all its terms; without
    terms from the hash of the whole text."""

    def family(number: int):
        def one(state: Column, scale: Column) -> Column:
            mine = F.filter(state["terms"], lambda x: F.shiftright(x["places"], PLACE * number).bitwiseAND(F.lit((1 << PLACE) - 1)) > scale)

            def grown(m: Column) -> Column:
                name = F.lower(F.lpad(F.hex(F.xxhash64(F.transform(m, lambda x: x["h"])).bitwiseAND(F.lit((1 << 32) - 1))), 8, "0"))
                text = F.when(F.size(m) == 0, F.lit("-")).when(F.size(m) > FULL, F.concat(name, F.lit("+"))).otherwise(name)
                return F.struct(m.alias("terms"), F.concat(state["slots"], F.array(text)).alias("slots"))

            return C.let(mine, grown)

        return one

    def slots(terms: Column) -> Column:
        scales, none = F.sequence(F.lit(0), F.lit(SCALES - 1)), F.array().cast("array<string>")
        start = F.struct(terms.alias("terms"), none.alias("slots"))
        return F.concat(*[F.aggregate(scales, start, family(n))["slots"] for n in range(TIMES)])

    rare = C.let(F.array_except(other, common), lambda r: F.when(F.size(r) > 0, r).otherwise(other))
    fallback = F.transform(rare, lambda h: F.struct(h.alias("h"), places(h).alias("places")))
    some = C.let(F.array_sort(F.when(F.size(found) > 0, found).otherwise(fallback)), slots)
    return C.let(some, lambda s: F.when(F.exists(s, lambda x: x != "-"), s).otherwise(F.array(F.concat(F.lit("text-"), F.lower(F.hex(whole))))))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Share of equal slots, 0 to 1; without any to compare, 1 if the texts are the ``same``."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    full = lambda x: F.coalesce(x.endswith("+"), F.lit(False))
    told = F.filter(pairs, lambda p: ~(((p["x"] == "-") & (p["y"] == "-")) | full(p["x"]) | full(p["y"])))
    return C.let(told, lambda t: F.when(F.size(t) == 0, same.cast("double")).otherwise(
        F.size(F.filter(t, lambda p: F.coalesce(p["x"] == p["y"], F.lit(False)))) / F.size(t)))


def fingerprints(docs: DataFrame, terms: DataFrame, common: Column) -> DataFrame:
    """doc_id, n_chars, edited_sha256 and slot arrays of each row, its edited text and its neighbour."""
    rows = neighbours(docs)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substr("text", F.lit(1), n - third), F.substr(F.coalesce("_next", F.lit("")), F.lit(1), third)))
    digested = rows.select(
        "_bucket", "_rn", "_extra", "doc_id", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        F.xxhash64("text").alias("_whole"), F.xxhash64("_edited").alias("_whole_edited"),
        term_hashes(F.col("text")).alias("_all"), term_hashes(F.col("_edited")).alias("_all_edited"),
    )
    # One row a term of either text, and one that carries what belongs to the document.
    carried = ["_extra", "doc_id", "n_chars", "edited_sha256", "_whole", "_whole_edited", "_all", "_all_edited"]
    term = lambda v, h, about: F.struct(F.lit(v).alias("v"), h.alias("h"), about.alias("about"))
    nothing = F.lit(None).cast(digested.select(F.struct(*carried)).schema[0].dataType)
    each = F.concat(
        F.array(term(2, F.lit(0).cast("long"), F.struct(*carried))),
        F.transform("_all", lambda h: term(0, h, nothing)), F.transform("_all_edited", lambda h: term(1, h, nothing)))
    kept = digested.select("_bucket", "_rn", F.explode(each).alias("t")).select("_bucket", "_rn", F.col("t.v").alias("_v"), F.col("t.h").alias("h"), "t.about")
    marked = terms.where("h <> 0").unionByName(C.rows_of(docs.sparkSession, [(0, 0)], "h bigint, places bigint"))
    met = kept.join(F.broadcast(marked), "h").where((F.col("_v") == 2) | (F.col("h") != 0))
    grouped = met.groupBy("_bucket", "_rn").agg(
        F.first("about", ignorenulls=True).alias("about"), F.collect_list(F.struct("_v", "h", "places")).alias("_terms")).select("_bucket", "_rn", "about.*", "_terms")
    of = lambda v: F.transform(F.filter("_terms", lambda x: x["_v"] == v), lambda x: F.struct(x["h"].alias("h"), x["places"].alias("places")))
    made = grouped.withColumns({
        "_own": slots_of(of(0), F.col("_all"), common, F.col("_whole")), "_new": slots_of(of(1), F.col("_all_edited"), common, F.col("_whole_edited"))})
    order = Window.partitionBy("_bucket").orderBy("_rn")
    following = {"_following": F.lead("_own").over(order), "_whole_following": F.lead("_whole").over(order)}
    return made.withColumns(following).where("not _extra")


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = fingerprints(docs, *lexicon(docs))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("_own", ",").alias("fingerprint"),
        F.array_join("_new", ",").alias("edited_fingerprint"), likeness(F.col("_own"), F.col("_new"), F.col("_whole") == F.col("_whole_edited")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_following"), F.coalesce(F.col("_whole") == F.col("_whole_following"), F.lit(False))).alias("near_next"))
