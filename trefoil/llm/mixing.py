"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the budget. Sources whose share is above ``max_epochs`` times their size are
clamped there, and what they leave is shared out again by weight, until no source is above its cap. A source's rate is
its target over its size: every document is taken the whole part of that many times, and a seeded hash of ``doc_id``
picks the documents taken once more, up to the fractional part of the source's words.

Defined cases: a null source is a source of its own; a null or blank text has size 0; a source of size 0 has target 0;
rows that repeat a ``doc_id`` share one decision; an empty table gives no rows. Further columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trefoil.llm import common as C

#: Hash bins of a source for the fractional part: the words taken are off by half a bin at most.
BINS = 4096


def key_of(source: Column) -> Column:
    """A source as a key that joins: null has its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~null"))


def bin_of(doc_id: Column, seed: int) -> Column:
    """A seeded bin, 0 to BINS - 1, of a document."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(BINS))


def water_fill(sources: DataFrame, max_epochs: float, budget: float | None = None) -> DataFrame:
    """``sources`` (size, weight, ...) with ``target``. Each round sums clamped caps and free weights over the table;
    only those sums reach the driver. The level only rises, so it ends when no further source is clamped."""
    cap, weight = F.col("size") * F.lit(float(max_epochs)), F.col("weight").cast("double")
    first = sources.agg(F.sum("size").alias("size"), F.sum(weight).alias("weight")).first()
    total = float(first["size"] or 0) if budget is None else float(budget)
    level = total / first["weight"] if first["weight"] else 0.0
    clamped = -1
    while True:
        above = weight * F.lit(level) > cap
        now = sources.agg(
            F.sum(F.when(above, cap).otherwise(0.0)).alias("held"), F.sum(F.when(above, 0.0).otherwise(weight)).alias("free"),
            F.sum(above.cast("long")).alias("n"),
        ).first()
        if not now["free"] or now["n"] == clamped:
            break
        clamped, level = now["n"], (total - now["held"]) / now["free"]
    return sources.withColumn("target", F.least(cap, weight * F.lit(level)))


def plan_mix(sizes: DataFrame, weights: DataFrame, max_epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """One row a source: ``_key, source_size, target, whole, cut``. A document is taken ``whole`` times, and once more
    if its bin is below ``cut``. ``sizes`` has doc_id, source, size; ``weights`` has source, weight."""
    bins = (
        sizes.groupBy(key_of(F.col("source")).alias("_key"), bin_of(F.col("doc_id"), seed).alias("bin"))
        .agg(F.sum("size").alias("size"))
    )
    bins = C.stored(bins, "bins")
    sources = bins.groupBy("_key").agg(F.sum("size").alias("size")).join(
        weights.select(key_of(F.col("source")).alias("_key"), "weight"), "_key")
    filled = water_fill(C.stored(sources, "sources"), max_epochs)
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0))
    rated = filled.select(
        "_key", F.col("size").alias("source_size"), "target", F.floor(rate).alias("whole"),
        (F.col("target") - F.floor(rate) * F.col("size")).alias("rest"),
    )
    upto = Window.partitionBy("_key").orderBy("bin")  # at most BINS rows a source
    summed = bins.withColumn("upto", F.sum("size").over(upto)).join(rated.select("_key", "rest"), "_key")
    cuts = summed.groupBy("_key").agg(
        F.min(F.struct(F.abs(F.col("upto") - F.col("rest")).alias("off"), (F.col("bin") + 1).alias("cut"))).alias("best"),
    )
    best = F.least(F.col("best"), F.struct(F.col("rest").alias("off"), F.lit(0).cast("long").alias("cut")))
    return C.stored(
        rated.join(cuts, "_key").select("_key", "source_size", "target", "whole", best["cut"].alias("cut")), "mix")


def with_copies(docs: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """``docs`` with ``_source_size, _target`` and ``_copies``, how often the mix takes the row."""
    keyed = docs.withColumn("_key", key_of(F.col("source")))
    joined = C.join_by_size(keyed, plan.select("_key", *[F.col(c).alias(f"_{c}") for c in plan.columns if c != "_key"]), "_key", F.col("doc_id"))
    extra = F.when(bin_of(F.col("doc_id"), seed) < F.col("_cut"), 1).otherwise(0)
    return joined.withColumn("_copies", (F.col("_whole") + extra).cast("long")).drop("_key", "_whole", "_cut")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words, stored."""
    return C.stored(docs.select("doc_id", "source", C.word_count(C.text_of(docs)).alias("size")), "sizes")


def turn_weights(sizes: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating over the sources by code point, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    ranked = C.global_index(sizes.select("source").distinct(), order, "weights")
    return ranked.select("source", (F.col("_rank") % 3 + 1).alias("weight"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """The mixed rows: each document as often as the mix takes it, with the columns of ``docs``."""
    sizes = sized(docs)
    plan = plan_mix(sizes, turn_weights(sizes) if weights is None else weights, max_epochs, seed)
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("_row"))  # whatever its columns are called
    chosen = with_copies(rows, plan, seed).where("_copies > 0")
    return chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sized(C.documents(spark, sf_dir))
    plan = plan_mix(sizes, turn_weights(sizes))
    return with_copies(sizes, plan).select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("size")).alias("taken"))
