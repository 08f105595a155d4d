"""Single-sample gene-set enrichment as one rank shuffle plus one grouped sum.

Inputs are long tables: ``expression(sample, row_idx, gene, value)`` and
``gene_sets(set_name, gene)``. For one sample with N rows and a set of k rows, with ascending
ordinals Q and hit weights w, the sum of differences of the two running distributions is

    sum(w*Q)/sum(w) - (N*(N+1)/2 - sum(Q)) / (N-k)

so no cumulative pass per set is needed. ``score_by_walk`` keeps the running sums as a check.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trefoil.operators.ranking import rank_rows
from trefoil.session import BROADCAST_ROWS

PROFILES = ("stable", "single_sample_gsea_0.2")
CORREL_NORMS = ("rank", "zscore")
NO_SETS = ("error", "empty")
NORMALIZATIONS = ("raw", "sample_zscore", "global_range")


@dataclass(frozen=True)
class CompiledGeneSets:
    """Distinct (set_name, gene) membership whose size was counted once."""

    members: DataFrame
    rows: int

    def side(self) -> DataFrame:
        return F.broadcast(self.members) if self.rows <= BROADCAST_ROWS else self.members


def compile_gene_sets(gene_sets: DataFrame, no_sets: str = "error") -> CompiledGeneSets:
    """Stringify ids, drop duplicates and empty names, persist, and count for the join choice."""
    members = (
        gene_sets.select(
            F.col("set_name").cast("string").alias("set_name"),
            F.col("gene").cast("string").alias("gene"),
        )
        .dropDuplicates()
        .persist()
    )
    rows = members.count()
    if rows == 0 and no_sets != "empty":
        raise ValueError("no row of gene_sets names both a set and a gene, so gene_sets is empty")
    return CompiledGeneSets(members, rows)


def check_alpha(alpha: float) -> float:
    if not math.isfinite(alpha) or alpha < 0:
        raise ValueError(f"alpha is an exponent of ranks: {alpha!r} is negative or not finite")
    return float(alpha)


def check_sizes(min_size: int, max_size: int | None) -> None:
    if min_size < 1:
        raise ValueError(f"a scored set has one member or more, but min_size is {min_size}")
    if max_size is not None and max_size < min_size:
        raise ValueError(f"no size lies between min_size {min_size} and max_size {max_size}")


def finite_expression(expression: DataFrame) -> DataFrame:
    """Fail the query on null, NaN or infinite values; ids become strings."""
    v = F.col("value").cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return expression.select(
        "sample",
        F.col("row_idx").cast("long").alias("row_idx"),
        F.col("gene").cast("string").alias("gene"),
        F.when(bad, F.raise_error(F.concat_ws(
            " ", F.lit("value"), F.coalesce(v.cast("string"), F.lit("null")), F.lit("of gene"), "gene", F.lit("in sample"),
            "sample", F.lit("is null, NaN or infinite"))).cast("double"))
        .otherwise(v)
        .alias("value"),
    )


def power(x: Column, alpha: float) -> Column:
    """x**alpha, one everywhere for alpha 0."""
    return F.pow(x, F.lit(alpha)) if alpha else F.lit(1.0)


def weighted_ranks(
    expression: DataFrame,
    alpha: float = 0.25,
    correl_norm_type: str = "rank",
    strategy: str = "auto",
) -> DataFrame:
    """Rank every sample and add the hit weight ``w``.

    The z-score weights use the spread of the average ranks; their mean is (N+1)/2.
    """
    ranked = rank_rows(expression, strategy=strategy)
    if correl_norm_type == "rank":
        return ranked.withColumn("w", power(F.col("avg_rank"), alpha))
    if correl_norm_type != "zscore":
        raise ValueError(f"unknown correl_norm_type {correl_norm_type!r}")
    spread = ranked.groupBy("sample").agg(F.stddev_pop("avg_rank").alias("_s"))
    # A flat sample has no spread; it is reported when scores are combined.
    z = F.abs((F.col("avg_rank") - (F.col("n") + 1) / F.lit(2.0)) / F.nullif("_s", F.lit(0.0)))
    return ranked.join(spread, "sample").withColumn("w", power(z, alpha)).drop("_s")


def _resolve(profile: str, correl_norm_type: str | None) -> str:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    if correl_norm_type is None:
        return "zscore" if profile == "single_sample_gsea_0.2" else "rank"
    if correl_norm_type not in CORREL_NORMS:
        raise ValueError(f"unknown correl_norm_type {correl_norm_type!r}")
    return correl_norm_type


def score(
    expression: DataFrame,
    gene_sets: DataFrame | CompiledGeneSets,
    *,
    alpha: float = 0.25,
    normalization: str = "raw",
    profile: str = "stable",
    correl_norm_type: str | None = None,
    min_size: int = 1,
    max_size: int | None = None,
    coverage: str = "window",
    flat_samples: str = "error",
    no_sets: str = "error",
    strategy: str = "auto",
) -> DataFrame:
    """Enrichment score per (sample, set_name).

    ``coverage`` says when a set covering every row is an error: ``window`` (only inside the size
    window) or ``always`` (before the size filter, with ``max_size`` defaulting to N-1).
    ``flat_samples`` says whether a sample of equal values is an error or scored from its tied ranks (``keep``).
    It is an error too if no set has a member in range in any sample, unless ``no_sets`` is ``empty``: then there are no scores.
    Both profiles use the stable tie order; the legacy profile's unstable sort has no defined
    order to reproduce and only changes the default weights.
    """
    alpha = check_alpha(alpha)
    check_sizes(min_size, max_size)
    if normalization not in NORMALIZATIONS:
        raise ValueError(f"unknown normalization {normalization!r}")
    if no_sets not in NO_SETS:
        raise ValueError(f"unknown rule for no sets {no_sets!r}")
    weights = _resolve(profile, correl_norm_type)
    compiled = gene_sets if isinstance(gene_sets, CompiledGeneSets) else compile_gene_sets(gene_sets, no_sets)
    clean = finite_expression(expression)
    hits = weighted_ranks(clean, alpha, weights, strategy).join(compiled.side(), "gene")
    sums = hits.groupBy("sample", "set_name").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("w").alias("sw"),
        F.sum(F.col("w") * F.col("q")).alias("swq"),
        F.sum("q").alias("sq"),
        F.max("n").alias("n"),
        F.max("flat").alias("flat"),
    )
    n, k = F.col("n"), F.col("k")
    flat = F.raise_error(
        F.concat_ws(" ", F.lit("sample"), "sample", F.lit("is constant-ranked: all its values tie, so its order says nothing"))
    ).cast("double")
    covered = F.raise_error(
        F.concat_ws(" ", F.lit("set"), "set_name", F.lit("is the complete gene universe: no gene is left outside it to compare with"))
    ).cast("double")
    weightless = F.raise_error(
        F.concat_ws(" ", F.lit("the members of set"), "set_name", F.lit("weigh nothing in sample"), "sample")).cast("double")
    raw = (
        F.when(F.col("flat") & F.lit(flat_samples != "keep"), flat)
        .when(k == n, covered)
        .when(F.col("sw") == 0, weightless)
        .otherwise(
            F.col("swq") / F.col("sw") - (n * (n + 1) / F.lit(2.0) - F.col("sq")) / (n - k)
        )
    )
    window = (k >= min_size) & (k <= (F.lit(max_size) if max_size is not None else n))
    if coverage == "always":
        # The checks sit in the filter, so the error does not depend on the size window.
        scored = sums.withColumn("score", raw).filter(F.col("score").isNotNull()).filter(window)
    elif coverage == "window":
        scored = sums.filter(window).withColumn("score", raw)
    else:
        raise ValueError(f"unknown coverage rule {coverage!r}")
    scores = scored.select("sample", "set_name", "score")
    return normalize_scores(scores if no_sets == "empty" else _not_empty(scores), normalization)


def _not_empty(scores: DataFrame) -> DataFrame:
    """The scores, or an error if there are none: a counted row that fails, and is dropped otherwise. The count
    reads the score, so both sides need the same columns and share one shuffle."""
    none = F.raise_error(F.lit("no gene set has members of the expression within the size limits")).cast("boolean")
    counted = scores.agg(F.count("score").alias("_n")).filter(F.when(F.col("_n") == 0, none).otherwise(False))
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in scores.schema.fields]
    return scores.unionByName(counted.select(*columns))


def score_by_walk(
    expression: DataFrame,
    gene_sets: DataFrame | CompiledGeneSets,
    *,
    alpha: float = 0.25,
    correl_norm_type: str = "rank",
    strategy: str = "auto",
) -> DataFrame:
    """The same score from running sums along each set's hits, visited from high to low rank.

    Between two hits both running distributions move by known amounts, so only hit rows are kept:
    a hit's cumulative weight is multiplied by the number of steps until the next hit.
    """
    compiled = gene_sets if isinstance(gene_sets, CompiledGeneSets) else compile_gene_sets(gene_sets)
    clean = finite_expression(expression)
    ranked = weighted_ranks(clean, check_alpha(alpha), correl_norm_type, strategy)
    hits = ranked.join(compiled.side(), "gene")
    down = Window.partitionBy("sample", "set_name").orderBy(F.col("q").desc())
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = hits.select(
        "sample",
        "set_name",
        "n",
        "flat",
        "w",
        F.sum("w").over(so_far).alias("hit_weight"),
        F.row_number().over(down).alias("hit_no"),
        (F.col("q") - F.coalesce(F.lead("q").over(down), F.lit(0))).alias("steps"),
    )
    sums = walked.groupBy("sample", "set_name", "n", "flat").agg(
        F.sum(F.col("hit_weight") * F.col("steps")).alias("hit_area"),
        F.sum(F.col("hit_no") * F.col("steps")).alias("hit_steps"),
        F.sum("w").alias("sw"),
        F.count(F.lit(1)).alias("k"),
    )
    n, k = F.col("n"), F.col("k")
    miss_area = (n * (n + 1) / F.lit(2.0) - F.col("hit_steps")) / (n - k)
    covered = F.raise_error(
        F.concat_ws(" ", F.lit("the walk over set"), "set_name", F.lit("has no misses: it is the complete gene universe"))).cast("double")
    flat = F.raise_error(
        F.concat_ws(" ", F.lit("no walk over sample"), "sample", F.lit("as it is constant-ranked"))).cast("double")
    return sums.select(
        "sample",
        "set_name",
        F.when(F.col("flat"), flat).when(k == n, covered).otherwise(F.col("hit_area") / F.col("sw") - miss_area).alias("score"),
    )


def normalize_scores(scores: DataFrame, normalization: str, *, zero_range: str = "zero") -> DataFrame:
    """``sample_zscore`` per sample, or ``global_range`` over the whole score table."""
    if normalization == "raw":
        return scores
    if normalization == "sample_zscore":
        stats = scores.groupBy("sample").agg(
            F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s")
        )
        z = F.when(F.col("_s") == 0, F.lit(0.0)).otherwise((F.col("score") - F.col("_m")) / F.col("_s"))
        return scores.join(stats, "sample").select("sample", "set_name", z.alias("score"))
    if normalization != "global_range":
        raise ValueError(f"unknown normalization {normalization!r}")
    span = scores.agg((F.max("score") - F.min("score")).alias("_span"))
    flat = (
        F.raise_error(F.lit("all scores are equal: their range is zero and can't be divided by")).cast("double")
        if zero_range == "error"
        else F.lit(0.0)
    )
    scaled = F.when(F.col("_span") == 0, flat).otherwise(F.col("score") / F.col("_span"))
    # One-row side: always a broadcast of a single number.
    return scores.join(F.broadcast(span)).select("sample", "set_name", scaled.alias("score"))


def score_gsva(
    expression: DataFrame,
    gene_sets: DataFrame | CompiledGeneSets,
    *,
    alpha: float = 0.25,
    min_size: int = 1,
    max_size: int | None = None,
    normalize: bool = False,
    strategy: str = "auto",
) -> DataFrame:
    """Variant with the coverage check before the size filter and a strict range normalisation."""
    raw = score(
        expression, gene_sets, alpha=alpha, min_size=min_size, max_size=max_size,
        coverage="always", flat_samples="keep", strategy=strategy,
    )
    return normalize_scores(raw, "global_range", zero_range="error") if normalize else raw


def score_matrix(scores: DataFrame, set_names: list[str]) -> DataFrame:
    """Samples by sets, columns in the order given (the names bound the width)."""
    return scores.groupBy("sample").pivot("set_name", list(set_names)).agg(F.first("score"))


def qualifying_sets(
    gene_sets: DataFrame, universe: DataFrame, min_size: int = 15, max_size: int = 500
) -> DataFrame:
    """Sets whose overlap with the universe is in range: ``set_name, matched``."""
    return (
        gene_sets.select("set_name", "gene")
        .dropDuplicates()
        .join(universe.select("gene").dropDuplicates(), "gene", "left_semi")
        .groupBy("set_name")
        .agg(F.count(F.lit(1)).alias("matched"))
        .filter(F.col("matched").between(min_size, max_size))
    )


def set_prefix(qualifying: DataFrame, n: int) -> DataFrame:
    """First ``n`` qualifying sets by name (a top-k report)."""
    return qualifying.orderBy("set_name").limit(n)


def average_duplicates(expression: DataFrame) -> DataFrame:
    """Mean of rows sharing a symbol; the symbol keeps its first row position."""
    return expression.groupBy("sample", "gene").agg(
        F.min("row_idx").alias("row_idx"), F.avg("value").alias("value")
    )


def align(expression: DataFrame, gene_sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep set genes that are expressed, then expression rows whose gene is in some set."""
    expressed = expression.select("gene").dropDuplicates()
    kept = gene_sets.join(expressed, "gene", "left_semi")
    used = kept.select("gene").dropDuplicates()
    return expression.join(used, "gene", "left_semi"), kept


def checksum(scores: DataFrame) -> DataFrame:
    """Score total and output shape."""
    return scores.agg(
        F.sum("score").alias("checksum"),
        F.countDistinct("sample").alias("n_samples"),
        F.countDistinct("set_name").alias("n_sets"),
    )
