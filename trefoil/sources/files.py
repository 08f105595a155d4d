"""File readers: graphs, expression matrices, gene sets, probe maps and result logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trefoil.operators.graph import clean_edges


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with an id that grows with the position in the file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")


def read_graph(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(edges(edge_id, x, y), nodes(v))`` from a header ``V E`` and lines ``src dst``.

    Lenient reading drops self loops and repeated edges; ``strict`` rejects them. Ids outside
    0..V-1, negative ones included, are always errors.
    """
    lines = _lines(spark, path)
    header = lines.filter(F.col("line") == 0).first()
    if header is None or len(header["value"].split()) < 2:
        raise ValueError(f"{path} does not start with a 'V E' header")
    n_nodes = int(header["value"].split()[0])
    parts = F.split(F.trim("value"), r"\s+")
    raw = (
        lines.filter((F.col("line") > 0) & (F.trim("value") != ""))
        .select(F.col("line").alias("edge_id"), parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))
    )
    nodes = spark.range(n_nodes).select(F.col("id").alias("v"))
    return clean_edges(raw, n_nodes, strict), nodes


def _header(spark: SparkSession, path: str, first: str) -> list[str]:
    row = _lines(spark, path).filter(F.col("line") == 0).first()
    names = [] if row is None else row["value"].rstrip("\r\n").split("\t")
    if not names or names[0] != first:
        raise ValueError(f"{path} header does not start with {first}")
    return names


def read_expression(spark: SparkSession, path: str, n_samples: int | None = None,
                    id_column: str = "gene_symbol") -> DataFrame:
    """Long expression from a TSV (gzip by extension): the first ``n_samples`` columns by position,
    repeated symbols averaged and kept at their first row. Short or malformed lines fail."""
    names = _header(spark, path, id_column)
    samples = names[1:] if n_samples is None else names[1: n_samples + 1]
    if n_samples is not None and len(samples) < n_samples:
        raise ValueError(f"{path} has {len(names) - 1} samples, need {n_samples}")
    if len(set(samples)) < len(samples):
        raise ValueError(f"{path} names a sample twice")
    # Positional names keep odd sample names out of the plan.
    cols = [f"s{c}" for c in range(len(names) - 1)]
    schema = T.StructType(
        [T.StructField("gene", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in cols]
    )
    wide = spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST", enforceSchema=True)
    taken = cols[: len(samples)]
    long = wide.select(F.monotonically_increasing_id().alias("row_idx"), "gene", *taken).unpivot(
        ["row_idx", "gene"], taken, "col", "value"
    )
    label = F.element_at(
        F.create_map(*[F.lit(x) for pair in zip(taken, samples) for x in pair]), F.col("col")
    )
    return (
        long.withColumn("sample", label)
        .groupBy("sample", "gene")
        .agg(F.min("row_idx").alias("row_idx"), F.avg("value").alias("value"))
        .select("sample", "row_idx", "gene", "value")
    )


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """``set_name, gene`` from ``{name: [symbols]}`` or ``{name: {"geneSymbols": [symbols]}}``."""
    text = spark.read.text(path, wholetext=True)
    flat = F.from_json("value", "map<string,array<string>>", {"mode": "PERMISSIVE"})
    nested = F.from_json("value", "map<string,struct<geneSymbols:array<string>>>", {"mode": "PERMISSIVE"})
    is_nested = F.col("value").contains('"geneSymbols"')
    rows = text.filter(is_nested).select(F.explode(nested).alias("set_name", "v")).select(
        "set_name", F.explode("v.geneSymbols").alias("gene")
    ).unionByName(
        text.filter(~is_nested).select(F.explode(flat).alias("set_name", "v")).select(
            "set_name", F.explode("v").alias("gene")
        )
    )
    return rows.filter(F.col("gene") != "").dropDuplicates()


def read_probe_map(spark: SparkSession, path: str, id_column: str = "id", symbol_column: str = "gene") -> DataFrame:
    """``id, gene``; the first line of an id wins, blank and '.' symbols are dropped."""
    table = spark.read.csv(path, sep="\t", header=True).select(
        F.monotonically_increasing_id().alias("line"), F.col(id_column).alias("id"), F.trim(symbol_column).alias("gene")
    )
    named = table.filter(F.col("gene").isNotNull() & ~F.col("gene").isin("", "."))
    return named.groupBy("id").agg(F.min_by("gene", "line").alias("gene"))


def map_symbols(expression: DataFrame, probes: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Replace ids by symbols (unmapped rows go), keep the universe, average repeated symbols."""
    named = expression.withColumnRenamed("gene", "id").join(probes, "id").drop("id")
    if universe is not None:
        named = named.join(universe.select("gene").dropDuplicates(), "gene", "left_semi")
    return named.groupBy("sample", "gene").agg(F.min("row_idx").alias("row_idx"), F.avg("value").alias("value"))


def subsample(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement by hash order of the id; the same rows on every run."""
    return points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def read_results(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """JSON-lines records; the last record of a key wins."""
    table = spark.read.json(path).withColumn("_line", F.monotonically_increasing_id())
    last = Window.partitionBy(*keys).orderBy(F.col("_line").desc())
    return table.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn", "_line")


def read_timings(spark: SparkSession, path: str, key: str) -> DataFrame:
    """CSV timings in long form; empty cells are null."""
    table = spark.read.csv(path, header=True)
    values = [c for c in table.columns if c != key]
    wide = table.select(F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in values])
    return wide.unpivot([key], values, "impl", "seconds")


def pending(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a finished record."""
    return jobs.join(done.select(*keys).dropDuplicates(), keys, "left_anti")
