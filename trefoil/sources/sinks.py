"""Writers: orbit dumps, totals, expression and set files, result logs and saved maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trefoil.functions.patterns import N_EDGE_ORBITS, N_NODE_ORBITS


def write_totals(totals: DataFrame, path: str) -> None:
    """Lines ``graphlet<TAB>count`` in graphlet order (at most 29 rows, one file)."""
    lines = totals.orderBy("graphlet").select(F.concat_ws("\t", "graphlet", "n").alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_node_orbits(orbits: DataFrame, path: str, size: int = 5) -> None:
    """One line per node in id order, counts separated by spaces; parts are in order too."""
    cols = [f"o{o}" for o in range(N_NODE_ORBITS[size])]
    orbits.orderBy("v").select(F.concat_ws(" ", *cols).alias("value")).write.mode("overwrite").text(path)


def write_edge_orbits(orbits: DataFrame, path: str, size: int = 5) -> None:
    """One line per edge in input order."""
    cols = [f"e{o}" for o in range(N_EDGE_ORBITS[size])]
    orbits.orderBy("edge_id", "src", "dst").select(F.concat_ws(" ", *cols).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def write_expression(expression: DataFrame, path: str, samples: list[str]) -> None:
    """Genes-by-samples TSV with a header, rows in their original order, shortest exact numbers."""
    wide = expression.groupBy("row_idx", "gene").pivot("sample", samples).agg(F.first("value"))
    wide.orderBy("row_idx").select(F.col("gene").alias("gene_symbol"), *[F.col(f"`{s}`") for s in samples]).write.mode(
        "overwrite"
    ).csv(path, sep="\t", header=True)


def write_gene_sets(gene_sets: DataFrame, path: str) -> None:
    """One JSON object per line ``{"name": [symbols]}``; each set is one bounded row."""
    rows = gene_sets.groupBy("set_name").agg(F.sort_array(F.collect_set("gene")).alias("genes"))
    rows.orderBy("set_name").select(
        F.to_json(F.map_from_arrays(F.array("set_name"), F.array("genes"))).alias("value")
    ).write.mode("overwrite").text(path)


def append_results(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def save_layout(layout: DataFrame, path: str) -> None:
    """Positions and optimiser state, to go on from later."""
    layout.write.mode("overwrite").parquet(path)


def load_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
