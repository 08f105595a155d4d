"""Science-shaped inputs derived from the supplied business tables (whole tables, no subsets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expression(spark: SparkSession, sf_dir: str, gene: str = "p_partkey") -> DataFrame:
    """Dense long expression table: every part in every nation, summed quantity or 0.

    ``gene='p_brand'`` gives several rows per symbol.
    """
    sold = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_quantity")
        .join(
            table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        .join(
            table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("sample")),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        .groupBy(F.col("l_partkey").alias("row_idx"), "sample")
        .agg(F.sum("l_quantity").alias("sold"))
    )
    # The nations are the samples: a fixed dimension of 25 keys, laid out on every part row.
    nations = [
        r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()
    ]
    columns = {"p_partkey", gene}
    cells = table(spark, sf_dir, "part").select(*sorted(columns)).select(
        F.col("p_partkey").alias("row_idx"),
        F.col(gene).cast("string").alias("gene"),
        F.explode(F.array(*[F.lit(n).cast("int") for n in nations])).alias("sample"),
    )
    return cells.join(sold, ["row_idx", "sample"], "left").select(
        "sample", "row_idx", "gene", F.coalesce("sold", F.lit(0.0)).alias("value")
    )


def gene_sets(spark: SparkSession, sf_dir: str, by: str = "p_brand") -> DataFrame:
    """Parts grouped by brand (or type) as named sets."""
    return table(spark, sf_dir, "part").select(
        F.col(by).alias("set_name"), F.col("p_partkey").cast("string").alias("gene")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors as doubles: ``id, features, label``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label"),
    )


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sparse rows ``id, dim, weight``: the quantity of every part they bought."""
    sold = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    bought = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("id"), F.col("l_partkey").alias("dim"), F.col("l_quantity").alias("weight")
    )
