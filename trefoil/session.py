"""Session helpers: a tuned local session, lineage cuts and the size bound of broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# A side is broadcast only when a count proves it has no more rows than this.
BROADCAST_ROWS = 2_000_000


def get_spark(app: str = "trefoil", cpus: int | str | None = None) -> SparkSession:
    """A session for tests, benches and scripts; on a cluster pass your own session instead."""
    n = str(cpus or os.environ.get("BENCH_CPUS") or os.cpu_count() or 4)
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("TREFOIL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_trefoil_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="trefoil-pkg-")
    sc.addPyFile(shutil.make_archive(f"{folder}/trefoil", "zip", root.parent, root.name))
    sc._trefoil_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make a scratch one only for a local session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trefoil-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before iterative jobs")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back with a flat plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder. Loops use it instead of ``cut_lineage``: a checkpoint keeps the
    size estimate of its plan, which joins multiply, so it gets longer with every round until planning takes all the time."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
