"""Shared pieces: words, stored stages, global row numbers, joins that stand a hot key, binary search in a literal."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trefoil.session import ensure_checkpoint_dir

#: White space of the word rule: a word is a run of other characters.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A side with at most this many rows may be broadcast; the count is taken first.
BROADCAST_ROWS = 200_000
#: A key is hot when it holds more than one part in so many of all rows, so there are never more hot keys than this.
HOT_PARTS = 2000
#: Copies of the small side of a salted join.
SALTS = 16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared checkpoint folder and read it back: the plan starts anew
    there, and the rows outlive any executor."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a stored stage that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._llm_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def text_of(df: DataFrame) -> Column:
    """The whole text, null as empty."""
    return F.coalesce(df["text"], F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array, in order; none for an empty or blank text."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE + "+"))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array: each pass joins every entry with the one 1, 2, 4, ... places before, so n entries take
    log2(n) passes and nothing is appended to a growing array."""
    steps = F.array(*[F.lit(1 << i) for i in range(31)])

    def scan(v: Column) -> Column:
        return F.aggregate(F.filter(steps, lambda s: s < F.size(v)), v, lambda acc, s: F.transform(
            acc, lambda x, i: F.when(i >= s, combine(x, F.get(acc, i - s))).otherwise(x)))

    return let(values, scan)


def rows_of(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small table made on the driver (its size is bounded by parameters), without Python on the executors."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    data = json.dumps([dict(zip(names, r)) for r in rows])
    kind = "array<struct<" + ",".join(":".join(c.strip().split(" ")) for c in schema.split(",")) + ">>"
    one = spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(data), kind)).alias("r"))
    return one.select("r.*")


def search(points: list[int], value: Column) -> Column:
    """How many of the sorted ``points`` are not above ``value``: binary search in a literal array."""
    steps, step = [], 1
    while step <= max(1, len(points)):
        steps.append(step)
        step *= 2
    n, steps = len(points), steps[::-1]
    if not points:
        return F.lit(0)
    array = F.array(*[F.lit(int(p)).cast("long") for p in points]) if n < 64 else F.from_json(
        F.lit(json.dumps([int(p) for p in points])), "array<bigint>")
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, s: F.when((at + s <= n) & (F.get(array, at + s - 1) <= value), at + s).otherwise(at),
    )


def global_index(df: DataFrame, order: list, name: str, rank: str = "_rank", parts: int | None = None) -> DataFrame:
    """Number all rows from 0 in ``order``, stored: a range shuffle, places within the partitions and the offsets of
    the partitions. ``order`` should end in columns that tell rows apart, so that ties spread over partitions."""
    n = parts or partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumns({
        "_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    }), name)
    sizes = sorted((r["_pid"], r["n"]) for r in placed.groupBy("_pid").agg(F.count("*").alias("n")).collect())
    at, offsets = 0, []
    for pid, size in sizes:  # one entry a partition
        offsets.append((pid, at))
        at += size
    offset = F.broadcast(rows_of(df.sparkSession, offsets, "_pid int, _offset bigint"))
    out = placed.join(offset, "_pid").withColumn(rank, F.col("_at") + F.col("_offset")).drop("_pid", "_at", "_offset")
    out._llm_path = placed._llm_path
    return out


def join_by_size(left: DataFrame, right: DataFrame, key: str, salt: Column) -> DataFrame:
    """Left join with a table of one row a key: broadcast if a count proves it small, else salted, because one key
    may hold a third of ``left``."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, "left")
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(
        many, [key, "_salt"], "left").drop("_salt")


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``left`` with a table of one row a key that holds the key's number of rows in ``left``.
    Hot keys, at most HOT_PARTS of them by their definition, are broadcast; the others are shuffled."""
    limit = max(1000, total // HOT_PARTS)
    hot, cold = right.where(F.col(count) > limit), right.where(F.col(count) <= limit)
    met = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return met.unionByName(rest)
