"""What the operators of this subpackage share: table access, checkpoints and joins on keys that may be hot."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of the table that tells how full each bucket of keys is.
BUCKETS = 4096
#: A bucket of more than so many times the mean bucket is split, into parts of about that size.
FULL = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which driver and executors must both reach.

    Only where the session names none and runs in this one process (tests), it gets one of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="turnlake-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Queries made in here free their shuffles as soon as they have run."""
    freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(freed, None)
    spark.conf.set(freed, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(freed)
        else:
            spark.conf.set(freed, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the session names; the shuffles that it was made from are freed at once."""
    shared_folder(df.sparkSession)
    with _freeing(df.sparkSession):
        return df.select("*").checkpoint()  # a query of its own: whether it frees is settled when it is made


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder of the checkpoints, read again; the shuffles that it was made from are freed at once."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _freeing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(modulus: int, remainder: int, key: str = "doc_id"):
    """True where crc32 of the key as text leaves this remainder; a null key counts as ''."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def uneven(spark: SparkSession, most: int, total: int) -> bool:
    """Whether a key with most of the total rows has more than FULL times a task's share."""
    return most * int(spark.conf.get("spark.sql.shuffle.partitions")) > FULL * total


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], weight: str, told: list[Column], how: str = "inner", hot: bool = True) -> DataFrame:
    """rows joined with groups (one row a key, with the number of rows that carry it) where a key may hold most rows.

    Keys are dealt into BUCKETS by hash. A bucket that holds more than its share of the rows is split into
    parts by the hash of told, and its groups are repeated in each, so no key is one task's. Broadcast are
    BUCKETS numbers. Where the caller knows that no key is hot, it is a plain join.
    """
    if not hot:
        return rows.join(groups, on, how)
    named = F.pmod(F.xxhash64(*on), F.lit(BUCKETS)).cast("int").alias("_bucket")
    filled = groups.groupBy(named).agg(F.sum(weight).alias("_filled"))
    share = F.greatest(F.sum("_filled").over(Window.partitionBy()) / BUCKETS, F.lit(1.0)) * FULL
    parts = filled.select("_bucket", F.ceil(F.col("_filled") / share).cast("int").alias("_parts"))
    left = rows.select("*", named).join(F.broadcast(parts), "_bucket", how).withColumn("_part", F.pmod(F.xxhash64(*told), F.coalesce("_parts", F.lit(1))).cast("int"))
    right = groups.select("*", named).join(F.broadcast(parts), "_bucket").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return left.drop("_bucket", "_parts").join(right.drop("_bucket", "_parts"), [*on, "_part"], how).drop("_part")


def numbered(rows: DataFrame, by: list[str], within: str, order: list[Column]) -> DataFrame:
    """rows with nth, from 0 without gaps in each group of by, in the order of within (a small whole number) and then order.

    Each value of within is numbered by itself and moved up by the counts of the values before: no task sees
    a whole group, and the counts are at most groups x values.
    """
    counts = rows.groupBy(*by, within).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(within))
    before = counts.select(*by, within, (upto - F.col("_n")).alias("_before"))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by, within).orderBy(*order)))
    return placed.join(before, [*by, within]).withColumn("nth", (F.col("_before") + F.col("_place") - 1).cast("long")).drop("_before", "_place")
