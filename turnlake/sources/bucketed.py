"""Parents and their children in the same buckets, so that joins of the two move neither.

Worth it where the pair is joined more than once: writing it moves each row once. A parent with more children than a bucket should hold
has them spread over several buckets by a salt, and a row in each of these.
"""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.sources.folders import shared


#: Rows that a bucket should hold at most: with more, there are more buckets.
BUCKET_ROWS = 1_000_000
#: Slots a bucket that keys are dealt to by hash, to tell where a hot one can be.
SLOTS = 64


class Pair(NamedTuple):
    parents: DataFrame
    children: DataFrame
    key: str
    foreign: str

    def _above(self, parents: DataFrame) -> DataFrame:
        return parents.select(F.col(self.key).alias(self.foreign), "salt")

    def orphans(self) -> DataFrame:
        """Children whose parent is missing (a null key has none to miss)."""
        rows = self.children.where(F.col(self.foreign).isNotNull())
        return rows.join(self._above(self.parents).hint("merge"), [self.foreign, "salt"], "left_anti").drop("salt")

    def without_children_of(self, gone: str) -> DataFrame:
        """The children that stay when the parents that a condition names are deleted."""
        return self.children.join(self._above(self.parents.where(gone)).hint("merge"), [self.foreign, "salt"], "left_anti").drop("salt")

    def joined(self) -> DataFrame:
        """Each child with its parent's columns."""
        above = self.parents.withColumnRenamed(self.key, self.foreign)
        return self.children.join(above.hint("merge"), [self.foreign, "salt"]).drop("salt")


def together(parents: DataFrame, children: DataFrame, key: str, foreign: str, buckets: int) -> Pair:
    """Both written to the shared folder, bucketed by key and salt. Neither may have a column named salt.

    There are as many buckets as told, or more where one would hold over BUCKET_ROWS, so that a task's share doesn't grow with the tables.
    A parent counts as hot with over a buckets-th of all children, so there are fewer hot ones than buckets; each of its salts
    holds about a quarter of a bucket. Children are counted by slots first, and by key only in slots that hold as many.
    """
    if "salt" in parents.columns or "salt" in children.columns:
        raise ValueError("a column is named salt")
    spark, total = children.sparkSession, children.count()
    buckets = max(buckets, math.ceil(max(total, parents.count()) / BUCKET_ROWS))
    most = max(total / buckets, 1)
    keys = children.where(F.col(foreign).isNotNull()).select(F.col(foreign).alias("_hot"), F.pmod(F.xxhash64(foreign), F.lit(buckets * SLOTS)).alias("_slot"))
    full = keys.groupBy("_slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("_slot")
    counts = keys.join(F.broadcast(full), "_slot", "left_semi").groupBy("_hot").agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(counts.where(F.col("n") > most).select("_hot", F.ceil(F.col("n") * 4 / most).cast("int").alias("salts")))
    salt = F.pmod(F.xxhash64(*children.columns), F.coalesce("salts", F.lit(1))).cast("int")
    low = children.join(hot, F.col(foreign) == F.col("_hot"), "left").select(*children.columns, salt.alias("salt"))
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    high = parents.join(hot, F.col(key) == F.col("_hot"), "left").select(*parents.columns, salts.alias("salt"))

    def written(df: DataFrame, by: str) -> DataFrame:
        name = f"turnlake_{uuid.uuid4().hex}"
        df.repartition(buckets, by, "salt").write.bucketBy(buckets, by, "salt").sortBy(by, "salt").option("path", shared(spark, "buckets")).saveAsTable(name)
        return spark.table(name)

    return Pair(written(high, key), written(low, foreign), key, foreign)
