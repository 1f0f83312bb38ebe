"""Single flight: which sends are admitted when a conversation answers one at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.operators.mutations import sliced
from turnlake.sources.folders import settled


def busy_periods(sends: DataFrame) -> DataFrame:
    """Adds period to sends (conversation_id, at, until, nth): a number that rises where nothing sent before can still be running.

    What is sent at or after the latest end of all earlier sends is admitted whatever became of them, so
    periods don't depend on one another. Sends are dealt by ranges of conversation and time, so a
    conversation that holds most of them is many tasks': only a row a range and conversation meets the others.
    A send without an end runs for good.
    """
    order = ("conversation_id", "at", "nth")
    never = F.lit("9999-12-31").cast("timestamp")
    dealt = settled(sliced(sends.where("conversation_id IS NOT NULL").withColumn("_end", F.coalesce("until", never)), *order))
    here = Window.partitionBy("slice", "conversation_id").orderBy("at", "nth")
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("conversation_id", "slice").agg(F.max("_end").alias("_end"))
    before = ranges.select("conversation_id", "slice", F.max("_end").over(Window.partitionBy("conversation_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    met = dealt.join(before, ["conversation_id", "slice"])
    upto = F.greatest(F.max("_end").over(earlier), F.col("_carried"))  # skips nulls
    cut = met.withColumn("_cut", F.when(upto.isNull() | (F.col("at") >= upto), 1).otherwise(0))
    local = cut.withColumn("_local", F.sum("_cut").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    # a period that goes on from an earlier range keeps that one's number
    cuts = cut.groupBy("conversation_id", "slice").agg(F.sum("_cut").alias("_cuts"))
    shift = cuts.select("conversation_id", "slice", F.coalesce(F.sum("_cuts").over(Window.partitionBy("conversation_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    return local.join(shift, ["conversation_id", "slice"]).select(*sends.columns, (F.col("_local") + F.col("_shift")).alias("period"))


def admitted(sends: DataFrame) -> DataFrame:
    """Adds admitted to sends (conversation_id, at, until, nth): in order of at and nth, a send is admitted if the one admitted before has ended.

    Each busy period is folded where it lies, row by row in sorted order with one time kept, so its length takes time
    but no memory. Sends without a conversation are left out; those that tie in at and nth count in any order.
    """
    key, names = ("conversation_id", "period"), sends.columns
    rows = busy_periods(sends).withColumn("_key", F.xxhash64(*key)).withColumns({"_at": F.unix_micros("at"), "_end": F.unix_micros("until")})
    ordered = rows.repartition(*key).sortWithinPartitions(*key, "at", "nth")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, free = None, 0
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            period, at = get("period").to_pylist(), get("_at").to_numpy(zero_copy_only=False)
            conversation, end = get("_key").to_pylist(), pc.fill_null(get("_end"), np.iinfo(np.int64).max).to_numpy()
            took = []
            for k, t, e in zip(zip(conversation, period), at.tolist(), end.tolist()):
                ok = k != last or t >= free
                if ok:
                    last, free = k, e
                took.append(ok)
            yield pa.RecordBatch.from_arrays([*(get(c) for c in names), pa.array(took, pa.bool_())], names=[*names, "admitted"])

    return ordered.mapInArrow(fold, T.StructType([*sends.schema.fields, T.StructField("admitted", T.BooleanType())]))
