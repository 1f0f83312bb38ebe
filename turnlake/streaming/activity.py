"""The latest activity of conversations, kept in a store by batches of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.operators.reads import heads
from turnlake.sources.schemas import DEFAULT_PROJECT, DEFAULT_TITLE
from turnlake.sources.store import Store


def upsert(store: Store, name: str, profile: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: activity (conversation_id, created_at) moves its conversations up, and makes those that aren't there.

    The number of the batch is committed with its changes, so a batch that comes again changes nothing. A commit
    holds a row for each conversation of the batch; the stored ones are met by a semi join on these.
    """

    def apply(batch: DataFrame, number: int) -> None:
        now = store.manifest()
        if now["applied"].get(name, -1) >= number:
            return
        new = heads(batch).select(F.col("conversation_id").cast("string").alias("id"), F.col("created_at").alias("first"), F.col("updated_at").alias("last"))
        old = store.read("conversations", now).join(new.select("id"), "id", "left_semi").select("id", F.col("created_at").alias("old_first"), F.col("updated_at").alias("old_last"), F.lit(True).alias("there"))
        met = new.join(old, "id", "left")
        fresh = lambda v: F.when(F.col("there").isNull(), F.lit(v))
        rows = met.select(
            "id", fresh(DEFAULT_PROJECT[0]).alias("project_id"), fresh(DEFAULT_TITLE).alias("title"), fresh(profile).alias("model_profile"),
            F.least("first", "old_first").alias("created_at"), F.greatest("last", "old_last").alias("updated_at"),
        )
        store.append({"conversations": rows}, since=now["version"], applied={name: number})

    return apply
