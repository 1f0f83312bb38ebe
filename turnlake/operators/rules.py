"""Integrity rules as queries that must come back empty, and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import text as X
from turnlake.sources.schemas import ROLES


def orphans(child: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    """Rows whose parent is missing (a null key has none to miss)."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)), foreign, "left_anti")


def childless(parent: DataFrame, child: DataFrame, key: str, foreign: str) -> DataFrame:
    return parent.join(child.select(F.col(foreign).alias(key)), key, "left_anti")


def bad_roles(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role").isNull() | ~F.col("role").isin(*ROLES))


def blank(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNull() | X.is_blank(F.col(column)))


def missing(rows: DataFrame, *columns: str) -> DataFrame:
    some = F.lit(False)
    for c in columns:
        some = some | F.col(c).isNull()
    return rows.where(some)


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def stale_profiles(conversations: DataFrame, profiles: DataFrame) -> DataFrame:
    return conversations.join(profiles.select(F.col("key").alias("model_profile")), "model_profile", "left_anti")


def with_known_profiles(conversations: DataFrame, profiles: DataFrame, default: str) -> DataFrame:
    """A profile that isn't configured becomes the default."""
    known = profiles.select(F.col("key").alias("model_profile"), F.col("key").alias("found"))
    return conversations.join(known, "model_profile", "left").withColumn("model_profile", F.coalesce("found", F.lit(default))).drop("found").select(*conversations.columns)


def configured() -> Column:
    """Whether a profile (backend, base_url, model) can answer: the offline one always, another with address and model."""
    told = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return (F.col("backend") == "lorem") | ((F.col("backend") == "vllm") & told("base_url") & told("model"))


def active(sends: DataFrame, at: str) -> DataFrame:
    """The conversations that are generating at a time: sends with started and ended (null while they run)."""
    now = F.lit(at).cast("timestamp")
    return sends.where((F.col("started") <= now) & (F.col("ended").isNull() | (F.col("ended") > now))).select("conversation_id").distinct()


def may_change_model(conversations: DataFrame, generating: DataFrame, profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes (id, new_profile, at) that a page lets through: to a configured profile, of a conversation that isn't generating."""
    known = changes.join(profiles.select(F.col("key").alias("new_profile")), "new_profile", "left_semi")
    return known.join(generating.select(F.col("conversation_id").alias("id")), "id", "left_anti").join(conversations.select("id"), "id", "left_semi")
