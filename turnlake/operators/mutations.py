"""Mutations as rewrites: each takes tables and returns tables. A batch may name a row more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions import text as X
from turnlake.operators.reads import newest_of_each, sliced
from turnlake.sources.folders import settled
from turnlake.sources.schemas import DEFAULT_TITLE, ROLES


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by order, then by all columns: one aggregation that combines before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    told = [*order, *(c for c in rest if c not in order)]
    return rows.groupBy(key).agg(F.min(F.struct(*told)).alias("first")).select(key, *(F.col("first")[c].alias(c) for c in rest)).select(*rows.columns)


def made_conversations(conversations: DataFrame, requests: DataFrame, projects: DataFrame) -> DataFrame:
    """The conversations that requests make: id, project_id, title?, model_profile, at.

    The id is the request's, so that a retried task or a second read makes the same row; of requests with
    one id the first counts, and none whose id is taken. Titles are stripped, profiles kept as they are.
    """
    new = requests.withColumn("title", X.strip(F.coalesce("title", F.lit(DEFAULT_TITLE))))
    ok = new.where((F.length("title") > 0) & ~X.is_blank(F.col("model_profile"))).join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    once = first_of_each(ok.select("id", "project_id", "title", "model_profile", "at"), "id", "at").join(conversations.select("id"), "id", "left_anti")
    return once.select("id", "project_id", "title", "model_profile", F.col("at").alias("created_at"), F.col("at").alias("updated_at"))


def create_conversations(conversations: DataFrame, requests: DataFrame, projects: DataFrame) -> DataFrame:
    return conversations.unionByName(made_conversations(conversations, requests, projects))


def rename(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id, new_title, at. Blank titles change nothing; others move the conversation up."""
    ok = changes.select("id", X.strip(F.col("new_title")).alias("new_title"), "at").where("new_title <> ''")
    return _touched(conversations, ok, "title", "new_title")


def set_profile(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id, new_profile, at; not checked against the profiles."""
    return _touched(conversations, changes.where(~X.is_blank(F.col("new_profile"))), "model_profile", "new_profile")


def _touched(conversations: DataFrame, changes: DataFrame, column: str, new: str) -> DataFrame:
    """Of several changes of one conversation the latest counts."""
    joined = conversations.join(newest_of_each(changes.select("id", new, "at"), "id", "at", new), "id", "left")
    return joined.withColumns({column: F.coalesce(new, column), "updated_at": F.coalesce("at", "updated_at")}).select(*conversations.columns)


def applied(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """Whether each change found its conversation."""
    return changes.join(conversations.select("id", F.lit(True).alias("hit")), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("applied"))


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the deleted: used for the parents and, by foreign key, for what hangs on them."""
    return rows.join(gone.select(key), key, "left_anti")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with place, from 1 without gaps, in the order of these columns.

    Rows are dealt by ranges of all the columns, so equal values of the first one don't meet in one task;
    each range is numbered by itself and moved up by the rows of those before. Only rows that are alike in all columns are
    sure to be together. Which range a row is in is settled once, by a checkpoint, since a sample draws the ranges.
    """
    dealt = settled(sliced(rows, *order))
    counts = dealt.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("slice", (F.sum("n").over(Window.orderBy("slice")) - F.col("n")).alias("before"))  # a row a partition
    placed = dealt.withColumn("nth_here", F.row_number().over(Window.partitionBy("slice").orderBy(*order)))
    return placed.join(before, "slice").withColumn("place", F.col("before") + F.col("nth_here")).drop("slice", "before", "nth_here")


def acceptable(new: DataFrame, conversations: DataFrame) -> DataFrame:
    """The messages that may be stored: a known role and conversation, content that isn't blank."""
    ok = new.where(F.col("role").isin(*ROLES) & ~X.is_blank(F.col("content")))
    return ok.join(conversations.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")


def touched_by(conversations: DataFrame, added: DataFrame) -> DataFrame:
    """Conversations moved up to their latest new message (conversation_id, at)."""
    latest = added.groupBy(F.col("conversation_id").alias("id")).agg(F.max("at").alias("at"))
    return conversations.join(latest, "id", "left").withColumn("updated_at", F.greatest("updated_at", F.coalesce("at", "updated_at"))).select(*conversations.columns)


def placed_messages(rows: DataFrame, high_water: int) -> tuple[DataFrame, int]:
    """Acceptable messages with ids that go on from the highest ever given, and the highest id then.

    In the order of nth within a batch, ties by the other columns.
    """
    placed = numbered(rows.select("nth", "conversation_id", "at", "role", "content", "model_profile"), "nth", "conversation_id", "at", "role", "content", "model_profile")
    made = placed.select((F.col("place") + high_water).cast("long").alias("id"), "conversation_id", "role", "content", "model_profile", F.col("at").alias("created_at"))
    return made, high_water + placed.count()


def add_messages(messages: DataFrame, conversations: DataFrame, new: DataFrame, high_water: int) -> tuple[DataFrame, DataFrame, int]:
    """new: conversation_id, role, content, model_profile, at, nth. Returns both tables and the highest id ever given; content stays as it is."""
    added, top = placed_messages(acceptable(new, conversations), high_water)
    return messages.unionByName(added), touched_by(conversations, added.withColumnRenamed("created_at", "at")), top


def seed(rows: DataFrame, defaults: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Adds the defaults whose key isn't there: the first write wins, also among the defaults (by order, a column of theirs)."""
    once = first_of_each(defaults, key, *([order] if order else []))
    return rows.unionByName(once.join(rows.select(key), key, "left_anti").select(*rows.columns))


