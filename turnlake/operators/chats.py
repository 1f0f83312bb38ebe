"""What a chat page does, set-wise: opening, healing, new chats, deletion with a replacement, sending.

Every function takes a batch (one row for each page or send) and returns tables; where a reference id
has to be made up, the batch brings it, so that a retry makes the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions import text as X
from turnlake.operators import flights as V
from turnlake.operators import mutations as M
from turnlake.operators import reads as R
from turnlake.operators import rules as C
from turnlake.sources.folders import settled
from turnlake.sources.schemas import DEFAULT_PROJECT, DEFAULT_TITLE

CONVERSATION = ("id", "project_id", "title", "model_profile", "created_at", "updated_at")


def _latest(conversations: DataFrame) -> DataFrame:
    """The latest conversation of each project, as project_id and a struct top: one aggregation that combines before the shuffle."""
    later = lambda c: -F.unix_micros(c)  # noqa: E731  the least is the latest, and then the least id counts
    tops = conversations.groupBy("project_id").agg(F.min(F.struct(later("updated_at").alias("u"), later("created_at").alias("c"), *CONVERSATION)).alias("top"))
    return tops.select("project_id", "top")


def opened(conversations: DataFrame, profiles: DataFrame, requests: DataFrame, default: str) -> DataFrame:
    """The conversation each page (page, project_id, new_id, at) opens with: its project's latest one, or where there is none a new chat, one for all its pages; a profile that isn't configured becomes the default."""
    asked = requests.select("page", "project_id", "new_id", "at")
    met = asked.join(_latest(conversations), "project_id", "left")
    first = M.first_of_each(asked.select("project_id", "at", "new_id"), "project_id", "at", "new_id")
    made = first.select("project_id", F.struct(F.col("new_id").alias("id"), "project_id", F.lit(DEFAULT_TITLE).alias("title"), F.lit(default).alias("model_profile"), F.col("at").alias("created_at"), F.col("at").alias("updated_at")).alias("fresh"))
    shown = met.join(made, "project_id").select("page", *(F.coalesce(F.col("top")[c], F.col("fresh")[c]).alias(c) for c in CONVERSATION))
    return C.with_known_profiles(shown, profiles, default)


def healed(conversations: DataFrame, profiles: DataFrame, requests: DataFrame, default: str) -> DataFrame:
    """For pages (page, conversation_id, new_id, at) the conversation they show, or a new chat where it is gone."""
    there = requests.select("page", "conversation_id", "new_id", "at").join(conversations.withColumnRenamed("id", "conversation_id"), "conversation_id", "left")
    gone = F.col("title").isNull()
    row = {"project_id": F.lit(DEFAULT_PROJECT[0]), "title": F.lit(DEFAULT_TITLE), "model_profile": F.lit(default), "created_at": F.col("at"), "updated_at": F.col("at")}
    shown = there.select("page", F.when(gone, F.col("new_id")).otherwise(F.col("conversation_id")).alias("id"), gone.alias("created"), *(F.when(gone, v).otherwise(F.col(c)).alias(c) for c, v in row.items()))
    return C.with_known_profiles(shown, profiles, default)


def new_chats(conversations: DataFrame, messages: DataFrame, requests: DataFrame) -> DataFrame:
    """For pages (page, conversation_id, new_id) that ask for a new chat: its id, which is the present one if that is unnamed and empty."""
    empty = C.childless(conversations.where(F.col("title") == DEFAULT_TITLE).select("id"), messages, "id", "conversation_id").select(F.col("id").alias("conversation_id"), F.lit(True).alias("reused"))
    found = requests.join(empty, "conversation_id", "left").withColumn("reused", F.coalesce("reused", F.lit(False)))
    return found.select("page", F.when(F.col("reused"), F.col("conversation_id")).otherwise(F.col("new_id")).alias("id"), "reused")


def deleted(conversations: DataFrame, messages: DataFrame, active: DataFrame, requests: DataFrame, default: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables without the conversations that pages (page, conversation_id, shown, new_id, at) delete, and what each page shows next.

    A conversation that is generating (active: conversation_id), or isn't there, stays as it is. A page that showed
    what it deleted gets the latest one left of that project, or a new chat (new_id) where none is left: one for
    all such pages of a project, and among the conversations returned.
    """
    asked = requests.select("page", "conversation_id", "shown", "new_id", "at")
    there = asked.join(conversations.select(F.col("id").alias("conversation_id"), "project_id"), "conversation_id", "left")
    gone = there.where("project_id IS NOT NULL").join(active, "conversation_id", "left_anti")
    ids = gone.select(F.col("conversation_id").alias("id")).distinct()
    left = M.delete(conversations, ids, "id")
    mark = gone.select("page", "conversation_id", F.lit(True).alias("deleted")).distinct()
    told = there.join(mark, ["page", "conversation_id"], "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    told = told.withColumn("next", F.col("deleted") & (F.col("shown") == F.col("conversation_id")))
    bare = told.where("next").join(left.select("project_id").distinct(), "project_id", "left_anti")
    first = M.first_of_each(bare.select("project_id", "at", "new_id"), "project_id", "at", "new_id")
    made = first.select(F.col("new_id").alias("id"), "project_id", F.lit(DEFAULT_TITLE).alias("title"), F.lit(default).alias("model_profile"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    tops = _latest(left).select("project_id", F.col("top.id").alias("top")).unionByName(made.select("project_id", F.col("id").alias("top")))
    shows = F.when(F.col("next"), F.col("top")).otherwise(F.col("shown"))
    pages = told.join(tops, "project_id", "left").select("page", "conversation_id", "deleted", shows.alias("shows"))
    return left.unionByName(made.select(*left.columns)), M.delete(messages, ids.withColumnRenamed("id", "conversation_id"), "conversation_id"), pages


def notice(profile: Column, configured: Column, stopped: Column, error: Column, status: Column, content: Column) -> Column:
    """How a reply ended: ok, stopped (with or without text saved), or what went wrong and with which profile."""
    told = lambda kind: F.concat(F.lit(kind), F.lit(" "), profile)
    return (
        F.when(~configured, told("misconfigured"))
        .when(stopped, F.when(content == "", "stopped, nothing saved").otherwise("stopped, partial reply saved"))
        .when(error.isin("connection", "timeout"), told("unreachable"))
        .when(error == "status", F.concat(told("http"), F.lit(" "), status.cast("string")))
        .when(content == "", told("empty"))
        .otherwise("ok")
    )


@dataclass
class Sent:
    """What a batch of sends leaves: the tables, the contexts that went out, and one row for each send."""

    messages: DataFrame
    conversations: DataFrame
    contexts: DataFrame
    sends: DataFrame


def send(conversations: DataFrame, messages: DataFrame, profiles: DataFrame, sends: DataFrame, deltas: DataFrame, default: str, system: str, high_water: int) -> Sent:
    """Sends (conversation_id, text, at, nth, stop_at, error, status, replied_at) and the deltas that came (conversation_id, nth, chunk_index, delta).

    Blank texts are refused, and so is what is sent while the conversation still generates (until replied_at;
    for good where that is null). The text is added stripped; an unnamed chat without messages gets its
    title from the first one. The profile is pinned when the text is sent, and what was received of the reply (before
    the chunk at which it was stopped) is saved stripped, unless blank, whether it ended by a stop, an
    error or well. Ids follow nth, which rises with time in a conversation. The sends are settled once, and all messages numbered at once.
    """
    known = C.with_known_profiles(conversations, profiles, default)
    asked = sends.withColumn("text", X.strip(F.col("text"))).join(known.select(F.col("id").alias("conversation_id"), "title", "model_profile"), "conversation_id")
    told = V.admitted(asked.where("text <> ''").withColumn("until", F.col("replied_at")))
    before = messages.select("conversation_id").distinct().withColumn("had", F.lit(True))
    opening = F.col("nth") == F.min(F.when(F.col("admitted"), F.col("nth"))).over(Window.partitionBy("conversation_id"))
    said = settled(told.join(before, "conversation_id", "left").withColumn("opens", opening))
    made = said.where("admitted")
    named = F.when((F.col("title") == DEFAULT_TITLE) & F.col("had").isNull() & F.col("opens"), X.title(F.col("text")))
    titled = M.rename(known, made.select(F.col("conversation_id").alias("id"), named.alias("new_title"), "at").where("new_title IS NOT NULL"))
    users = made.select("conversation_id", F.lit("user").alias("role"), F.col("text").alias("content"), F.lit(None).cast("string").alias("model_profile"), "at", (F.col("nth") * 2).alias("nth"))

    by = profiles.select(F.col("key").alias("model_profile"), "label", C.configured().alias("configured"))
    open_ = made.join(by, "model_profile")
    received = deltas.join(open_.where("configured").select("conversation_id", "nth", "stop_at"), ["conversation_id", "nth"]).where(F.col("stop_at").isNull() | (F.col("chunk_index") < F.col("stop_at")))
    folded = R.fold(received, "conversation_id", "nth").withColumn("content", X.strip(F.col("content")))
    ended = open_.join(folded, ["conversation_id", "nth"], "left").withColumn("content", F.coalesce("content", F.lit("")))
    how = notice(F.col("label"), F.col("configured"), F.col("stop_at").isNotNull(), F.coalesce("error", F.lit("")), F.col("status"), F.col("content"))
    ended = settled(ended.withColumn("notice", how))
    replies = ended.where("content <> ''").select("conversation_id", F.lit("assistant").alias("role"), "content", "model_profile", F.coalesce("replied_at", "at").alias("at"), (F.col("nth") * 2 + 1).alias("nth"))
    saved, seen, _ = M.add_messages(messages, titled, users.unionByName(replies), high_water)

    # what each send is answered from: all that was there, then what the batch said before
    there = messages.select("conversation_id", F.lit(0).alias("late"), F.col("id").cast("long").alias("place"), "role", "content")
    items = there.unionByName(users.unionByName(replies).select("conversation_id", F.lit(1).alias("late"), F.col("nth").cast("long").alias("place"), "role", "content"))
    heard = items.join(made.select("conversation_id", "nth"), "conversation_id").where("late = 0 OR place <= nth * 2")
    contexts = R.contexts(heard.withColumn("id", F.struct("late", "place")), system, "conversation_id", "nth")

    rest = said.where("NOT admitted").select("conversation_id", "nth", F.lit("busy").alias("notice"))
    rest = rest.unionByName(asked.where("text = ''").select("conversation_id", "nth", F.lit("blank").alias("notice")))
    rest = rest.select("*", F.lit("").alias("reply"), F.lit(None).cast("string").alias("model_profile"))
    return Sent(saved, seen, contexts, ended.select("conversation_id", "nth", "notice", F.col("content").alias("reply"), "model_profile").unionByName(rest))
