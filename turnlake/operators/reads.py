"""Reads: lookups, listings, transcripts, prompt contexts and folds of streamed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions import text as X
from turnlake.sources.folders import settled


def sliced(rows: DataFrame, *order: str) -> DataFrame:
    """rows dealt by ranges of these columns, and slice, the range each is in."""
    return rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("slice", F.spark_partition_id())


def lookup(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The rows of table that keys name, one lookup a key."""
    return table.join(keys.select(key), key, "left_semi")


def heads(activity: DataFrame, key: str = "conversation_id", at: str = "created_at") -> DataFrame:
    """Each conversation with its first and latest activity."""
    return activity.groupBy(key).agg(F.max(at).alias("updated_at"), F.min(at).alias("created_at"))


def by_latest(conversations: DataFrame, key: str = "conversation_id") -> DataFrame:
    return conversations.orderBy(F.desc("updated_at"), F.desc("created_at"), key)


def conversations_of(conversations: DataFrame, project: object, group: str = "project_id", key: str = "id") -> DataFrame:
    """The conversations of one project, latest first; the filter reaches the scan."""
    return by_latest(conversations.where(F.col(group) == F.lit(project)), key)


def messages_of(messages: DataFrame, conversation: object) -> DataFrame:
    """The messages of one conversation in the order they were stored; the filter reaches the scan."""
    return messages.where(F.col("conversation_id") == F.lit(conversation)).orderBy("id")


def header(conversations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Title and model label of each conversation; a profile that isn't configured shows its key."""
    named = conversations.join(profiles.select(F.col("key").alias("model_profile"), "label"), "model_profile", "left")
    return named.select("id", "title", F.coalesce("label", "model_profile").alias("model"))


def newest(conversations: DataFrame, key: str = "conversation_id") -> DataFrame:
    """The one conversation that a page opens with."""
    return by_latest(conversations, key).limit(1)


def newest_of_each(rows: DataFrame, group: str, at: str, key: str) -> DataFrame:
    """The latest row of each group: one aggregation that combines before the shuffle."""
    rest = [c for c in rows.columns if c != group]
    return rows.groupBy(group).agg(F.max(F.struct(at, key, *(c for c in rest if c not in (at, key)))).alias("top")).select(group, *(f"top.{c}" for c in rest))


def transcript(messages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Messages with who sent them and how the speaker is called; profiles is a small dimension."""
    named = messages.join(profiles.select(F.col("key").alias("model_profile"), "label"), "model_profile", "left")
    speaker = F.when(F.col("role") == "user", F.lit("You")).otherwise(F.coalesce("label", "model_profile", F.lit("Assistant")))
    return named.select("id", "conversation_id", "role", "content", (F.col("role") == "user").alias("sent"), speaker.alias("speaker"))


def ordered(*fields: str, group: str = "conversation_id"):
    """The aggregate of a group's rows as structs in the order of the fields."""
    return F.array_sort(F.collect_list(F.struct(*fields)))


def contexts(messages: DataFrame, system: str | None = None, *key: str) -> DataFrame:
    """Each conversation's messages (or those of another key) in id order as JSON, after the system prompt if there is one."""
    key = key or ("conversation_id",)
    grouped = messages.groupBy(*key).agg(ordered("id", "role", "content").alias("m"))
    plain = F.transform("m", lambda z: F.struct(z["role"].alias("role"), z["content"].alias("content")))
    if system:
        plain = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), plain)
    return grouped.select(*key, F.to_json(plain).alias("context"))


def with_turns(messages: DataFrame, key: str = "conversation_id", order: str = "id") -> DataFrame:
    """messages with turn_no (from 0, in the order of a column) and turns, exact also where one conversation is most of the rows.

    Rows are dealt by ranges of key and order, so a hot conversation lies in many ranges; each is numbered by itself and moved up by
    what the conversation has in ranges before. The ranges are settled once, by a checkpoint.
    """
    # a struct equals itself also where the key is null
    dealt = settled(sliced(messages, key, order).withColumn("_of", F.struct(key)))
    here = dealt.groupBy("slice", "_of").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("_of")
    # a row a range and conversation: of a hot one as many as there are ranges
    before = here.select("slice", "_of", (F.sum("n").over(w.orderBy("slice")) - F.col("n")).alias("before"), F.sum("n").over(w).alias("turns"))
    placed = dealt.withColumn("_here", F.row_number().over(Window.partitionBy("slice", "_of").orderBy(order)) - 1)
    # merged, not broadcast from either side: the messages stay where they were numbered, and so spread
    return placed.join(before.hint("merge"), ["slice", "_of"]).select(*messages.columns, (F.col("before") + F.col("_here")).alias("turn_no"), "turns")


def context_pieces(messages: DataFrame, size: int, system: str | None = None) -> DataFrame:
    """conversation_id, piece, pieces, context: the JSON of contexts() cut after each size messages.

    The pieces of a conversation, joined in order, are its context; a task holds no more than some pieces, whatever a conversation's length.
    """
    told = with_turns(messages.select("conversation_id", "id", "role", "content"))
    piece = F.floor(F.col("turn_no") / size).cast("long")
    folded = told.groupBy("conversation_id", piece.alias("piece"), F.ceil(F.col("turns") / size).cast("long").alias("pieces")).agg(ordered("turn_no", "role", "content").alias("m"))
    body = F.to_json(F.transform("m", lambda z: F.struct(z["role"].alias("role"), z["content"].alias("content"))))
    inner = F.expr("substring(_j, 2, length(_j) - 2)")
    first = F.concat(F.lit("["), F.to_json(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), F.lit(",")) if system else F.lit("[")
    text = F.concat(F.when(F.col("piece") == 0, first).otherwise(F.lit(",")), inner, F.when(F.col("piece") == F.col("pieces") - 1, F.lit("]")).otherwise(F.lit("")))
    return folded.withColumn("_j", body).select("conversation_id", "piece", "pieces", text.alias("context"))


def reply_pieces(deltas: DataFrame, *key: str, size: int) -> DataFrame:
    """key, piece, content: each reply's text, cut after each size chunks. Chunks are numbered already, so it is one aggregation."""
    return fold(deltas.withColumn("piece", F.floor(F.col("chunk_index") / size).cast("long")), *key, "piece")


def joined(pieces: DataFrame, *key: str, text: str, most: int) -> DataFrame:
    """The pieces of each key as one text; of those longer than most (characters in all) the text is null, and length tells."""
    sizes = pieces.groupBy(*key).agg(F.sum(F.length(text).cast("long")).alias("length"))
    short = pieces.join(sizes.where(F.col("length") <= most).select(*key), [*key], "left_semi")
    whole = short.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", text))), lambda p: p[text]), "").alias(text))
    return sizes.join(whole, [*key], "left").select(*key, "length", text)


def titles(messages: DataFrame) -> DataFrame:
    """The title each conversation gets from its first user message."""
    first = messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", "id").alias("content"))
    return first.select("conversation_id", X.title(F.col("content")).alias("title"))


def fold(deltas: DataFrame, *key: str, order: str = "chunk_index") -> DataFrame:
    """Each reply's text: its deltas joined in order."""
    return deltas.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "delta"))), lambda d: d["delta"]), "").alias("content"))


def stopped(deltas: DataFrame, at: Column, *key: str) -> DataFrame:
    """What is saved of replies that were stopped at a chunk: that chunk is dropped, blank text isn't saved."""
    partial = fold(deltas.where(F.col("chunk_index") < at), *key)
    return partial.select(*key, X.strip(F.col("content")).alias("content")).where("content <> ''")


def running(messages: DataFrame) -> DataFrame:
    """The text painted after each part."""
    w = Window.partitionBy("conversation_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return messages.select("conversation_id", "id", F.array_join(F.collect_list("content").over(w), "").alias("painted"))


def ends(messages: DataFrame) -> DataFrame:
    """Where in its conversation's text each part ends: the painted texts without the square, as cutting the text there gives them."""
    w = Window.partitionBy("conversation_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return messages.select("conversation_id", "id", F.sum(F.length("content").cast("long")).over(w).alias("end"))


def paints(activity: DataFrame, gap_micros: int) -> DataFrame:
    """How often a display repaints that waits for the gap since its last paint."""
    times = activity.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.unix_micros("created_at"))).alias("ts"))
    zero = F.struct(F.get("ts", F.lit(0)).alias("last"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(x - a["last"] >= gap_micros, F.struct(x.alias("last"), (a["n"] + 1).alias("n"))).otherwise(a)
    return times.select("conversation_id", F.aggregate("ts", zero, step, lambda a: a["n"]).cast("long").alias("paints"))
