"""Exact deduplication by content-defined chunk recipes (DataFrame operations only).

A text is cut where its own content says so: after at least MIN_CHUNK characters, at the first
vowel, consonant, white space, or after a mark or line end that follows a letter that isn't ASCII
(or at MAX_CHUNK characters). Each chunk gets an identifier: its 64-bit hash, verified over the
distinct chunks of the whole corpus, with an ordinal where two different chunks share a hash. Two
texts are equal exactly when their ordered identifier lists are equal, so only these short lists
are grouped and joined; long texts move once, as distinct chunks, for the verification. Where
hashes are shared, only the chunks that carry one move again, with the digest of their text.

The lists are written once and read from there. Groups are counted with map-side sums; where rows
meet their group again, a group that holds most rows is split over tasks.

Defined cases: a null text counts as empty; empty texts are one group; a null doc_id ranks below
any other; rows that repeat doc_id and text are counted each, and one of those with the largest
doc_id stays; other columns are not looked at, whatever their names; an empty table gives no rows.
A text of any length is cut in its own task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.common import checkpointed, spread_join, table

MIN_CHUNK, MAX_CHUNK = 256, 2048
#: More hashes that different chunks share than these are not broadcast but joined.
FEW = 1_000_000
_ORDINALS = "array<struct<pos:int,ordinal:int>>"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of a text, in order; joined they are the text."""
    cut = rf"(?s).{{{least},{most}}}?(?:(?<=[aeiou][dlnrst]\s|[^\x00-\x7F][\n\p{{P}}])|\z)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def exact_dedup(docs: DataFrame, hash_mask: int = -1, few: int = FEW) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks for each row of docs (doc_id, text).

    hash_mask shortens the chunk hashes, so that tests meet collisions.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = lambda c: F.xxhash64(c).bitwiseAND(F.lit(hash_mask))
    # numbered where they are written, once
    listed = checkpointed(
        rows.select("doc_id", F.monotonically_increasing_id().alias("nth"), F.sha2("text", 256).alias("text_sha256"), F.transform(chunks(F.col("text")), digest).alias("recipe"))
    )

    distinct = rows.select(F.explode(chunks(F.col("text"))).alias("chunk")).distinct().withColumn("h", digest(F.col("chunk")))
    shared = checkpointed(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"))
    collisions = shared.count()
    if not collisions:
        listed = listed.withColumn("ordinals", F.array().cast(_ORDINALS))
    else:
        near = F.broadcast(shared) if collisions <= few else shared
        digested = rows.select(F.sha2("text", 256).alias("text_sha256"), F.posexplode(chunks(F.col("text"))).alias("pos", "chunk"))
        pieces = checkpointed(digested.withColumn("h", digest(F.col("chunk"))).join(near, "h", "left_semi"))
        numbered = pieces.select("h", "chunk").distinct().withColumn("ordinal", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
        ordinals = pieces.join(numbered, ["h", "chunk"]).groupBy("text_sha256").agg(F.array_sort(F.collect_set(F.struct("pos", "ordinal"))).alias("ordinals"), F.count(F.lit(1)).alias("uses"))
        met = spread_join(listed, ordinals, ["text_sha256"], "uses", [F.col("nth")], "left")
        listed = checkpointed(met.select("doc_id", "nth", "text_sha256", "recipe", F.coalesce("ordinals", F.array().cast(_ORDINALS)).alias("ordinals")))
    first = F.coalesce(F.max_by("nth", "doc_id"), F.max("nth")).alias("keep_nth")
    groups = checkpointed(listed.groupBy("recipe", "ordinals").agg(F.max("doc_id").alias("keep_id"), first, F.count(F.lit(1)).alias("group_size")))
    met = spread_join(listed, groups, ["recipe", "ordinals"], "group_size", [F.col("nth")])
    return met.select("doc_id", "keep_id", "group_size", (F.col("nth") == F.col("keep_nth")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


SQL = """
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) AS nth,
             max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
"""
