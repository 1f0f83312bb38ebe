"""The corpus pipeline's stages: each works on all rows its predecessor kept and returns the columns of documents.

Defined cases of every stage: an empty table gives no rows; extra columns, whatever their names,
come through all stages but the last, which returns its own; only a column `position` gives way to
the training position that mixing adds. What null texts, null ids and repeated rows become is told
at each stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import decontaminate, language_id, mixing, ngram_join, sharding
from turnlake.llm.common import checkpointed, held_out, spread_join, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised; null texts, texts without letters and ambiguous ones go. Repeated rows are judged each."""
    model = language_id.fit(docs.where(~held_out(4, 2)).select("text", "lang"))
    sent = spark.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, _, doubt = language_id.predict(sent.value, batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([x != "und" and not d for x, d in zip(lang, doubt)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the Jaccard join: the one with the least doc_id.

    Rows are told apart by doc_id and text: rows that share an id but not a component are kept
    for each component, of rows equal in both one stays, and a null doc_id comes after all others.
    Null and wordless texts link with nothing.
    """
    # sorts as doc_id does, nulls last
    order = F.coalesce(F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit("null"))
    key = F.concat_ws(" ", order, F.hex(F.xxhash64("text")))
    found = ngram_join.jaccard_components(docs.select(key.alias("doc_id"), "text"))
    # what is decided of each key; the texts meet it once, and neither sorts nor groups hold them
    decided = checkpointed(found.groupBy(F.col("doc_id").alias("row_key")).agg(F.first(F.expr("doc_id = component_id")).alias("stays"), F.count(F.lit(1)).alias("copies")))
    keyed = docs.select(key.alias("row_key"), F.struct(*docs.columns).alias("row"))
    met = spread_join(keyed, decided.hint("shuffle_hash"), ["row_key"], "copies", [F.spark_partition_id()]).where("stays")
    if decided.where("copies > 1").isEmpty():
        return met.select("row.*")
    single, repeated = met.where("copies = 1"), met.where("copies > 1").dropDuplicates(["row_key"])
    return single.unionByName(repeated).select("row.*")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that don't hold benchmark text in one word of twenty; null texts hold none. Repeated rows are judged each."""
    named = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = decontaminate.find_contamination(named, table(spark, sf_dir, "benchmark"))
    return found.where(f"NOT (n_hit > 0 AND {decontaminate.SHARE} * n_hit >= n_words)").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix begins to read it, each pass where its words are due, in training order.

    position is where that is, from 0 to 1.
    Texts without words are not read; a null source is a source; repeated rows are read each.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")
    drawn = mixing.passes(mixing.mix(rows, ("row",)))
    kept = [F.col("position") if c.lower() == "position" else F.col("row").getField(c).alias(c) for c in docs.columns]
    added = [] if "position" in (c.lower() for c in docs.columns) else ["position"]
    return mixing.in_training_order(drawn).select(*kept, *added)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, checksum, shard and slot of every row; repeated rows get slots of their own, a null text has no bytes.

    Rows with a training position keep it, and the slots of a shard follow it.
    """
    return sharding.shard(docs, position="position" if dict(docs.dtypes).get("position") == "double" else None)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", uncontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]
