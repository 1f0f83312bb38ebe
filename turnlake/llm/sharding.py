"""Sharding by a hierarchical weighted hash tree (DataFrame operations only).

A row descends region, rack and shard. At each level every child draws -ln(u) / weight from a
hash of the row's key and the child's name, and the smallest draw wins; a node weighs what its
shards weigh. A changed weight therefore moves rows only into or out of the changed subtree.
Regions hold REGION shards and racks hold RACK; where the regions are full, one more shard opens
a region of its own, and so takes rows only into itself (law `key`).

Slots are numbered by slices of each shard: the rows' hash (of key, checksum and size) deals them into
SLICES, or a given training position does, whose slices are ranges of it. No task sees a whole shard,
nor all rows that share a key, and the counts are at most shards x slices rows.

Defined cases: a null text has no bytes (size 16, crc 0); a null doc_id is the key ''; repeated
rows share a shard and get slots of their own; a text of any length is only measured; an empty table
gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import numbered, table

REGION, RACK, SLICES = 8, 4, 256
SHARDS = 40


def _draw(key: Column, nodes: Column, level: str) -> Column:
    """The id of the node (array of id, weight) with the smallest weighted draw."""
    u = lambda n: (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), n["id"]), 11).cast("double") + 0.5) / float(1 << 53)
    return F.array_min(F.transform(nodes, lambda n: F.struct((-F.ln(u(n)) / n["weight"]).alias("draw"), n["id"].alias("id"))))["id"]


def _nodes(pairs: Sequence[tuple[int, float]]) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in pairs))


def tree_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key in the tree over these shard weights (all above 0)."""
    racks: dict[int, dict[int, float]] = {}
    shards: dict[int, list[tuple[int, float]]] = {}
    for i, w in enumerate(weights):
        racks.setdefault(i // REGION, {}).setdefault(i // RACK, 0.0)
        racks[i // REGION][i // RACK] += w
        shards.setdefault(i // RACK, []).append((i, w))
    under = lambda table: F.create_map(*(x for k, v in table.items() for x in (F.lit(k), _nodes(list(v.items()) if isinstance(v, dict) else v))))
    region = _draw(key, _nodes([(r, sum(k.values())) for r, k in racks.items()]), "region")
    rack = _draw(key, F.element_at(under(racks), region), "rack")
    return _draw(key, F.element_at(under(shards), rack), "shard")


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown: Sequence[float] | None = None, position: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text).

    position: a column of numbers from 0 to 1 that slots follow and that is returned too; nulls come last.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    told = [position] if position else []
    sliced = F.least(F.floor(F.coalesce(F.col(position), F.lit(1.0)) * SLICES), F.lit(SLICES - 1)) if position else F.pmod(F.xxhash64(key, crc, size, F.lit("slice")), F.lit(SLICES))
    rows = docs.select(
        *told,
        "doc_id",
        size.alias("size"),
        crc.alias("text_crc32"),
        tree_shard(key, weights).alias("shard"),
        tree_shard(key, grown or [*weights, sum(weights) / len(weights)]).alias("grown_shard"),
        sliced.cast("int").alias("slice"),
    )
    placed = numbered(rows, ["shard"], "slice", [*(F.col(c).asc_nulls_last() for c in told), F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("nth").alias("slot"), "grown_shard", *told)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
