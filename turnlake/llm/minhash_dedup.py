"""MinHash near-duplicates with tensored banding.

A document is the set of its 5-word shingles, as 64-bit hashes. Two collections of m half keys are
made, each of k minhashes; table (i, j) is keyed by half key i of the first and j of the second
collection, so m * m tables need 2 * m * k minhashes instead of m * m * 2 * k. Sets of similarity s
meet in some table unless one of the collections has no half key in common, which happens with
probability 2 * (1 - s**k)**m at most: m makes that MISS at the threshold. k is the least one with
which unrelated sets (similarity BACKGROUND) rarely meet in a corpus of this size.

The m * m keys of a set are not shuffled. A task sends a set once for each half key of the first
collection, with the half keys of the second as 32-bit numbers beside it; half keys that no other set
has are left there, and only then the tables are formed inside the groups. (Shortened numbers
let some more sets meet and none fewer.) A task first ties the sets it has itself, table by table, so a
half key that a third of all sets share reaches the shuffle as one row for each table key of a task.

Sets that meet are tied by a chain over the table's sets, and connected ties are a family: no pairs
are emitted. Families are verified on full sets, by matrix products in blocks of bounded size. A
family that fits a block is compared whole. Of a larger one each block is compared within itself
and with the first block, which ties near copies at a cost that grows with their number; then only
the sets outside the family's largest component are compared with all, in blocks of like size.

Defined cases: a null or wordless text has an empty set, links with nothing and is its own
component; with fewer words than five the whole sequence is the one shingle; repeated rows are
equal sets; a null doc_id takes part, names no component unless all of its component are null, and
is kept only then; an empty table gives no rows; a text of any length is one set, whole; other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.blocks import mix
from turnlake.llm.common import checkpointed, spread_join, table, uneven
from turnlake.llm.ngram_join import BLOCK_TOKENS, LEAST_TOKENS, _read, _verify, bands, distinct_sets, families, least_ids, prints, token_rows

SHINGLE, PERCENT = 5, 85
#: Chance that two sets at the threshold meet in no table.
MISS = 1e-7
#: Similarity of unrelated sets, and how many of them a set may meet by chance on average.
BACKGROUND, CHANCE = 0.05, 0.1
#: Sets that a task gathers before it ties what they share.
FLUSH = 20_000
_U = np.uint64
_KEYS = "akey long, fp long, first int, half array<int>"


def collections(sets: int, percent: int = PERCENT) -> tuple[int, int]:
    """k minhashes a half key, m half keys a collection, for a corpus of so many sets."""
    k, s = 1, percent / 100
    while True:
        m = max(1, math.ceil(math.log(MISS / 2) / math.log1p(-(s**k)))) if percent < 100 else 1
        if sets * m * m * BACKGROUND ** (2 * k) <= CHANCE:
            return k, m
        k += 1


def minhashes(found: np.ndarray, size: np.ndarray, many: int) -> np.ndarray:
    """many minhashes (rows) of each set (columns); found holds the sets' tokens one after another, none empty."""
    if not len(size):
        return np.zeros((many, 0), np.uint32)
    rng, starts = np.random.default_rng(13), np.cumsum(size) - size
    token = (mix(found + _U(29)) >> _U(32)).astype(np.uint32)
    out = np.empty((many, len(size)), np.uint32)
    for i in range(many):
        odd, flip = rng.integers(1 << 31, dtype=np.uint32) * 2 + 1, rng.integers(1 << 32, dtype=np.uint32)
        x = (token ^ flip) * odd
        x ^= x >> np.uint32(15)
        out[i] = np.minimum.reduceat(x * np.uint32(0x2C1B3C6D), starts)
    return out


def half_keys(least: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of minhashes (2 * m * k rows): the first collection's half keys (sets x m, 64 bits) and the second's (32 bits)."""
    key = np.zeros((2 * m, least.shape[1]), np.uint64)
    for i in range(k):
        key = mix(key + least.reshape(2 * m, k, -1)[:, i, :].astype(np.uint64) + _U(i + 1))
    key = mix(key + np.arange(2 * m, dtype=np.uint64)[:, None] * _U(0x9E3779B97F4A7C15))
    return key[:m].T.view(np.int64), (key[m:].T >> _U(32)).astype(np.uint32).view(np.int32)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key, stable, and where in it a key begins."""
    order = np.argsort(key, kind="stable")
    head = np.ones(len(key), bool)
    head[1:] = key[order][1:] != key[order][:-1]
    return order, head


def tied_keys(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (akey, fp, first table of the second collection, its half keys from there on) that tie the sets in all tables.

    A set alone with its half key sends all its half keys of the second collection. Where sets share one,
    each of their table keys goes out once, with its least set, and the others are tied to that by a key of its own.
    """
    m = b.shape[1]
    by_print = np.argsort(fp)
    fp, a, b = fp[by_print], a[by_print], b[by_print]  # so the first of a group is its least
    ties = []
    for i in range(m):
        order, head = _groups(a[:, i])
        alone = head & np.append(head[1:], True)
        one = order[alone]
        yield a[one, i], fp[one], np.zeros(len(one), np.int32), b[one]
        some = np.sort(order[~alone])
        if not len(some):
            continue
        # the table keys of these sets: one row a set and table
        place, j = np.repeat(some, m), np.tile(np.arange(m), len(some))
        half = b[place, j]
        told = mix(mix(a[place, i].view(np.uint64) + j.astype(np.uint64)) + half.view(np.uint32).astype(np.uint64))
        order, head = _groups(told)
        pivot = place[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
        other = place[order]
        ties.append(np.unique(np.stack([pivot, other])[:, pivot != other], axis=1))
        once = order[head]
        yield a[place[once], i], fp[place[once]], j[once].astype(np.int32), half[once][:, None]
    pivot, other = np.unique(np.concatenate(ties, axis=1), axis=1) if ties else (np.zeros(0, np.int64),) * 2
    own = np.concatenate([np.unique(pivot), other]), np.concatenate([np.unique(pivot), pivot])
    yield mix(fp[own[1]].view(np.uint64) + _U(977)).view(np.int64), fp[own[0]], np.zeros(len(own[0]), np.int32), np.zeros((len(own[0]), 1), np.int32)


def candidate_ties(rows: DataFrame, sets: int, n: int = SHINGLE, percent: int = PERCENT, print_mask: int = -1) -> DataFrame:
    """a, b: prints of sets of rows (text) that are neighbours in some table."""
    k, m = collections(sets, percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            fp, a, b = (np.concatenate(x) for x in zip(*held))
            held.clear()
            _, once = np.unique(fp, return_index=True)
            for akey, own, first, half in tied_keys(fp[once], a[once], b[once]):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(half) + 1, dtype=np.int32) * half.shape[1]), pa.array(np.ascontiguousarray(half).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(akey), pa.array(own), pa.array(first), lists], names=["akey", "fp", "first", "half"])

        for batch in batches:
            for _, _, found, owner, size in _read(batch, n):
                fp, fq = prints(found, size, print_mask)
                some = size > 0
                # equal sets of a block sign once; sets that share the first print only sign each, and all are that print's
                once = np.zeros(len(fp), bool)
                once[np.unique(np.stack([fp, fq]), axis=1, return_index=True)[1]] = True
                once &= some
                held.append((fp[once], *half_keys(minhashes(found[once[owner]], size[once], 2 * m * k), k, m)))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield from flush()
        if held:
            yield from flush()

    keys = rows.mapInArrow(sign, _KEYS)
    shared = Window.partitionBy("akey")
    met = keys.withColumn("least", F.min("fp").over(shared)).withColumn("most", F.max("fp").over(shared)).where("least <> most")
    # the tables: groups inside those of the first half key
    each = met.select("akey", "fp", "first", F.posexplode("half").alias("at", "b")).select("akey", "fp", (F.col("first") + F.col("at")).alias("j"), "b")
    chain = Window.partitionBy("akey", "j", "b").orderBy("fp")
    return each.withColumn("before", F.lag("fp").over(chain)).where("before <> fp").select(F.col("before").alias("a"), F.col("fp").alias("b")).distinct()


def _blocks(size: str, block_tokens: int) -> Column:
    return F.ceil(F.sum(size) / F.lit(block_tokens)).cast("int")


def verified(rows: DataFrame, family: DataFrame, nodes: DataFrame, hot: bool, n: int, percent: int, block_tokens: int, print_mask: int) -> DataFrame:
    """a, b: links between sets that connect what links connect, verified on full sets, for families (fp, family) of nodes."""
    weight = F.greatest("n", F.lit(LEAST_TOKENS))
    members = checkpointed(family.join(nodes, "fp").withColumn("weight", weight))
    cells = members.groupBy("family").agg(_blocks("weight", block_tokens).alias("parts"), F.count(F.lit(1)).alias("members"))
    dealt = spread_join(members, cells, ["family"], "members", [F.col("node")]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = checkpointed(dealt.drop("members"))

    def compared(placed: DataFrame, wanted: DataFrame) -> DataFrame:
        """placed: the sets, and meet, an array of (p, i, q, j, side): the pairs of blocks each takes part in."""
        held = token_rows(rows, wanted, n, print_mask)
        sets = spread_join(held, placed, ["fp", "fq"], "copies", [F.col("own_id")], hot=hot).where(F.col("own_id").eqNullSafe(F.col("rep")))
        keyed = sets.select("family", "node", "n", "copies", "tokens", F.explode("meet").alias("at")).select("family", "at.*", "node", "n", "copies", "tokens")
        linked = keyed.groupBy("family", "p", "i", "q", "j").applyInArrow(_verify(percent), "a long, b long, links long")
        return checkpointed(linked.where("a <> b").select("a", "b"))

    # each block within itself and with the first one, which comes to every block
    hub = F.expr("transform(IF(own = 0, sequence(0, parts - 1), array(own)), k -> struct(0 AS p, k AS i, 0 AS q, k AS j, 0 AS side))")
    links = compared(dealt.withColumn("meet", hub), family)

    # what is not in the largest component of a family of several blocks
    large = dealt.where("parts > 1")
    if large.isEmpty():
        return links
    roots = least_ids(nodes.withColumn("rep", F.col("node")), links).withColumnRenamed("component", "root")
    placed = checkpointed(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    by_root = placed.groupBy("family", "root").agg(F.sum("weight").alias("weight"))
    top = by_root.groupBy("family").agg(F.max_by("root", F.struct("weight", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    counted = top.join(placed.groupBy("family").agg(F.count(F.lit(1)).alias("members")), "family")
    open_ = spread_join(placed, counted, ["family"], "members", [F.col("node")])
    if open_.isEmpty():
        return links
    most = open_.agg(F.max("n")).first()[0]
    lows = bands(most, percent)
    band = F.size(F.filter(F.array(*map(F.lit, lows)), lambda x: x <= F.col("n"))) - 1
    open_ = checkpointed(open_.drop("members", "parts", "own").withColumns({"band": band, "rest": F.col("root") != F.col("top")}))
    # linked sets are in the same band or in neighbouring ones; a family has a logarithm of the longest text of them
    sized = open_.groupBy("family", "band").agg(_blocks("weight", block_tokens).alias("parts"), F.coalesce(F.ceil(F.sum(F.when(F.col("rest"), F.col("weight"))) / F.lit(block_tokens)), F.lit(0)).cast("int").alias("rests"), F.count(F.lit(1)).alias("inside"))
    maps = sized.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("parts", "rests")))).alias("of"), F.sum("inside").alias("inside"))
    told = spread_join(open_, maps, ["family"], "inside", [F.col("node")])
    # rows of the rest are side 0 of the blocks (-1 - band, i); all are side 1 of the blocks (band, j)
    meet = F.expr("""
        concat(
          IF(rest, flatten(transform(array(-1, 0, 1), d -> IF(of[band + d] IS NULL, array(), transform(sequence(0, of[band + d].parts - 1), k ->
            struct(-1 - band AS p, int(pmod(xxhash64(node, 1), of[band].rests)) AS i, band + d AS q, k AS j, 0 AS side))))), array()),
          flatten(transform(array(-1, 0, 1), d -> IF(coalesce(of[band + d].rests, 0) = 0, array(), transform(sequence(0, of[band + d].rests - 1), k ->
            struct(-1 - (band + d) AS p, k AS i, band AS q, int(pmod(xxhash64(node, 2), of[band].parts)) AS j, 1 AS side))))))""")
    more = told.withColumn("meet", meet).drop("of", "inside").where(F.size("meet") > 0)
    return links.unionByName(compared(more, open_.select("fp").distinct()))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS, print_mask: int = -1) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text).

    print_mask shortens the first print of a set, so that tests meet collisions.
    """
    rows = docs.select("doc_id", "text")
    found = distinct_sets(rows, n, print_mask)
    copies, total, sets = found.printed.agg(F.max("copies"), F.sum("copies"), F.count(F.lit(1))).first()
    hot = uneven(docs.sparkSession, copies or 0, total or 0)
    family = families(candidate_ties(rows, sets, n, percent, print_mask), found.clash)
    links = verified(rows, family, found.nodes, hot, n, percent, block_tokens, print_mask)
    component = least_ids(found.nodes, links)
    named = found.nodes.join(component, "node", "left").select("fp", "fq", "copies", F.coalesce("component", "rep").alias("component_id"))
    ended = spread_join(found.some, named, ["fp", "fq"], "copies", [F.col("doc_id"), F.spark_partition_id()], hot=hot).select("doc_id", "n", "component_id")
    empty = found.listed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    both = ended.unionByName(empty)
    return both.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS seen FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id, min(seen) = w.doc_id AS kept
FROM w JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id
"""
