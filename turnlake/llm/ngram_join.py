"""N-gram Jaccard self-join by universe-partition pigeonhole.

A document is the set of its word shingles, as 64-bit hashes. Equal sets, told apart by 128 bits of
prints, are one node. Sizes fall
into bands whose bounds grow by 100/percent, so linked sets are in the same or in neighbouring
bands. For a band, two linked sets differ in at most H tokens. The universe of tokens is split by
hash into m segments; u of them may differ by one token, the rest by none, and m + u > H: by the
pigeonhole two linked sets agree on some segment so far. Each set therefore indexes its subset of
every segment and, for the u segments, the subset's one-deletion neighbourhood. u is chosen for
each band by cost: signatures emitted against sets that meet by chance, which counts all sets of
the band. A subset that is empty tells nothing, and would tie many small sets by chance: a set with
one doesn't index it, but draws the universe's partition anew, up to DRAWS times. (Two linked sets that
agree on an empty subset only both have one, so both draw again, and every partition has its own
pigeonholes; in the last one empty subsets are indexed too.)

Sets that share a signature are tied in a family, by a chain over the signature's sets: no pairs
are emitted. A task first ties the sets it has itself, so a signature that a third of all sets
share reaches the shuffle once from each task. Within a family sets are verified exactly: those of
neighbouring bands meet in blocks of about BLOCK_TOKENS tokens, two blocks a task, which counts
common tokens by matrix products and emits a spanning forest of the links and how many links each
set has. Families of any size are thus split over tasks, without a cap. The sets to verify are
found by a bit map of fixed size (false positives fall out in the join).

Defined cases: a null or wordless text has an empty set, links with nothing and is its own
component; with fewer words than n the whole sequence is the one shingle; repeated rows are equal
sets; a null doc_id takes part, but names no component unless all of its component are null; an
empty table gives no rows; a text of any length is one set, whole; other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.blocks import mix, ranges, sums, texts, words
from turnlake.llm.common import checkpointed, spread_join, table, uneven
from turnlake.llm.components import components

SHINGLE, PERCENT = 3, 90
BLOCK_TOKENS = 32_000
#: A smaller set counts as this many tokens in a block, so that a block holds 500 sets or so at most.
LEAST_TOKENS = 64
#: Partitions of the universe that a set with empty subsets tries.
DRAWS = 8
#: Tokens that two blocks are compared on at once.
WIDE = 2048
#: Signatures that a task gathers before it ties what they share.
FLUSH = 500_000
_U = np.uint64


def bands(most: int, percent: int = PERCENT) -> list[int]:
    """The least size of each band, up to the one after that of size most."""
    lows = [1]
    while lows[-1] <= most:
        lows.append(max(lows[-1] + 1, -(-lows[-1] * 100 // percent)))
    return [*lows, max(lows[-1] + 1, -(-lows[-1] * 100 // percent))]


def bound(top: int, percent: int = PERCENT) -> int:
    """H: how many tokens a set of at most top may differ in from a larger or equal one it links with."""
    return (top + top * 100 // percent) * (100 - percent) // (100 + percent)


def allocation(low: int, top: int, sets: int, percent: int = PERCENT) -> tuple[int, int]:
    """m segments, u of which allow one deletion, for a band of so many sets; (0, 0) if only equal sets link."""
    h = bound(top, percent)
    if h == 0:
        return 0, 0
    u = np.arange((h + 1) // 2 + 1)
    m = h + 1 - u
    s = low / m  # tokens in a segment; both sets have none there with probability exp(-2 s)
    cost = (m - u) + u * (s + 2) + sets * np.exp(-2 * s) * ((m - u) + u * (1 + 2 * s))
    best = int(np.argmin(cost))
    return h + 1 - best, best


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted within it; the row of each; the size of each row's set."""
    h, row = words(data, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    code = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        code = code * _U(0x9E3779B97F4A7C15) + mix(h[k : k + len(code)] + _U(k + 1)) if len(code) else code
    full = row[: len(code)] == row[n - 1 :] if len(code) else np.zeros(0, bool)
    found, owner = mix(code[full]), row[: len(code)][full]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        begin = np.searchsorted(row, short)
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            whole[has] = whole[has] * _U(0x9E3779B97F4A7C15) + mix(h[begin[has] + k] + _U(k + 101))
        found, owner = np.concatenate([found, mix(whole + count[short].astype(np.uint64))]), np.concatenate([owner, short])
    order = _by_owner(found, owner)
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, owner, np.bincount(owner, minlength=rows)


def _by_owner(found: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The order by owner, then found: one fast sort of both in a word, unless two tokens agree in it but not whole."""
    bits = int(owner.max()).bit_length() if len(owner) else 0
    key = (found >> _U(bits)) | (owner.astype(np.uint64) << _U(64 - bits)) if bits else found
    order = np.argsort(key)
    if (np.diff(key[order]) == 0)[found[order][1:] != found[order][:-1]].any():
        return np.lexsort((found, owner))
    return order


def prints(found: np.ndarray, size: np.ndarray, mask: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit prints of each row's set; mask shortens the first, so that tests meet collisions."""
    n = size.astype(np.uint64)
    first, second = mix(sums(mix(found + _U(7)), size) + n), mix(sums(mix(found ^ _U(0x5851F42D4C957F2D)), size) ^ n)
    return (first & _U(mask & (2**64 - 1))).view(np.int64), second.view(np.int64)


def signatures(found: np.ndarray, owner: np.ndarray, size: np.ndarray, lows: np.ndarray, plan: dict[int, tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Signatures and the row of each: for each row in its own band's plan, and as the larger set in the band below."""
    band = np.searchsorted(lows, size, "right") - 1
    for shift in (0, 1):
        for b in np.unique(band[size > 0]) - shift:
            m, u = plan.get(int(b), (0, 0))
            rows = np.flatnonzero((band == b + shift) & (size > 0)) if m else ()
            for draw in range(DRAWS):
                if not len(rows):
                    break
                here = np.zeros(len(size), bool)
                here[rows] = True
                x = found[here[owner]]
                local = np.repeat(np.arange(len(rows)), size[rows])
                seg = (mix(x + _U(1000 + int(b) + (draw << 20))) % _U(m)).astype(np.int64)
                slot = local * m + seg
                held = np.bincount(slot, minlength=len(rows) * m)
                hashed = mix(x + _U(11))
                total = np.zeros(len(rows) * m, np.uint64)
                np.add.at(total, slot, hashed)
                name = mix(np.arange(m, dtype=np.uint64) + _U((int(b) << 32) + (draw << 56)))
                last = draw == DRAWS - 1
                told = np.ones(len(held), bool) if last else held > 0
                yield mix(total + np.tile(name, len(rows)))[told].view(np.int64), np.repeat(rows, m)[told]
                if u:
                    one = (seg < u) & (last | (held[slot] > 1))
                    yield mix(total[slot[one]] - hashed[one] + name[seg[one]]).view(np.int64), rows[local[one]]
                # those with an empty subset, whole or after a deletion
                bare = held.reshape(-1, m)
                rows = rows[(bare == 0).any(1) | (bare[:, :u] == 1).any(1)]


def _read(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = texts(batch)
    for i, j in ranges(offsets):
        yield i, j, *shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)


def _tied(sig: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row a signature for its least set; the other sets are tied to that one by a signature of its own."""
    order = np.lexsort((fp, sig))
    sig, fp = sig[order], fp[order]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    pivot = fp[np.flatnonzero(head)[np.cumsum(head) - 1]]
    rest = (fp != pivot) & ~head
    pivot, other = pivot[rest], fp[rest]
    order = np.lexsort((other, pivot))
    pivot, other = pivot[order], other[order]
    new = np.ones(len(pivot), bool)
    new[1:] = (pivot[1:] != pivot[:-1]) | (other[1:] != other[:-1])
    pivot, other = pivot[new], other[new]
    first = np.unique(pivot)
    own = lambda x: mix(x.view(np.uint64) + _U(977)).view(np.int64)
    return np.concatenate([sig[head], own(pivot), own(first)]), np.concatenate([fp[head], other, first])


def _verify(percent: int):
    def verify(group: pa.Table) -> pa.Table:
        """Links between the sides 0 and 1 of two blocks, or within one block if both are the same."""
        group = group.combine_chunks()
        node, side = group["node"].to_numpy(), group["side"].to_numpy()
        _, once = np.unique(np.stack([node, side]), axis=1, return_index=True)  # a set comes again where its row does
        group = group.take(pa.array(once))
        node, side, n, copies = (group[c].to_numpy() for c in ("node", "side", "n", "copies"))
        token = np.frombuffer(b"".join(group["tokens"].to_pylist()), np.uint64)
        owner = np.repeat(np.arange(len(node)), n)
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        index = np.cumsum(new) - 1
        shared = np.bincount(index)[index] > 1
        index, owner = np.unique(index[shared], return_inverse=True)[1], owner[shared]
        del token, order, new, shared
        at = {c: group[c][0].as_py() for c in "piqj"}
        within = (at["p"], at["i"]) == (at["q"], at["j"])  # else a side without sets has no links
        left, right = (np.arange(len(node)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        common = np.zeros((len(left), len(right)), np.float32)
        place = np.full((2, len(node)), -1)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        for first in range(0, int(index[-1]) + 1 if len(index) else 0, WIDE):
            lo, hi = np.searchsorted(index, [first, first + WIDE])
            part = []
            for k, side_rows in enumerate((left, right)):
                x = np.zeros((len(side_rows), WIDE), np.float32)
                to = place[k, owner[lo:hi]]
                x[to[to >= 0], index[lo:hi][to >= 0] - first] = 1
                part.append(x)
                if within:
                    part.append(x)
                    break
            common += part[0] @ part[1].T
        degree, root = np.zeros(len(node), np.int64), np.arange(len(node))
        # 2 * 10**7 tokens, (100 + percent) times as many, are exact in doubles; whole numbers below 2**24 in floats
        for i in range(len(left)):
            linked = (100 + percent) * common[i].astype(np.float64) >= percent * (n[left[i]] + n[right])
            linked &= node[right] != node[left[i]]
            ends = right[linked]
            if len(ends):
                degree[left[i]] += copies[ends].sum()
                if not within:
                    degree[ends] += copies[left[i]]
                tied = np.unique(np.append(root[ends], root[left[i]]))
                if len(tied) > 1:
                    root[np.isin(root, tied)] = tied[0]
        return pa.table({"a": node, "b": node[root], "links": degree})

    return verify


def _bits(members: int) -> int:
    """Bits of the map of sets to verify: 16 a set, between 128 KB and 8 MB in all."""
    return 1 << min(26, max(20, (16 * members).bit_length()))


class Sets(NamedTuple):
    """The sets of a table's texts, by row and told apart."""

    listed: DataFrame  # doc_id, n, fp, fq of each row
    some: DataFrame  # those with tokens
    printed: DataFrame  # fp, and how many rows carry it (copies)
    nodes: DataFrame  # node, fp, fq, rep (the least doc_id), n, copies of each set
    clash: DataFrame | None  # first prints that different sets share


def distinct_sets(rows: DataFrame, n: int, print_mask: int = -1) -> Sets:
    """Reads the texts of rows (doc_id, text) once and tells their sets of n-word shingles apart by 128 bits."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, fp, fq = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, found, _, count in _read(batch, n):
                one, two = prints(found, count, print_mask)
                size.append(count)
                fp.append(one)
                fq.append(two)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (size, fp, fq))], names=["doc_id", "n", "fp", "fq"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    listed = checkpointed(rows.mapInArrow(sizes, f"doc_id {kind}, n long, fp long, fq long"))
    some = listed.where("n > 0")
    told = [F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies")]
    printed = checkpointed(some.groupBy("fp").agg(F.min("fq").alias("fq"), F.max("fq").alias("other"), *told))
    # sets that are told apart by the second print only: each becomes a node of its own
    clash = printed.where("fq <> other").select("fp")
    nodes = printed.where("fq = other").select(F.col("fp").alias("node"), "fp", "fq", "rep", "n", "copies")
    if clash.isEmpty():
        return Sets(listed, some, printed, nodes, None)
    apart = some.join(clash, "fp", "left_semi").groupBy("fp", "fq").agg(*told)
    return Sets(listed, some, printed, nodes.unionByName(apart.select(F.xxhash64("fp", "fq").alias("node"), "fp", "fq", "rep", "n", "copies")), clash)


def families(ties: DataFrame, clash: DataFrame | None) -> DataFrame:
    """fp and family of the sets that ties (a, b) hold together; sets that share a first print are a family at least."""
    family = components(ties).select(F.col("node").alias("fp"), F.col("root").alias("family"))
    if clash is not None:
        family = family.unionByName(clash.join(family, "fp", "left_anti").select("fp", F.col("fp").alias("family")))
    return checkpointed(family)


def token_rows(rows: DataFrame, wanted: DataFrame, n: int, print_mask: int = -1) -> DataFrame:
    """own_id, fp, fq and tokens of the rows (doc_id, text) whose first print is wanted (fp), and of some others.

    Of a task's equal sets those rows come that may have the least doc_id. Which prints are wanted is told
    by a bit map of bounded size, gathered as its non-zero words.
    """
    bits = _bits(wanted.count())
    bit = F.col("fp").bitwiseAND(F.lit(bits - 1))
    marks = wanted.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))).alias("bits")).toArrow()
    bitmap = np.zeros(bits // 32, np.uint32)
    bitmap[marks["word"].to_numpy()] = marks["bits"].to_numpy().astype(np.uint32)
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)  # 8 MB at most, whatever the input

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = sent.value
        told: dict[tuple[int, int], tuple] = {}  # the least doc_id that this task sent of a set
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rank = lambda k: (ids[k] is None, ids[k])
            out: list[tuple] = []
            for i, _, found, _, size in _read(batch, n):
                fp, fq = prints(found, size, print_mask)
                at = fp & (bits - 1)
                want = (size > 0) & (marked[at >> 5] >> (at & 31).astype(np.uint32) & 1 > 0)
                begin = np.concatenate([[0], np.cumsum(size)])
                least: dict[tuple[int, int], int] = {}  # of equal sets the row with the least doc_id, which may be the node's own
                for k in np.flatnonzero(want).tolist():
                    f, r = (int(fp[k]), int(fq[k])), rank(i + k)
                    if f not in told or (not r[0] and r < told[f]):
                        told[f], least[f] = r, k
                out += [(i + k, *f, found[begin[k] : begin[k + 1]].tobytes()) for f, k in least.items()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([o[0] for o in out], pa.int64())), *(pa.array([o[k] for o in out], pa.int64()) for k in (1, 2)), pa.array([o[3] for o in out], pa.binary())],
                names=["own_id", "fp", "fq", "tokens"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(gather, f"own_id {kind}, fp long, fq long, tokens binary")


def least_ids(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """node and component (the least rep that links reach) of the nodes that linked (a, b) names."""
    linking = checkpointed(nodes.join(components(linked), "node"))
    least = linking.groupBy("root").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("members"))
    return spread_join(linking.select("node", "root"), least, ["root"], "members", [F.col("node")]).select("node", "component")


def jaccard_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS, print_mask: int = -1) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (rows with another set or the same that it links with).

    print_mask shortens the first print of a set, so that tests meet collisions.
    """
    rows = docs.select("doc_id", "text")
    found = distinct_sets(rows, n, print_mask)
    listed, some, printed, nodes, clash = found.listed, found.some, found.printed, found.nodes, found.clash

    most = listed.agg(F.max("n")).first()[0] or 0
    copies, total = printed.agg(F.max("copies"), F.sum("copies")).first()
    hot = uneven(docs.sparkSession, copies or 0, total or 0)
    lows = bands(most, percent)
    band = lambda c: F.size(F.filter(F.array(*map(F.lit, lows)), lambda x: x <= c)) - 1
    # as many rows as bands: a logarithm of the longest text
    filled = {r.band: r.sets for r in nodes.groupBy(band(F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("sets")).collect()}
    plan = {b: allocation(lows[b], lows[b + 1] - 1, filled.get(b, 0) + filled.get(b + 1, 0), percent) for b in range(len(lows) - 1) if b in filled}
    low_array = np.array(lows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            sig, fp = _tied(np.concatenate(sigs), np.concatenate(owners)) if sigs else (np.zeros(0, np.int64),) * 2
            sigs.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(fp)], names=["sig", "fp"])

        for batch in batches:
            for _, _, found, owner, size in _read(batch, n):
                fp, fq = prints(found, size, print_mask)
                once = np.zeros(len(fp), bool)  # equal sets of a block sign once
                once[np.unique(np.stack([fp, fq]), axis=1, return_index=True)[1]] = True
                for sig, row in signatures(found[once[owner]], owner[once[owner]], np.where(once, size, 0), low_array, plan):
                    sigs.append(sig)
                    owners.append(fp[row])
                    held += len(sig)
                if held >= FLUSH:
                    yield flush()
                    held = 0
        yield flush()

    chain = Window.partitionBy("sig").orderBy("fp")
    ties = rows.mapInArrow(sign, "sig long, fp long").withColumn("before", F.lag("fp").over(chain)).where("before <> fp").select(F.col("before").alias("a"), F.col("fp").alias("b"))
    family = families(ties, clash)
    members = family.join(nodes, "fp").withColumn("band", band(F.col("n")))
    cells = members.groupBy("family", "band").agg(F.sum(F.greatest("n", F.lit(LEAST_TOKENS))).alias("cell"), F.count(F.lit(1)).alias("members"))
    # of each family's bands, a logarithm of the longest text: how many blocks each has, and those beside it
    bands_of = Window.partitionBy("family")
    beside = bands_of.orderBy("band")
    parts = cells.withColumn("small", F.sum("cell").over(bands_of) <= block_tokens).withColumn("parts", F.when(F.col("small"), 1).otherwise(F.ceil(F.col("cell") / F.lit(block_tokens)).cast("int")))
    next_to = lambda f, d: F.when(~F.col("small") & (f("band").over(beside) == F.col("band") + d), f("parts").over(beside))
    # a family that fits one task is one cell
    cell = F.when(F.col("small"), 0).otherwise(F.col("band")).alias("cell")
    planned = parts.select("family", "band", cell, "parts", "members", next_to(F.lead, 1).alias("above"), next_to(F.lag, -1).alias("below"))
    dealt = spread_join(members, planned, ["family", "band"], "members", [F.col("node")]).drop("band", "members").withColumnRenamed("cell", "band")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # the pairs of blocks a set takes part in: (band, block) of side 0, (band, block) of side 1
    meet = F.expr("""
        concat(
          transform(sequence(0, parts - 1), j -> struct(band AS p, least(own, j) AS i, band AS q, greatest(own, j) AS j, int(own > j) AS side)),
          if(above IS NULL, array(), transform(sequence(0, above - 1), j -> struct(band AS p, own AS i, band + 1 AS q, j AS j, 0 AS side))),
          if(below IS NULL, array(), transform(sequence(0, below - 1), j -> struct(band - 1 AS p, j AS i, band AS q, own AS j, 1 AS side))))""")
    placed = dealt.select("node", "fp", "fq", "rep", "n", "copies", "family", meet.alias("meet"))
    held = token_rows(rows, family, n, print_mask)
    sets = spread_join(held, placed, ["fp", "fq"], "copies", [F.col("own_id")], hot=hot).where(F.col("own_id").eqNullSafe(F.col("rep")))
    keyed = sets.select("family", "node", "n", "copies", "tokens", F.explode("meet").alias("at")).select("family", "at.p", "at.i", "at.q", "at.j", "at.side", "node", "n", "copies", "tokens")
    linked = checkpointed(keyed.groupBy("family", "p", "i", "q", "j").applyInArrow(_verify(percent), "a long, b long, links long"))

    component = least_ids(nodes, linked.where("a <> b").select("a", "b"))
    links = linked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    near = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    named = nodes.join(component, "node", "left").join(links, "node", "left").select("fp", "fq", "copies", F.coalesce("component", "rep").alias("component"), near.alias("n_links"))
    ended = spread_join(some, named, ["fp", "fq"], "copies", [F.col("doc_id"), F.spark_partition_id()], hot=hot)
    ended = ended.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")
    return ended.unionByName(listed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a),
r AS (SELECT doc_id, doc_id AS seen FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id, coalesce(any_value(n_links), 0) AS n_links
FROM w JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) GROUP BY w.doc_id
"""
