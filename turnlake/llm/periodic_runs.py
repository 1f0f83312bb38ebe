"""Periodic runs of words by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, TIMES * q)
words that no neighbouring word extends keeping that period. Level k of the names gives each place
a number for the 2**k words that start there: level 0 is the word itself (exact, by a dictionary),
level k + 1 numbers the sorted pairs of two level-k names 2**k apart. So equal names are equal
words, without fingerprints. A place whose name no other place of its text has is its own for good
and is left out of later sorts, so most texts need three levels.

Two places a period q apart agree on at least max(LEAST, TIMES * q) - q words in a run. Of the
grid of places a step apart, one therefore starts a whole power of two of agreeing words inside it:
the pairs (i, i + q) of the grid whose names of that length are equal are the candidates, for every
period, and each is extended both ways by descending levels of names, as far as words agree. The
longest common extension is exact, so every run is found and only runs are. Where a stretch has
several periods, all are multiples of the least one and the stretches are the same: the least stays.

Texts are worked on in their own task, in blocks; nothing is shuffled. A long text is one block:
4 bytes a word and level, levels being the logarithm of the longest repeat. Pairs of the grid are
looked at in portions of PORTION.

Defined cases: a null or wordless text has no runs; repeated rows are worked on each; extra columns
pass through, but one with the name of a result gives way to it; an empty table gives no rows.
In the query a null doc_id counts as the text ''.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.blocks import ranges
from turnlake.llm.common import table

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 24, 3
#: Pairs of the grid that are looked at at once.
PORTION = 1 << 20
#: Level at which texts without any repeat are left.
FIRST = 3
WORDS = r"[^\x20\x09-\x0D]+"
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct key, and which keys come more than once."""
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.ones(len(key), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    nth = np.cumsum(new) - 1
    name, again = np.empty(len(key), np.int64), np.empty(len(key), bool)
    name[order], again[order] = nth, np.bincount(nth, minlength=1)[nth] > 1
    return name, again


def levels(word: np.ndarray, text: np.ndarray, most: int = 64) -> list[np.ndarray]:
    """Names of the 2**k words from each place on, for k = 0, 1, ...; equal only inside a text, and negative where no other place has the same."""
    n = len(word)
    own = -1 - np.arange(n, dtype=np.int32 if n < 2**31 else np.int64)
    out = [word.astype(own.dtype)]
    place = np.flatnonzero(text[1:] == text[:-1])
    # distinct texts, then words: a key holds both, as they are numbered from 0
    prefix = text.astype(np.int64) * (int(word.max(initial=0)) + 1)
    while len(place) and len(out) <= most:
        half = 1 << (len(out) - 1)
        last = out[-1].astype(np.int64)
        first, second = last[place], last[place + half]
        if len(out) == 1:
            first = prefix[place] + first
        name, again = _named(first * (int(last.max()) + 1) + second)
        found = own.copy()
        found[place[again]] = name[again]
        place = place[again]
        if not len(place):
            break
        out.append(found)
        # the next length needs the same text and a second half that comes again too
        place = place[place + 2 * half < n]
        place = place[(found[place + 2 * half] >= 0) & (text[np.minimum(place + 4 * half - 1, n - 1)] == text[place]) & (place + 4 * half <= n)]
    return out


def extension(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words agree from the places i and j on (back: before them), by descending levels of one text's names.

    Two places that agree on twice the top level's words would have one more level, so each level counts once.
    """
    n, length = len(names[0]), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        size = 1 << k
        a, b = (i - length - size, j - length - size) if back else (i + length, j + length)
        same = (np.minimum(a, b) >= 0) & (np.maximum(a, b) + size <= n)
        same[same] = names[k][a[same]] == names[k][b[same]]
        length[same] += size
    return length


def grid(n: int, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Places and periods to look at in a text of n words, with the level of names to compare."""
    q = np.arange(1, n // times + 1, dtype=np.int64)
    agree = np.maximum(least, times * q) - q
    # at most a quarter of what agrees, as a power of two; the grid's step is what is left
    level = np.floor(np.log2(np.maximum(agree // 4, 1))).astype(np.int64)
    step = agree - (1 << level) + 1
    count = -(-(n - q) // step)
    for k in np.unique(level):
        band = np.flatnonzero(level == k)
        upto = np.cumsum(count[band])
        at = 0
        while at < len(band):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PORTION, "right")))
            each = count[band[at:to]]
            period = np.repeat(q[band[at:to]], each)
            nth = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            yield nth * np.repeat(step[band[at:to]], each), period, int(k)
            at = to


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Distinct rows of three columns, in order."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    return rows[new]


def runs(word: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """start, length, period of every run of one text's words (numbers that are equal where words are), by start, then period."""
    n = len(word)
    none = np.zeros((0, 3), np.int64)
    if n < max(least, times):
        return none
    names = levels(word, np.zeros(n, np.int64))
    found = [none]
    for i, q, k in grid(n, least, times):
        if k >= len(names):
            continue
        fits = i + q + (1 << k) <= n
        i, q = i[fits], q[fits]
        same = names[k][i] == names[k][i + q]
        i, q = i[same], q[same]
        if not len(i):
            continue
        start = i - extension(names, i, i + q, back=True)
        length = i + q + extension(names, i, i + q) - start
        long = length >= np.maximum(least, times * q)
        found.append(_distinct(np.stack([start[long], length[long], q[long]], 1)))
    all_ = _distinct(np.concatenate(found))  # by start, length, period
    first = np.ones(len(all_), bool)
    first[1:] = (all_[1:, :2] != all_[:-1, :2]).any(1)
    all_ = all_[first]
    return all_[np.lexsort((all_[:, 2], all_[:, 0]))]


def _kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def _worked(col: pa.Array, least: int, times: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Words, runs and kept words of a block of texts."""
    split = pc.ascii_split_whitespace(col.fill_null("").cast(pa.large_string()))
    flat, offsets = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    told = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(told)])[offsets]
    flat = flat.filter(pa.array(told))
    size = np.diff(upto)
    word = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(size)), size)
    # only a text where FIRST levels repeat can have a run, unless runs may be shorter
    repeats = levels(word, text, FIRST) if least * (times - 1) // times >= 1 << FIRST else []
    some = np.zeros(len(size), bool)
    some[text[repeats[FIRST] >= 0] if len(repeats) > FIRST else []] = True
    stays, found, counts = np.ones(len(flat), bool), [np.zeros((0, 3), np.int64)], np.zeros(len(size), np.int64)
    for t in np.flatnonzero(some if repeats else size > 0):
        lo, hi = upto[t], upto[t + 1]
        mine = runs(word[lo:hi], least, times)
        found.append(mine)
        counts[t] = len(mine)
        stays[lo:hi] = _kept(int(size[t]), mine)
    start, length, period = (pa.array(c) for c in np.ascontiguousarray(np.concatenate(found).T))
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays([start, length, period], names=["start", "length", "period"]))
    left = np.concatenate([[0], np.cumsum(stays)])[upto]
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), flat.filter(pa.array(stays))), pa.scalar(" ", pa.large_string()))
    return pa.array(size.astype(np.int64)), listed, joined.cast(pa.string())


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Adds n_words, runs (start, length, period of each, by start, then period) and collapsed, the words no run repeats, to docs (text)."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    results = ("n_words", "runs", "collapsed")
    passed = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in results))
    made = T.StructType([*passed.schema.fields, *T.StructType.fromDDL(f"n_words long, runs {_RUNS}, collapsed string").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text"))
            sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy()
            for i, j in ranges(np.concatenate([[0], np.cumsum(sizes)])):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, *_worked(col.slice(i, j - i), least, times)], names=[*batch.schema.names, *results])

    return passed.mapInArrow(work, made)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the tail of every tenth text made periodic, as a hash of doc_id says."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    w, g, n, a, p = (F.col(c) for c in "wgnap")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("w"), F.floor(h / 10).cast("long").alias("g"))
    sized = chosen.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - a) / (3 + g % 8)).cast("long"))
    tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
    made = F.array_join(F.concat(F.slice(w, 1, a.cast("int")), tail), " ")
    return sized.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def most_repeated(found: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(found, none, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents"))).withColumn("most", most_repeated(F.col("runs")))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"most.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * most.length div most.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
