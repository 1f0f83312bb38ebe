"""Language identification by error-correcting output codes.

Every language has a codeword; the classifier of a bit tells the languages whose codeword has a 1
there from the others. It is linear in byte n-grams (ORDERS) of the lower-cased letters: the log
ratio of the mean n-gram distributions of the two sides, from counts over all training rows,
hashed to DIM buckets. A text's margin for a bit is the mean over its n-grams. Decoding is
weighted by loss: a bit weighs what its classifier tells apart on the training distributions, a
language costs the weighted logistic losses of its codeword's bits, and the cheapest wins.
A text is ambiguous where the runner-up costs nearly as little.

Counts are summed inside each task, then by Spark; the two sides of each bit are summed from them
likewise, as whole numbers of 2**-40 so that the order of sums doesn't matter. What reaches the
driver is a total a language and bits x DIM numbers, and bits grow with the logarithm of the
languages, of which there may be any number. Exhaustive codes up to 7 languages, beyond that rows
of seeded bits, as far apart as a greedy choice gets them.

Defined cases: a text that is null or has no letters (Unicode category L; numbers such as ², ½ or Ⅷ are none) is `und` with score 0; without training rows
every text is; rows with a null lang are predicted but not learned from; repeated rows count each;
a text of any length is worked on whole; an empty table gives no rows; lang, source and doc_id are never inputs; other columns pass
through, but one with the name of a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.blocks import BLOCK
from turnlake.llm.common import checkpointed, held_out, table

ORDERS = (2, 3, 4)
DIM = 1 << 14
#: Languages that a task counts before it passes their counts on.
HELD_LANGS = 256
SHARPNESS = 6.0
SCALE = float(1 << 40)
#: A text is ambiguous if the runner-up's probability is above this share of the winner's.
AMBIGUOUS = 0.5
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weight: np.ndarray  # bits
    table: np.ndarray  # bits x DIM


def codewords(k: int) -> np.ndarray:
    if k <= 1:
        return np.ones((k, 0), np.int8)
    if k <= 7:
        return np.array([[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for b in range(2 ** (k - 1) - 1)] for i in range(k)], np.int8)
    bits, rng = int(10 * np.ceil(np.log2(k))), np.random.default_rng(k)
    rows = np.zeros((k, bits), np.float32)
    for i in range(k):
        tries = rng.choice(np.array([-1, 1], np.int8), (64, bits))
        alike = (tries.astype(np.float32) @ rows[:i].T).max(1) if i else np.zeros(64)
        rows[i] = tries[int(np.argmin(alike))]
    code = rows.astype(np.int8)
    return code[:, (code != code[0]).any(0)]


def _blocks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, last row; letters as bytes, a space before and after each text; where texts begin."""
    rows: list[bytes] = []
    first = size = 0
    for i in range(len(col)):
        rows.append(b" %b " % (col[i].as_py() or "").lower().encode())
        size += len(rows[-1])
        if size >= BLOCK or i == len(col) - 1:
            yield first, i + 1, _KEEP[np.frombuffer(b"".join(rows), np.uint8)], np.cumsum([0, *map(len, rows)])
            rows, first, size = [], i + 1, 0


def _grams(low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket at each position, and which positions count (two spaces in a row lie in none)."""
    space = low == 32
    wide = low.astype(np.uint32)
    code = wide.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(low) < n:
            return
        code = code[:-1] | (wide[n - 1 :] << np.uint32(8 * (n - 1)))
        if n in ORDERS:
            m = len(code)
            double = space[:-1] & space[1:]
            fits = ~double[:m]
            for k in range(1, n - 1):
                fits &= ~double[k : k + m]
            yield ((code + np.uint32(n * 0x01000193)) * np.uint32(2654435761) >> np.uint32(32 - 14)).astype(np.int64), fits


def fit(docs: DataFrame) -> Model:
    """Learn from text and lang of docs (text, lang); rows to hold out are left out by the caller."""
    known = docs.where(F.col("lang").isNotNull()).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, v in sums.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], names=["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, j, low, starts in _blocks(batch.column(0)):
                names = {x: k for k, x in enumerate(dict.fromkeys(langs[i:j]))}
                row = np.repeat(np.array([names[x] for x in langs[i:j]]), np.diff(starts))
                for bucket, fits in _grams(low):
                    key, n = np.unique((row[: len(bucket)] * DIM + bucket)[fits], return_counts=True)
                    cut = np.searchsorted(key, np.arange(len(names) + 1) * DIM)
                    for name, k in names.items():
                        at = slice(cut[k], cut[k + 1])
                        sums.setdefault(name, np.zeros(DIM, np.int64))[key[at] - k * DIM] += n[at]
                if len(sums) > HELD_LANGS:
                    yield from told()
        yield from told()

    counts = checkpointed(known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one a language
    langs = sorted(totals)
    code, mass = codewords(len(langs)), np.array([totals[x] + 0.1 * DIM for x in langs])
    sent = docs.sparkSession.sparkContext.broadcast((langs, code, mass))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, code, mass = sent.value
        place = {x: i for i, x in enumerate(langs)}
        total = np.zeros((code.shape[1], 2, DIM), np.int64)
        for batch in batches:
            of = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            bucket, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in np.unique(of):
                mine = of == k
                parts = np.rint(n[mine] / mass[k] * SCALE).astype(np.int64)
                for bit, side in enumerate(code[k] > 0):
                    total[bit, int(side), bucket[mine]] += parts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.reshape(-1)[at])], names=["place", "n"])

    got = counts.mapInArrow(sides, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((code.shape[1], 2, DIM))
    total.reshape(-1)[got["place"].to_numpy()] = got["n"].to_numpy() / SCALE
    return learned(langs, code, mass, total)


def learned(langs: list[str], code: np.ndarray, mass: np.ndarray, total: np.ndarray) -> Model:
    """From the smoothed number of n-grams of each language, and for each bit the summed n-gram shares of its sides 0 and 1."""
    tables, weights = [], []
    for bit, sums in zip(code.T, total):
        neg, pos = ((sums[k] + (0.1 / mass[bit == s]).sum()) / (bit == s).sum() for k, s in ((0, -1), (1, 1)))
        tables.append(np.log(pos) - np.log(neg))
        weights.append(float(((pos - neg) * tables[-1]).sum()))
    weight = np.array(weights) / max(sum(weights), 1e-12)
    return Model(langs, code, weight, np.array(tables, np.float32).reshape(-1, DIM))


def predict(model: Model, col: pa.Array) -> tuple[list[str], list[float], list[bool]]:
    """lang_pred, score and ambiguous of each text."""
    out: tuple[list, list, list] = ([], [], [])
    for i, j, low, starts in _blocks(col):
        margin, n = np.zeros((j - i, len(model.weight))), np.zeros(j - i)
        for bucket, fits in _grams(low):
            at = np.minimum(starts[:-1], len(bucket) - 1)
            n += np.add.reduceat(fits, at, dtype=np.int64)
            for b, w in enumerate(model.table):
                margin[:, b] += np.add.reduceat(w[bucket] * fits, at, dtype=np.float64)
        margin /= np.maximum(n, 1)[:, None]
        cost = np.stack([(np.log1p(np.exp(-SHARPNESS * np.clip(margin * c, -50, 50))) * model.weight).sum(1) for c in model.code], 1) if len(model.langs) else np.zeros((j - i, 0))
        for r in range(j - i):
            if not cost.shape[1] or not any(map(str.isalpha, col[i + r].as_py() or "")):
                best, score, doubt = "und", 0.0, False
            else:
                p = np.exp(-SHARPNESS * (cost[r] - cost[r].min()))
                top = int(np.argmax(p))
                best, score = model.langs[top], float(p[top] / p.sum())
                doubt = bool(len(p) > 1 and np.partition(p, -2)[-2] > AMBIGUOUS * p[top])
            for o, v in zip(out, (best, score, doubt)):
                o.append(v)
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs without the text, and lang_pred, score, ambiguous for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits numbers at most
    keep = [c for c in docs.columns if c.lower() not in ("text", "lang_pred", "score", "ambiguous")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, doubt = predict(sent.value, batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], names=[*keep, "lang_pred", "score", "ambiguous"])

    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double, ambiguous boolean"])
    return docs.select(*(F.col(f"`{c}`") for c in [*keep, "text"])).mapInArrow(run, ddl)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(4, 2))
    model = fit(docs.where("NOT held_out").select("text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), model)
