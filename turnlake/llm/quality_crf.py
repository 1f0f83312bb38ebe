"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is good or bad. Its features are what characters it is made of, how its words and
itself repeat, and the same of the lines before and after it. Weights and transitions maximise
the conditional likelihood of labelled documents' lines (a line takes its document's label),
by gradient steps on forward-backward expectations. A document's quality is the mean of its
lines' forward-backward marginals, weighted by line length, and a logistic curve fitted to the
document labels turns that into a score.

Learning takes a bounded sample of labelled rows: the TRAIN_DOCS label rows and of their texts the
TRAIN_DOCS rows that a hash puts first, then as many of these, in that order, as have TRAIN_LINES
lines together. A text's length doesn't bear on whether it is taken. Scoring takes every line of
every text; a chain is walked for all documents of a block at once.

Defined cases: a text of any length is scored whole; a null or empty text is one empty line and is scored like any other; without
labels the score is 0.5; rows with a null quality are not learned from; repeated rows count each, within the sample's bounds;
labels, lang, source and doc_id are never inputs of a score; an empty table gives no rows; other
columns pass through, but one with the name of a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.blocks import ranges, texts, words
from turnlake.llm.common import checkpointed, held_out, table

TRAIN_DOCS, TRAIN_LINES = 3000, 300_000
#: Bytes of text worked on at once.
BLOCK = 1 << 20
THRESHOLD = 0.7
_KINDS = ("upper", "lower", "digit", "space", "mark", "bang", "pipe", "stop", "other", "wide")
_KIND = np.full(256, 8, np.uint8)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c", "#$%&*@^~_=<>{}[]\\", "!", "|", ".,;:?")):
    _KIND[[ord(c) for c in _chars]] = _i
_KIND[128:] = 9
_NEAR = 10  # the first so many features are also taken from both neighbours
FEATURES = 16 + 2 * _NEAR + 2


@dataclass
class Model:
    weight: np.ndarray  # FEATURES
    step: np.ndarray  # 2 x 2 transitions
    mean: np.ndarray
    scale: np.ndarray
    curve: tuple[float, float]


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its length in bytes, and where each document's lines begin.

    offsets begin at 0 and end at len(data); lines end at a newline or with their text.
    """
    newline = np.flatnonzero(data == 10)
    # an empty text shares its place with the next row: rows are told apart by counting, not by place
    per_doc = np.searchsorted(newline, offsets[1:], "left") - np.searchsorted(newline, offsets[:-1], "left") + 1
    first = np.concatenate([[0], np.cumsum(per_doc)])
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    starts = offsets[doc].astype(np.int64)
    inner = np.ones(len(doc), bool)
    inner[first[:-1]] = False
    starts[inner] = newline + 1
    ends = offsets[doc + 1].astype(np.int64)
    follows = np.flatnonzero(inner)
    ends[follows - 1] = newline
    size = ends - starts
    kind = _KIND[data]
    count = np.empty((len(_KINDS), len(starts)))
    for k in range(len(_KINDS)):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == k, out=total[1:])
        count[k] = total[ends] - total[starts]
    upper, lower, digit, space, mark, bang, pipe, stop, other, wide = count
    full, letters = np.maximum(size, 1), np.maximum(upper + lower, 1)
    hashes, line = words(data, np.append(starts, len(data)))
    row = doc[line]
    order = np.lexsort((hashes, row))
    old = np.zeros(len(hashes))  # words that came before in their document
    old[order[1:]] = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    n_words = np.maximum(np.bincount(line, minlength=len(starts)), 1)
    repeat = np.bincount(line, old, len(starts)) / n_words
    twice = np.bincount(line[1:], (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1]), len(starts)) / n_words
    root = lambda x: np.sqrt(x / full)
    own = np.stack([
        upper / letters, root(mark), root(bang), root(pipe), root(digit), root(other), root(stop), root(space), repeat, twice,
        np.log1p(size), np.minimum(size / (space + 1), 40) / 10, root(wide), (size == 0) * 1.0, (stop + bang > 0) * 1.0, ((upper > 0) & (lower == 0)) * 1.0,
    ], 1)
    near = own[:, :_NEAR]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    head, tail = np.zeros(len(starts)), np.zeros(len(starts))
    head[first[:-1]], tail[first[1:] - 1] = 1, 1
    before[head > 0], after[tail > 0] = 0, 0
    return np.concatenate([own, before, after, head[:, None], tail[:, None]], 1), size, first


def chain(unary: np.ndarray, first: np.ndarray, step: np.ndarray, pairs: bool = False):
    """Forward-backward over the lines of all documents at once; label 0 scores 0, label 1 unary.

    Returns each line's probability of label 1, and with pairs the expected 2 x 2 transitions
    and the summed log partition.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    score = np.stack([np.zeros_like(unary), unary], 1)
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    steps = int(n[0]) if len(n) else 0
    alive = len(n) - np.searchsorted(n[::-1], np.arange(1, steps + 1), "left")  # documents with a line t
    for t in range(steps):
        i = begin[: alive[t]] + t
        alpha[i] = score[i] if t == 0 else score[i] + np.logaddexp(alpha[i - 1, :1] + step[0], alpha[i - 1, 1:] + step[1])
    for t in range(steps - 2, -1, -1):
        i = begin[: alive[t + 1]] + t
        ahead = score[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
    both = alpha + beta
    z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - z)
    if not pairs:
        return good
    inner = np.ones(len(unary), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    joint = alpha[j - 1][:, :, None] + step[None] + (score[j] + beta[j])[:, None, :] - z[j][:, None, None]
    return good, np.exp(joint).sum(0), float(z[first[:-1]].sum())


def _pooled(good: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    w = size + 1.0
    return np.add.reduceat(good * w, first[:-1]) / np.add.reduceat(w, first[:-1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 150) -> Model:
    """Adam on the mean conditional log-likelihood of a line, then the curve."""
    if not len(label):
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(FEATURES), np.ones(FEATURES), (0.0, 0.0))
    mean, scale = x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-3
    x = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    n = np.diff(first)
    y = np.repeat(label, n).astype(float)
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (n - 1)[label == k].sum()
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for k in range(1, rounds + 1):
        good, joint, _ = chain(x @ theta[:-4], first, theta[-4:].reshape(2, 2), True)
        grad = np.concatenate([x.T @ (y - good), (seen - joint).ravel()]) / len(x) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    step = theta[-4:].reshape(2, 2).copy()
    pooled = _logit(_pooled(chain(x @ theta[:-4], first, step), size, first))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * pooled + b, -30, 30)))
        g = np.array([((label - p) * pooled).mean() - 1e-3 * a, (label - p).mean()])
        h = p * (1 - p)
        hess = np.array([[(h * pooled * pooled).mean() + 1e-3, (h * pooled).mean()], [(h * pooled).mean(), h.mean() + 1e-6]])
        move = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a + move[0], b + move[1]
    return Model(theta[:-4], step, mean, scale, (float(a), float(b)))


def score_lines(model: Model, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The marginal of good of each line."""
    if len(model.weight) == FEATURES:
        return np.full(len(x), 0.5)
    return chain(((x - model.mean) / model.scale) @ model.weight[:-1] + model.weight[-1], first, model.step)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, quality), both without the held-out rows."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id", "label").limit(most)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch)
            for i, j in ranges(offsets, BLOCK):
                x, size, first = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cut = [slice(first[k], first[k + 1]) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i) for k in (1, 2)), pa.array(np.diff(first).astype(np.int64)), pa.array([x[s].astype(np.float32).tobytes() for s in cut], pa.binary()), pa.array([size[s].astype(np.int64).tobytes() for s in cut], pa.binary())],
                    names=["label", "nth", "n", "x", "size"],
                )

    # `most` rows of two numbers at most
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label", F.xxhash64("doc_id", "text", F.lit("quality")).alias("nth"))
    rows = checkpointed(joined.orderBy("nth", "label").limit(most).mapInArrow(prepare, "label int, nth long, n long, x binary, size binary"))
    # `most` rows at most, and `lines` lines in all or one text
    upto = Window.orderBy("nth", "label", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = rows.withColumn("upto", F.sum("n").over(upto)).where((F.col("upto") <= lines) | (F.col("upto") == F.col("n")))
    got = chosen.select("nth", "label", "n", "x", "size").toArrow().sort_by([("nth", "ascending"), ("label", "ascending")])
    n = got["n"].to_numpy()
    read = lambda c, kind: np.frombuffer(b"".join(got[c].to_pylist()), kind)
    return train(read("x", np.float32).reshape(-1, FEATURES), read("size", np.int64), np.concatenate([[0], np.cumsum(n)]).astype(int), got["label"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs without the text, and score, n_lines, n_good for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen numbers
    keep = [c for c in docs.columns if c.lower() not in ("text", "score", "n_lines", "n_good")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            data, offsets = texts(batch)
            parts: list[tuple] = []
            for i, j in ranges(offsets, BLOCK):
                x, size, first = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                good = score_lines(m, x, first)
                p = 1 / (1 + np.exp(-np.clip(m.curve[0] * _logit(_pooled(good, size, first)) + m.curve[1], -30, 30)))
                parts.append((p, np.diff(first), np.add.reduceat((good >= 0.5).astype(np.int64), first[:-1])))
            cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(cols[0], pa.float64()), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.int64))], names=[*keep, "score", "n_lines", "n_good"]
            )

    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double, n_lines long, n_good long"])
    return docs.select(*(F.col(f"`{c}`") for c in [*keep, "text"])).mapInArrow(run, ddl)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(4, 2))
    model = fit(docs, labels)
    scored = score(docs.withColumn("held_out", held_out(4, 2)).select("doc_id", "held_out", "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines", "n_good")
