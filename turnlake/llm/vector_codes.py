"""Vector code compression: product codebooks learned in whole numbers.

Components are floor(SCALE * x). A vector is cut into PARTS equal consecutive parts; each part
position has a codebook, which starts as that part of the ENTRIES vectors with the smallest ids. In
each round the codebooks (ENTRIES x dimension numbers, whatever the table's size) are broadcast, a
task computes for each Arrow batch all distances of its parts by norm expansion, |x|^2 - 2 x.c +
|c|^2 with an exact int64 matrix product, takes the first least one and adds the parts up by entry.
A task passes on one row an entry and component; Spark sums these in a grouped shuffle, and what
comes to the driver is the next codebooks' ENTRIES x dimension sums. Whole numbers make the result
the same however rows lie in tasks, and however often a lost task runs again.

The vectors are read again each round instead of being kept; nothing of their size is shuffled or
written. The coded rows (a few bytes each) are checkpointed once; a label's error is a grouped sum,
and where the rows meet it again a label that holds most rows is split over tasks.

Defined cases: rows whose vector is null, or holds null or a non-finite number, go; so do those of
another length than the vector with the smallest id has, empty ones among them, since parts of
different lengths have no distance. The length must be a multiple of the parts, or ValueError tells
so. Repeated rows are coded each; ids that tie for a first entry go by their vectors, a null id
comes last; with fewer rows than entries the codebooks are that much smaller; null labels are one
label; an empty table gives no rows; other columns are not looked at, whatever their names. A
component beyond +-LARGEST after scaling fails the job with ValueError, since sums of squares past
it need more than 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import checkpointed, spread_join, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Largest size of a scaled component: a part of up to 64 of them has squared distances below 2**62.
LARGEST = 1 << 27
#: Vectors whose distances are computed at once.
CHUNK = 4096


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) and label of the rows whose vector holds finite numbers only, and some."""
    vector = F.col("vector").cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return vectors.where((F.size(vector) > 0) & finite).select("vec_id", vector.alias("vector"), "label")


def scaled(values: np.ndarray) -> np.ndarray:
    whole = np.floor(SCALE * values)
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / SCALE} in size")
    return whole.astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one part of many vectors the first nearest entry of its codebook, and the squared distance."""
    far = (book * book).sum(1)[None, :] - 2 * (parts @ book.T)
    code = far.argmin(1)
    return code, (parts * parts).sum(1) + far[np.arange(len(parts)), code]


def _coded(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In chunks of a batch's vectors: their parts (position, vector, component), codes and squared distances by position."""
    x = batch.column(batch.schema.get_field_index("vector")).flatten().to_numpy().reshape(batch.num_rows, -1)
    for at in range(0, len(x), CHUNK):
        part = scaled(x[at : at + CHUNK]).reshape(-1, len(books), books.shape[2]).transpose(1, 0, 2)
        found = [nearest(p, b) for p, b in zip(part, books)]
        yield part, np.stack([c for c, _ in found]), np.stack([e for _, e in found])


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks (position, entry, component) of the vectors with the smallest ids; None where there are none."""
    by_id = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector")
    first = by_id.limit(entries).collect()
    if not first:
        return None
    length = len(first[0].vector)
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    if any(len(r.vector) != length for r in first):
        first = by_id.where(F.size("vector") == length).limit(entries).collect()
    whole = scaled(np.array([r.vector for r in first]))
    return np.ascontiguousarray(whole.reshape(len(first), parts, -1).transpose(1, 0, 2))


def next_books(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the mean, rounded down, of the parts that are nearest to it; one without parts stays."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = sent.value
        total, count = np.zeros_like(book), np.zeros(book.shape[:2], np.int64)
        for batch in batches:
            for part, code, _ in _coded(batch, book):
                for p in range(len(book)):
                    chosen = (code[p][None, :] == np.arange(book.shape[1])[:, None]).astype(np.int64)
                    total[p] += chosen @ part[p]
                    count[p] += chosen.sum(1)
        p, e, c = (x.ravel() for x in np.indices(book.shape))
        used = count[p, e] > 0
        columns = (p[used].astype(np.int32), e[used].astype(np.int32), c[used].astype(np.int32), total.ravel()[used], count[p, e][used])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["part", "entry", "component", "total", "n"])

    # a task's sums are at most as many rows as the codebooks have numbers
    each = vectors.select("vector").mapInArrow(sums, "part int, entry int, component int, total long, n long")
    merged = each.groupBy("part", "entry", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = books.copy()
    for r in merged:
        out[r.part, r.entry, r.component] = r.total // r.n
    sent.unpersist()
    return out


def learned(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """The vectors that can be coded, of kept ones, and the codebooks after so many rounds."""
    books = first_books(vectors, parts, entries)
    if books is None:
        return vectors, None
    fitting = vectors.where(F.size("vector") == books.shape[0] * books.shape[2])
    for _ in range(rounds):
        books = next_books(fitting, books)
    return fitting, books


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (one a part, in order) and error (squared distances summed over parts) of kept vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = [np.zeros((0, len(books)), np.int32)], [np.zeros(0, np.int64)]
            for _, c, e in _coded(batch, sent.value):
                code.append(c.T.astype(np.int32))
                error.append(e.sum(0))
            flat = np.concatenate(code)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            names = ("vec_id", "label")
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), lists, pa.array(np.concatenate(error))], names=[*names, "codes", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, codes, error and label_error (errors summed over rows of a label) for vectors (vec_id, vector, label), and the codebooks."""
    fitting, books = learned(kept(vectors), parts, entries, rounds)
    if books is None:
        return fitting.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), None
    key = (F.col("label").isNull().alias("_null"), F.coalesce("label", F.lit(0).cast(fitting.schema["label"].dataType)).alias("_label"))
    rows = checkpointed(coded(fitting, books)).select("*", *key)
    labels = rows.groupBy("_null", "_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    met = spread_join(rows, labels, ["_null", "_label"], "_rows", [F.col("vec_id"), F.spark_partition_id()])
    return met.select("vec_id", "label", "codes", "error", "label_error"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    found, books = compress(vectors)
    digest = hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds written out, each a table of its own; sums, distances and means are whole numbers."""
    assigned = lambda r: f"""a{r} AS MATERIALIZED (
  SELECT row, part, min(far * {ENTRIES} + entry) % {ENTRIES} AS entry, min(far * {ENTRIES} + entry) // {ENTRIES} AS far
  FROM (SELECT row, x.part, entry, CAST(sum((x.v - b.v) * (x.v - b.v)) AS BIGINT) AS far FROM x JOIN b{r} b ON b.part = x.part AND b.pos = x.pos GROUP BY ALL) GROUP BY row, part)"""  # noqa: E731
    averaged = lambda r: f"""b{r + 1} AS MATERIALIZED (
  SELECT part, entry, pos, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v
  FROM b{r} LEFT JOIN (SELECT x.part, a.entry, x.pos, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{r} a ON a.row = x.row AND a.part = x.part GROUP BY ALL) USING (part, entry, pos))"""  # noqa: E731
    rounds = ",\n".join(part for r in range(ROUNDS) for part in (assigned(r), averaged(r)))
    return f"""
WITH e AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, embedding AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT row, i * {PARTS} // len(vector) AS part, i % (len(vector) // {PARTS}) AS pos, CAST(floor(4096 * CAST(vector[i + 1] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT row, vector, unnest(range(len(vector))) AS i FROM e)),
b0 AS (SELECT part, row AS entry, pos, v FROM x WHERE row < {ENTRIES}),
{rounds},
{assigned(ROUNDS)},
c AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256
FROM c JOIN e USING (row)
"""


SQL = _sql()
