"""Vector codes against the definition in plain whole numbers."""

import hashlib
import math
import random

import pytest

from turnlake.llm import vector_codes

ROW = "vec_id long, vector array<float>, label int, codes int, part int"


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) of each row, and the codebooks' digest."""
    good = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    width = len(good[0][1]) // parts if good else 0
    cut = [[tuple(math.floor(4096 * x) for x in r[1][p * width : (p + 1) * width]) for p in range(parts)] for r in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, book: min((far(v, b), i) for i, b in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            of = {}
            for c in cut:
                of.setdefault(best(c[p], book)[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(x) for x in zip(*of[i])) if i in of else b for i, b in enumerate(book)]
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    total = {}
    for r, f in zip(good, found):
        total[r[2]] = total.get(r[2], 0) + sum(e for e, _ in f)
    digest = hashlib.sha256(",".join(str(x) for book in books for b in book for x in b).encode()).hexdigest()
    return [(r[0], "".join(f"{i:02x}" for _, i in f), sum(e for e, _ in f), total[r[2]], digest) for r, f in zip(good, found)]


def made(seed, n=300, length=16):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(12)]
    near = lambda: [round(x + rng.gauss(0, 0.2), 3) for x in rng.choice(centre)]
    same = near()
    # a third of the vectors are one, a third of the labels too; 1/8 is exact in single precision
    vectors = [[round(8 * x) / 8 for x in (same if rng.random() < 0.33 else near())] for _ in range(n)]
    return [(i * 3 - 40, v, rng.choice([None, 7, 7, 7, rng.randrange(5)]), 0, 0) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_equal_the_definition(spark, tmp_path, seed):
    rows = made(seed)
    odd = [(900, None, 1, 0, 0), (-900, [], 1, 0, 0), (901, [None] + [1.0] * 15, 1, 0, 0), (902, [float("nan")] * 16, 1, 0, 0), (-903, [float("inf")] * 16, 1, 0, 0), (904, [1.0] * 8, 1, 0, 0), (None, [0.5] * 16, None, 0, 0), rows[5], rows[5]]
    frame = spark.createDataFrame([*rows, *odd], ROW).repartition(5)
    frame.withColumnRenamed("vector", "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vector_codes.op12_vector_codes(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute([*rows, *odd]), key=str)


def test_few_rows_make_small_codebooks_and_unused_entries_stay(spark):
    rows = [(i, [float(i // 2)] * 8, None, 0, 0) for i in range(6)]  # equal entries: the second is never nearest first
    out, books = vector_codes.compress(spark.createDataFrame(rows, ROW))
    assert books.shape == (8, 6, 1) and {(r.vec_id, tuple(r.codes), r.error) for r in out.collect()} == {(i, (2 * (i // 2),) * 8, 0) for i in range(6)}
    none, books = vector_codes.compress(spark.createDataFrame([(1, None, 1, 0, 0)], ROW))
    assert books is None and none.count() == 0 and none.columns == out.columns


def test_lengths_and_sizes_that_cannot_be_coded_are_told(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 9, 1, 0, 0)], ROW))
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1, 0, 0)], ROW))


def test_products_are_exact_at_the_largest_components():
    import numpy as np

    big = vector_codes.LARGEST
    parts, book = np.array([[big] * 8, [-big] * 8, [big - 1] * 8], np.int64), np.array([[-big] * 8, [big] * 8], np.int64)
    code, error = vector_codes.nearest(parts, book)
    assert code.tolist() == [1, 0, 1] and error.tolist() == [0, 0, 8]
