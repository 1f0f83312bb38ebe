"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from turnlake.llm import periodic_runs


def brute(w, least=24, times=3):
    """start, length, period of every run, by start, then period."""
    found = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and not any(q % d == 0 and all(w[x] == w[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def plant(doc_id, text):
    h, w = zlib.crc32(str("" if doc_id is None else doc_id).encode()), words(text)
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def made(rng):
    """Words with periodic stretches inside, some with a word changed, some in one another."""
    w = [rng.choice("abcde") for _ in range(rng.randrange(0, 60))]
    for _ in range(rng.randrange(4)):
        unit = [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 14))]
        stretch = (unit * 30)[: rng.randrange(10, 160)]
        if rng.random() < 0.3:
            stretch[rng.randrange(len(stretch))] = "z"
        at = rng.randrange(len(w) + 1)
        w[at:at] = stretch
    return w


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for k in range(250):
        w = made(rng)
        number = {x: i for i, x in enumerate(dict.fromkeys(w))}
        least, times = rng.choice([(24, 3), (24, 3), (6, 2), (1, 2), (40, 5)])
        found = periodic_runs.runs(np.array([number[x] for x in w], np.int64), least, times)
        assert [tuple(r) for r in found.tolist()] == brute(w, least, times), (k, w, least, times)


def test_names_are_equal_where_words_are_and_only_inside_a_text():
    rng = random.Random(3)
    word, text = np.array([rng.randrange(3) for _ in range(300)]), np.repeat(np.arange(3), 100)
    for k, names in enumerate(periodic_runs.levels(word, text)[1:], 1):
        for i in range(300 - 2**k + 1):
            same = [j for j in range(300 - 2**k + 1) if text[j] == text[i] == text[i + 2**k - 1] == text[j + 2**k - 1] and (word[j : j + 2**k] == word[i : i + 2**k]).all()]
            assert [j for j in range(300) if names[j] == names[i]] == (same or [i])


def test_the_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a " * 23, "a " * 24, "A a " * 30, "\xa0x " * 40, "é b \x0b" * 30, *(" ".join(made(rng)) for _ in range(120)), " ".join(rng.choice(["in", "on", "at"]) + str(rng.randrange(900)) for _ in range(6000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one two three " * 20), (7, texts[20]), (7, texts[20])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def told(doc_id, text):
        w = plant(doc_id, text)
        found = brute(w) if len(w) < 2000 else [tuple(r) for r in periodic_runs.runs(np.unique(w, return_inverse=True)[1]).tolist()]
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(kept(w, found))))

    got = sorted((tuple(r) for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((told(*r) for r in rows), key=str)
    assert any(r[1] for r in got) and any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts)))


def test_long_texts_empty_tables_and_clashing_columns(spark):
    same, unit = "same " * 200_000, " ".join(f"w{i}" for i in range(50_000)) + " "
    rows = spark.createDataFrame([(1, same, 0, 0), (2, unit * 4, 0, 0), (2, unit * 4, 0, 0), (3, None, 0, 0)], "doc_id long, text string, runs int, word int")
    out = sorted((r.doc_id, [tuple(x) for x in r.runs], r.n_words, len(r.collapsed.split()), r.word) for r in periodic_runs.periodic_runs(rows).collect())
    assert out == [(1, [(0, 200_000, 1)], 200_000, 1, 0), *[(2, [(0, 200_000, 50_000)], 200_000, 50_000, 0)] * 2, (3, [], 0, 0, 0)]
    assert periodic_runs.periodic_runs(rows.limit(0)).count() == 0


def test_the_run_that_repeats_most_is_found_exactly(spark):
    rows = spark.createDataFrame([([(5, 70, 7), (9, 100, 10), (2, 60, 6)],), ([(1, 30_000_001, 10_000_000), (4, 30_000_004, 10_000_001)],), ([],)], "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    got = [r.m and tuple(r.m) for r in rows.select(periodic_runs.most_repeated(F.col("runs")).alias("m")).collect()]
    assert got == [(5, 70, 7), (1, 30_000_001, 10_000_000), None]
