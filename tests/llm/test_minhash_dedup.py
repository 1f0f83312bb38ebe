"""Near-duplicates against all pairs, and the tables' recall against what they promise."""

import random

import numpy as np
import pytest

from tests.llm.test_ngram_join import _brute as pairs
from tests.llm.test_ngram_join import _rows
from turnlake.llm import minhash_dedup
from turnlake.llm.blocks import mix


def brute(rows):
    return [(d, n, c, d == c) for d, n, c, _ in pairs(rows, 85, 5)]


def told(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in frame.collect()), key=str)


@pytest.mark.parametrize(("seed", "block"), [(1, 64_000), (2, 900)])
def test_components_equal_all_pairs(spark, seed, block):
    rows = _rows(seed)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n string, fp int").repartition(3)
    assert told(minhash_dedup.near_duplicates(docs, block_tokens=block)) == sorted(brute(rows), key=str)


def test_sets_that_share_a_print_are_told_apart(spark):
    rows = _rows(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert told(minhash_dedup.near_duplicates(docs, block_tokens=9000, print_mask=31)) == sorted(brute(rows), key=str)


def test_a_large_family_with_strangers_is_verified_whole(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    near = [(i, " ".join([*base, f"a{i}"])) for i in range(260)]
    # each has a chain of its own, which drifts away from the base
    chains = []
    for c in range(6):
        text = list(base)
        for step in range(12):
            text[rng.randrange(120)] = f"c{c}s{step}"
            chains.append((1000 + 20 * c + step, " ".join(text)))
    rows = [*near, *chains, (5000, None), (5001, " ")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert told(minhash_dedup.near_duplicates(docs, block_tokens=2000)) == sorted(brute(rows), key=str)


def test_ties_of_a_task_hold_together_what_shares_a_table():
    rng = np.random.default_rng(4)
    fp = rng.permutation(np.arange(60) * 7 - 100)
    a, b = rng.integers(0, 25, (60, 4)), rng.integers(0, 6, (60, 4)).astype(np.int32)
    a += np.arange(4) * 1000  # half keys of different places differ

    def closed(edges):
        root = {int(x): int(x) for x in fp}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in edges:
            lo, hi = sorted((top(x), top(y)))
            root[hi] = lo
        return {x: top(x) for x in root}

    want = [(int(fp[x]), int(fp[y])) for x in range(60) for y in range(x) for i in range(4) if a[x, i] == a[y, i] and (b[x] == b[y]).any()]
    groups = {}
    for akey, own, first, half in minhash_dedup.tied_keys(fp, a, b):
        for k, f, j, h in zip(akey.tolist(), own.tolist(), first.tolist(), half.tolist()):
            for at, x in enumerate(h):
                groups.setdefault((k, j + at, x), set()).add(f)
    assert closed(want) == closed([(x, min(g)) for g in groups.values() for x in g])


def test_sets_at_the_threshold_meet_in_a_table_and_unrelated_ones_do_not():
    rng = np.random.default_rng(9)
    for sets in (1_000, 300_000):
        k, m = minhash_dedup.collections(sets)
        assert 2 * (1 - 0.85**k) ** m <= minhash_dedup.MISS and sets * m * m * 0.05 ** (2 * k) <= minhash_dedup.CHANCE
        pool = mix(rng.integers(0, 1 << 62, (400, 220), dtype=np.uint64))
        alike = [pool[:, :185], np.concatenate([pool[:, :170], pool[:, 200:215]], axis=1)]  # 170 of 200: exactly 0.85
        apart = [pool[:, :110], np.concatenate([pool[:, :10], pool[:, 110:210]], axis=1)]  # 10 of 210
        for (x, y), least, most in ((alike, 400, 400), (apart, 0, 1)):
            keys = [minhash_dedup.half_keys(minhash_dedup.minhashes(z.ravel(), np.full(400, z.shape[1]), 2 * m * k), k, m) for z in (x, y)]
            met = ((keys[0][0] == keys[1][0]).any(1)) & ((keys[0][1] == keys[1][1]).any(1))
            assert least <= met.sum() <= most
        # each minhash agrees as often as the sets are alike
        a, b = (minhash_dedup.minhashes(z.ravel(), np.full(400, 185), 200) for z in alike)
        assert abs((a == b).mean() - 0.85) < 0.01 and (a == b).mean(1).std() < 0.03


def test_empty_tables_and_a_hot_group_of_equal_rows(spark):
    docs = spark.createDataFrame([(i, "one two three four five six" if i % 3 == 0 else f"t{i} a b c d e {i}") for i in range(9000)], "doc_id long, text string")
    out = minhash_dedup.near_duplicates(docs)
    assert out.where("kept").count() == 6001 and out.where("component_id = 0").count() == 3000
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(None, "x y"), (None, "X y"), (4, "x Y"), (None, "z")], "doc_id long, text string")
    assert told(minhash_dedup.near_duplicates(only)) == sorted([(None, 1, 4, False)] * 2 + [(4, 1, 4, True), (None, 1, None, True)], key=str)
