"""The join against all pairs, on edited copies at every distance around the threshold."""

import random
import re

import numpy as np
import pytest

from turnlake.llm import components, ngram_join


def _set(t, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def _brute(rows, percent=90, n=3):
    sets = [_set(t, n) for _, t in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]) and both:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(sets[i]), least.get(top(i)), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def _rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + str(rng.randrange(40))
    texts = [None, "", " \t\n", "One", "one", "one two", "ONE two", "two one"]
    for size in (4, 9, 12, 13, 20, 33, 60, 150, 151, 400):
        base = [word() for _ in range(size)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, size // 20))):
                k = rng.randrange(len(copy))
                match rng.randrange(3):
                    case 0:
                        copy[k] = word()
                    case 1:
                        del copy[k]
                    case _:
                        copy.insert(k, word())
            texts.append(" ".join(copy))
        texts += [texts[-1], texts[-1].upper()]
    rng.shuffle(texts)
    return [(i if i % 19 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "block"), [(1, 64_000), (2, 900)])
def test_join_equals_all_pairs(spark, seed, block):
    rows = _rows(seed)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n string").repartition(3)
    out = ngram_join.jaccard_components(docs, block_tokens=block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out), key=str) == _brute(rows)


def test_a_family_of_many_short_near_copies_is_split(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base, f"a{i}"])) for i in range(150)] + [(1000 + i, " ".join([f"b{i}", *base[1:], f"a{i}"])) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_join.jaccard_components(docs, block_tokens=640).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out), key=str) == _brute(rows)


def test_long_words_that_differ_are_told_apart(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    docs = spark.createDataFrame([(1, f"{a} x y"), (2, f"{b} x y"), (3, f"{a.upper()} X y")], "doc_id long, text string")
    out = ngram_join.jaccard_components(docs).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in out) == [(1, 1, 1), (2, 2, 0), (3, 1, 1)]


def test_sets_with_the_same_print_are_told_apart(spark):
    rows = _rows(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for mask in (3, 31):  # two and five bits: nearly all sets share a print
        out = ngram_join.jaccard_components(docs, block_tokens=9000, print_mask=mask).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out), key=str) == _brute(rows)


def test_large_sets_and_a_hot_group(spark):
    rng = random.Random(11)
    rows, i = [], 0
    for size in (600, 1500, 5000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for edits in (0, 0, size // 100, size // 64, size // 62, size // 60, size // 50):
            copy = list(base)
            for k in rng.sample(range(size), edits):
                copy[k] = f"e{rng.randrange(10**6)}"
            rows.append((i := i + 1, " ".join(copy)))
    rows += [(10_000 + k, "one text that a third of all rows hold") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = ngram_join.jaccard_components(docs, block_tokens=4000).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out), key=str) == _brute(rows)


def test_allocation_is_the_cheapest_at_every_size():
    # at 10**9 sets the deletion neighbourhoods pay off for large sets too
    assert ngram_join.allocation(575, 638, 10**9)[1] > 0 and ngram_join.allocation(11_043, 12_269, 10**9)[1] > 0


def test_empty_table(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sets", [1, 10_000, 10**9])
def test_linked_sets_share_a_signature_under_every_allocation(sets):
    rng = np.random.default_rng(sets % 97)
    lows = ngram_join.bands(3000)
    plan = {b: ngram_join.allocation(lows[b], lows[b + 1] - 1, sets) for b in range(len(lows) - 1)}
    assert all(m + u > ngram_join.bound(lows[b + 1] - 1) for b, (m, u) in plan.items() if m)
    for n in (10, 11, 19, 20, 40, 95, 300, 1000):
        for _ in range(20):
            a = rng.integers(1, 2**62, n).astype(np.uint64)
            drop = rng.integers(0, n // 19 + 1)
            add = next(k for k in range(n, -1, -1) if 190 * (n - drop) >= 90 * (n + n - drop + k)) if 190 * (n - drop) >= 90 * (2 * n - drop) else 0
            drop = drop if 190 * (n - drop) >= 90 * (2 * n - drop) else 0
            b = np.concatenate([a[drop:], rng.integers(1, 2**62, add).astype(np.uint64)])
            found, owner, size = np.concatenate([np.sort(a), np.sort(b)]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)])
            both = ({}, {})
            for sig, row in ngram_join.signatures(found, owner, size, np.array(lows), plan):
                for s, r in zip(sig.tolist(), row.tolist()):
                    both[r][s] = 1
            equal = drop == 0 and add == 0
            assert equal or both[0].keys() & both[1].keys()


def test_empty_subsets_tie_no_sets_by_chance():
    rng = np.random.default_rng(2)
    size = np.full(20_000, 10)
    found, owner = np.sort(rng.integers(1, 2**62, (20_000, 10)).astype(np.uint64), axis=1).ravel(), np.repeat(np.arange(20_000), 10)
    lows = np.array(ngram_join.bands(40))
    b = int(np.searchsorted(lows, 10, "right")) - 1
    sigs = list(ngram_join.signatures(found, owner, size, lows, {b: ngram_join.allocation(int(lows[b]), int(lows[b + 1]) - 1, 20_000)}))
    sig, row = (np.concatenate([x[k] for x in sigs]) for k in (0, 1))
    pairs = np.unique(np.stack([sig, row]), axis=1)
    assert np.unique(pairs[0], return_counts=True)[1].max() <= 2  # of 20,000 sets that share nothing


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 180)] + [(5, 5), (200, 199), (199, 200)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 1 for i in range(1, 61)}, **{k: 100 for k in range(100, 180)}, 199: 199, 200: 199}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_large_star_beside_others(spark):
    # one centre has nearly all edges, far above a task's share
    edges = [(k, 7) for k in range(8, 4000)] + [(k, k + 1) for k in range(10_000, 10_020)]
    frame = spark.createDataFrame(edges, "a long, b long")
    assert components._shape(frame.select(components.F.col("a").alias("u"), components.F.col("b").alias("v")))[2] is False
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = {r.node: r.root for r in components.components(frame.unionByName(spark.createDataFrame([(4000, 3999), (3, 3998)], "a long, b long"))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out == {3: 3, **{k: 3 for k in range(7, 4001)}, **{k: 10_000 for k in range(10_000, 10_021)}}


def test_links_of_sets_larger_than_a_block_count_once(spark):
    # sets of more tokens than a block holds leave blocks of their family empty
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ngram_join.jaccard_components(docs, block_tokens=350).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in out) == [(i, 0, 11) for i in range(12)]
