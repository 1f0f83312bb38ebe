"""Scores against a plain count of every bigram; the trie against a dictionary."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from turnlake.llm import ngram_lm

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), "</s>"]


def test_trie_finds_what_is_there_and_nothing_else():
    rng = np.random.default_rng(3)
    contexts = 700
    keys = np.unique((rng.integers(0, contexts, 5000) // 3 << ngram_lm._WIDTH) | rng.integers(0, 300, 5000))
    values = rng.integers(1, 4096, len(keys))
    trie = ngram_lm.Trie(ngram_lm._mapped(ngram_lm.Trie.pack(keys, values, contexts)))
    want = dict(zip(keys.tolist(), values.tolist()))
    ask = np.concatenate([keys, rng.integers(0, contexts << ngram_lm._WIDTH, 3000), keys + 1])
    ask = ask[(ask >> ngram_lm._WIDTH) < contexts]
    assert trie.find(ask).tolist() == [want.get(k, 0) for k in ask.tolist()]
    assert (trie.word[np.arange(len(keys))] == keys).all()
    empty = ngram_lm.Trie(ngram_lm._mapped(ngram_lm.Trie.pack(keys[:0], values[:0], contexts)))
    assert empty.find(ask).sum() == 0


def test_no_rows_and_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = ngram_lm.score(docs.selectExpr("*", "false AS train"), ngram_lm.vocabulary(docs.selectExpr("*", "false AS train"))).collect()
    assert sorted((r.n_tokens, r.n_known) for r in out) == [(1, 0), (3, 0)] and all(np.isfinite(r.score) for r in out)
    none = docs.limit(0).selectExpr("*", "true AS train")
    assert ngram_lm.score(none, ngram_lm.vocabulary(none)).count() == 0


@pytest.mark.parametrize(("head", "dense", "shard"), [(1 << 17, 512, 10**6), (40, 6, 300), (0, 4, 100)])
def test_scores_equal_plain_counts_of_all_bigrams(spark, monkeypatch, tmp_path, head, dense, shard):
    monkeypatch.setattr(ngram_lm, "HEAD", head)
    monkeypatch.setattr(ngram_lm, "DENSE", dense)
    monkeypatch.setattr(ngram_lm.score, "__defaults__", (shard,))
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.3, rng.integers(0, 60)) if k < 3000)) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "unseen words only"), (503, "once upon unseen"), (7, rows[7][1]), (None, "W1 w2\tw1"), (None, "W1 w2\tw1"), (504, "w2 " * 50_000)] + [(600 + i, "once upon a rare thing") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    scored = ngram_lm.op6_ngram_lm(spark, str(tmp_path)).collect()
    out = {r.doc_id: r for r in scored}
    assert len(scored) == len(rows)
    uni, pair = Counter(), Counter()
    for d, x in rows:
        if zlib.crc32(str("" if d is None else d).encode()) % 5 != 1:
            t = _tokens(x)
            uni.update(["<s>", *t])
            pair.update(zip(["<s>", *t], t))
    n, kinds = sum(uni.values()) - uni["<s>"], len(uni) - 1
    share = lambda t: (uni[t] + 0.5) / (n + 0.5 * (kinds + 1))
    for d, x in rows:
        t = _tokens(x)
        total = sum(math.log10((pair[a, b] + ngram_lm.MU * share(b)) / (uni[a] + ngram_lm.MU)) for a, b in zip(["<s>", *t], t))
        assert (out[d].n_tokens, out[d].n_known) == (len(t), sum(uni[w] > 0 for w in t))
        assert abs(out[d].base_score - sum(math.log10(share(w)) for w in t)) < 1e-6 * max(1, len(t))
        assert total - ngram_lm.STEP * len(t) - 1e-5 <= out[d].score <= total + 1e-5
