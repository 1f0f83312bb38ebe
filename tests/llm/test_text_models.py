"""Decontamination, quality and language identification against brute force and held-out rows."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import plain
from turnlake.llm import blocks, decontaminate, language_id, quality_crf

SF = "/root/testdata/sf0.01"


def _norm(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _brute(text, items):
    words, hit, found = _norm(text), set(), set()
    for k, t in items:
        w = _norm(t)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1) if w else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(k))
    return len(words), len(hit), sorted(found), words, hit


@pytest.mark.parametrize(("most", "sweep"), [(4_000_000, 1), (150, 1 << 20), (40, 40)])
def test_decontamination_equals_brute_force_in_one_block_or_many(spark, most, sweep):
    item = "Alpha beta, Gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron É-é 12"
    items = [(1, item), (10, "Short é One"), (2, None), (3, "!!"), (4, "short é one"), (5, "aa aa aa aa aa aa aa aa aa aa aa aa aa")]
    texts = [None, "", "?!", f"x {item.upper().replace('É', 'É')} y", item, "short É one short é one! shorté one", "aa " * 40, "\x00Short\x7fé one" + " filler" * 200, "é" * 9 + " short é one é"]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(3, texts[3], "q")], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_contamination(docs.select("doc_id", "text"), bench, 13, most, sweep).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        n, h, found, words, hit = _brute(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, h, found), texts[r.doc_id]
        covered = list(itertools.chain.from_iterable(_norm(texts[r.doc_id][s.start : s.stop]) for s in r.spans))
        assert covered == [words[i] for i in sorted(hit)]
    assert all(r.n_hit == 0 for r in decontaminate.find_contamination(docs.select("doc_id", "text"), bench.limit(0)).collect())


def test_a_long_item_is_cut_and_automata_are_built_once_a_sweep(spark):
    item = " ".join(f"w{k}" for k in range(400))
    blocks_of = list(decontaminate.windows(spark.createDataFrame([(1, item), (2, item)], "item_id long, text string"), 13, 9000))
    assert len(blocks_of) > 3 and all(9000 <= sum(map(len, b)) < 9100 for b in blocks_of[:-1]) and {k for b in blocks_of for v in b.values() for k in v} == {"1", "2"}
    rows = [(i, f"x {item} y" if i % 50 == 0 else f"plain text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = decontaminate.find_contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), 13, 9000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: (r.n_hit, r["items"]) for r in out if r.n_hit} == {i: (400, ["1"]) for i in range(0, 3000, 50)}


def test_words_hash_like_words_whatever_the_cut(monkeypatch):
    texts = ["", "The cat the CAT\x0bThé", " lead", "x" * 300, "a b " * 200, ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    want = [(w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), i) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    seen = {}
    for block in (2 << 20, 16):
        monkeypatch.setattr(blocks, "BLOCK", block)
        h, rows = blocks.words(data, offsets)
        assert list(rows) == [i for _, i in want]
        for x, (w, _) in zip(h.tolist(), want):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_language_of_held_out_rows(spark):
    out = language_id.op5_language_id(spark, SF)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in out.collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 $%", None), (4, "the end of the day", "en"), (5, "der Tag und die Nacht", "de"), (None, "x" * 100000, None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs.select("text", "lang"))
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0)
    assert out[4][0] == "en" and out[5][0] == "de" and out[None][0] in ("en", "de")
    nothing = language_id.fit(docs.where("false").select("text", "lang"))
    assert {r.lang_pred for r in language_id.identify(docs.select("doc_id", "text"), nothing).collect()} == {"und"}
    for k in (2, 4, 7, 12, 40):
        code = language_id.codewords(k).astype(int)
        assert min((a != b).sum() for a, b in itertools.combinations(code, 2)) >= (1 if k < 4 else 3)


def _model(langs, seen):
    """The model of these counts (languages x DIM)."""
    code, mass = language_id.codewords(len(langs)), seen.sum(1) + 0.1 * language_id.DIM
    total = np.array([[sum((seen[k] / mass[k] for k in np.flatnonzero(bit == side)), np.zeros(language_id.DIM)) for side in (-1, 1)] for bit in code.T])
    return language_id.learned(langs, code, mass, total)


def test_the_query_equals_counts_margins_and_decoding_recomputed(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text or "") < 6000]
    docs = spark.createDataFrame(rows).select("doc_id", "text", "lang")
    fitted = language_id.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").select("text", "lang"))
    out = {r.doc_id: r for r in language_id.identify(docs, fitted).collect()}
    for d, (lang, score, doubt) in plain.languages([(r.doc_id, r.text, r.lang) for r in rows]).items():
        assert (out[d].lang_pred, out[d].ambiguous) == (lang, doubt) and abs(out[d].score - score) < 1e-4


def test_three_hundred_languages(spark, monkeypatch):
    rng = np.random.default_rng(5)
    names = [f"l{k:03d}" for k in range(300)]
    words = {x: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for x in names}
    said = lambda x: " ".join(rng.choice(words[x], 60))
    docs = spark.createDataFrame([(k, said(x), x) for k, x in enumerate(names * 2)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "HELD_LANGS", 20)
    out = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs.where("doc_id < 300").select("text", "lang"))).collect()
    assert np.mean([r.lang_pred == names[r.doc_id % 300] for r in out]) > 0.95


def test_language_of_a_text_does_not_depend_on_the_rows_beside_it():
    seen = np.random.default_rng(3).integers(1, 50, (4, language_id.DIM)).astype(float)
    model = _model(["a", "b", "c", "d"], seen)
    texts = ["the cat", "", "x", None, "été, 12 -- ab", "ab", "  der  Tag ", "zz"]
    together = list(zip(*language_id.predict(model, pa.array(texts))))
    alone = [next(zip(*language_id.predict(model, pa.array([t], pa.string())))) for t in texts]
    assert [(x[0], round(x[1], 9), x[2]) for x in together] == [(x[0], round(x[1], 9), x[2]) for x in alone]


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = [1, 4, 2, 6]
    first, u, step = np.concatenate([[0], np.cumsum(lengths)]), rng.normal(size=13), rng.normal(size=(2, 2))
    good, joint, z = quality_crf.chain(u, first, step, True)
    pairs, total = np.zeros((2, 2)), 0.0
    for d, n in enumerate(lengths):
        ys = list(itertools.product((0, 1), repeat=n))
        s = np.array([sum(u[first[d] + t] * y[t] for t in range(n)) + sum(step[y[t], y[t + 1]] for t in range(n - 1)) for y in ys])
        p = np.exp(s - np.logaddexp.reduce(s))
        total += np.logaddexp.reduce(s)
        for t in range(n):
            assert abs(good[first[d] + t] - sum(q for q, y in zip(p, ys) if y[t])) < 1e-9
            if t:
                for q, y in zip(p, ys):
                    pairs[y[t - 1], y[t]] += q
    assert np.allclose(pairs, joint) and abs(total - z) < 1e-9


def test_scores_equal_enumerated_labels_and_plain_features(spark):
    rng = np.random.default_rng(7)
    texts = ["One line of plain text.", "A B! c |\n\nthe the cat 12 ## Ünï", "", "x\ny z\nX|y\n" + "w" * 90]
    model = quality_crf.Model(rng.normal(size=quality_crf.FEATURES + 1) * 0.3, rng.normal(size=(2, 2)), rng.normal(size=quality_crf.FEATURES), rng.uniform(0.5, 2, quality_crf.FEATURES), (1.3, -0.2))

    def own(line, seen):
        kind = lambda f: sum(1 for c in line if f(c))
        wide, size = sum(len(c.encode()) for c in line if ord(c) > 127), len(line.encode())
        upper, lower, digit, space = (kind(lambda c, s=s: c in s) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c"))
        mark, bang, pipe, stop = (kind(lambda c, s=s: c in s) for s in ("#$%&*@^~_=<>{}[]\\", "!", "|", ".,;:?"))
        other = size - wide - upper - lower - digit - space - mark - bang - pipe - stop
        words = line.lower().split()
        repeat = 0
        for w in words:
            repeat += w in seen
            seen.add(w)
        n, root = max(len(words), 1), lambda x: math.sqrt(x / max(size, 1))
        return [upper / max(upper + lower, 1), *map(root, (mark, bang, pipe, digit, other, stop, space)), repeat / n, sum(a == b for a, b in zip(words, words[1:])) / n, math.log1p(size), min(size / (space + 1), 40) / 10, root(wide), float(size == 0), float(stop + bang > 0), float(upper > 0 and lower == 0)]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_crf.score(docs, model).collect():
        lines, seen = texts[r.doc_id].split("\n"), set()
        base = [own(x, seen) for x in lines]
        flat = [0.0] * 10
        unary = []
        for i, f in enumerate(base):
            x = [*f, *(base[i - 1][:10] if i else flat), *(base[i + 1][:10] if i + 1 < len(base) else flat), float(i == 0), float(i + 1 == len(base))]
            unary.append(sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weight)) + model.weight[-1])
        good, z = [0.0] * len(lines), 0.0
        for ys in itertools.product((0, 1), repeat=len(lines)):
            p = math.exp(sum(u * y for u, y in zip(unary, ys)) + sum(model.step[a, b] for a, b in zip(ys, ys[1:])))
            z += p
            good = [g + p * y for g, y in zip(good, ys)]
        size = [len(x.encode()) + 1 for x in lines]
        mean = sum(g / z * n for g, n in zip(good, size)) / sum(size)
        assert abs(r.score - 1 / (1 + math.exp(-(1.3 * math.log(mean / (1 - mean)) - 0.2)))) < 1e-9, texts[r.doc_id]
        assert (r.n_lines, r.n_good) == (len(lines), sum(g / z >= 0.5 for g in good))


def test_learning_takes_long_texts_and_bounds_lines(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_crf, "train", lambda x, size, first, label: seen.append((np.diff(first).tolist(), label.tolist())))
    docs = spark.createDataFrame([(k, "good line of text\n" * (2000 if k % 5 == 0 else 3)) for k in range(60)] + [(7, "twice")] * 40, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    quality_crf.fit(docs, labels, 30)
    quality_crf.fit(docs, labels, 30, 5000)
    quality_crf.fit(docs, labels, 100, 10**6)
    assert len(seen[0][0]) == 30 and 2001 in seen[0][0]
    assert sum(seen[1][0]) <= 5000 and seen[1][0] == seen[0][0][: len(seen[1][0])] and len(seen[1][0]) < 30
    assert len(seen[2][0]) == 100  # rows that repeat an id count each, within the bound


def test_line_features_count_lines_of_empty_and_ragged_texts():
    texts = ["", "a\n\nb\n", "", "one line", "\n"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    x, size, first = quality_crf.line_features(data, offsets)
    assert list(np.diff(first)) == [t.count("\n") + 1 for t in texts]
    assert list(size) == [len(s) for t in texts for s in t.split("\n")]
    assert x.shape == (len(size), quality_crf.FEATURES) and np.isfinite(x).all()


def test_quality_of_held_out_rows_and_edge_cases(spark):
    out = {r.doc_id: r for r in quality_crf.op1_quality(spark, SF).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(out[d].predicted, q) for d, q in truth.items() if out[d].held_out]
    assert np.mean([p == q for p, q in rows]) > 0.95 and all(0 <= r.score <= 1 for r in out.values())
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x\n" * 5000), (3, "y"), (None, "fine text")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (2, 0), (9, None), (None, 1)], "doc_id long, quality int")
    scored = quality_crf.score(docs, quality_crf.fit(docs, labels)).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored) and {r.n_lines for r in scored} == {1, 5001}
    assert {r.score for r in quality_crf.score(docs, quality_crf.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality_crf.score(docs.limit(0), quality_crf.fit(docs, labels.limit(0))).count() == 0


def test_numbers_that_are_no_digits_are_no_letters(spark):
    known = spark.createDataFrame([("the cat sat on the mat", "en"), ("der Hund lief durch das Haus", "de")] * 5, "text string, lang string")
    rows = [(1, "²"), (2, "½ 12"), (3, "Ⅷ"), (4, "٣ _ 7"), (5, "the cat Ⅷ"), (6, "ª"), (7, None)]
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), language_id.fit(known)).collect()}
    assert all(out[k] == ("und", 0.0) for k in (1, 2, 3, 4, 7)) and out[5][0] == "en" and out[6][0] != "und"
