"""The pipeline's stages against plain Python on the small tables."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import plain
from turnlake.llm import decontaminate, language_id, quality_crf, stages

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def test_stages_keep_what_brute_force_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900001, "12 $ %", None, None, None), (900002, None, "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(odd)
    known = stages.language(spark, docs, SF)
    kept = {r.doc_id: r for r in known.collect()}
    assert known.columns == docs.columns and not {900001, 900002} & kept.keys() and len(kept) >= docs.count() - 3
    sets = {d: _shingles(r.text) for d, r in kept.items()}
    root = {d: d for d in kept}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(kept)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    single = stages.near_copies(spark, known, SF)
    assert sorted(r.doc_id for r in single.collect()) == sorted({top(d) for d in ids})
    (block,) = decontaminate.windows(spark.read.parquet(f"{SF}/benchmark.parquet"))
    auto = decontaminate.automaton(block)
    scanned = lambda t: decontaminate.judged(t, decontaminate.occurrences(decontaminate._spaced(t)[1], auto))
    clean = stages.uncontaminated(spark, single, SF)
    want = [r for r in single.collect() if not (lambda n, h: h and 20 * h >= n)(*scanned(r.text)[:2])]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in want) and clean.columns == docs.columns
    drawn = Counter(r.doc_id for r in stages.mixed(spark, clean, SF).collect())
    taken = {r.doc_id: -(-r.taken // r.size) for r in stages.mixing.mix(clean).collect() if r.taken}
    assert drawn == taken


def test_the_whole_run_equals_brute_force(spark, tmp_path):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 5000]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    least = min((r for r in docs if len(r.text.split()) > 60), key=lambda r: r.doc_id)
    odd = [(900_001, "12 $ %", None, None, None), (900_002, None, "en", "src1", 0), (900_003, least.text + " end", "en", None, 1), (900_004, "see " + max(bench, key=len), "en", "zz", 1)]
    frame = spark.createDataFrame([*map(tuple, docs), *odd], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in frame.collect()]
    text = {d: t for d, t, _, _ in rows}
    found = plain.languages([r[:3] for r in rows])
    kept = [r for r in rows if found[r[0]][0] != "und" and not found[r[0]][2]]
    top = plain.components([r[:2] for r in kept])
    kept = [r for r in kept if top[r[0]] == r[0]]
    assert least.doc_id in top.values() and top[900_003] < 900_003
    clean = [r for r in kept if not plain.contaminated(r[1], bench)]
    assert 900_004 in {r[0] for r in kept} - {r[0] for r in clean}
    want = plain.mixed([(d, t, s) for d, t, _, s in clean])
    shards = {}
    for position, d, _ in want:
        size, crc = len(text[d].encode()) + 16, zlib.crc32(text[d].encode())
        shards.setdefault(plain.shard(str(d), [1.0] * 40), []).append((position, d, crc, size, plain.shard(str(d), [1.0] * 41)))
    flat = sorted((d, size, crc, "key", k, slot, grown) for k, v in shards.items() for slot, (_, d, crc, size, grown) in enumerate(v))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in out.collect()) == flat


CLASHES = ["row", "row_key", "size", "key", "slice", "src", "missing", "taken", "copy", "position", "n_hit", "items", "component_id", "fp", "shard", "slot", "n", "lang_pred", "score"]


def test_stages_with_odd_rows_and_clashing_columns(spark):
    text = "the men of the town went to the old mill and sat by the water until the evening came"
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = [(8, text, "en", "a", 1), (7, text + " again", "en", "a", 1), (7, text + " again", "en", "a", 1), (7, "a text that no other row has at all", "en", None, 1)]
    odd += [(None, text, None, None, None), (None, None, None, None, None), (900002, "", "en", "b", 0), (-3, text, "en", "a", 1)]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).select("*", *(F.lit(1).alias(c) for c in CLASHES))
    single = stages.near_copies(spark, docs, SF)
    assert single.columns == docs.columns
    mine = sorted((r.doc_id or 0, r.text or "") for r in single.collect() if r.doc_id is None or r.doc_id in (7, 8, -3, 900002))
    mine = [x for x in mine if x[1] in {t or "" for _, t, *_ in odd}]
    assert mine == [(-3, text), (0, ""), (7, "a text that no other row has at all"), (900002, "")]
    for _, stage in stages.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns and stage(spark, docs, SF).count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert sorted(r.slot for r in stages.sharded(spark, docs, SF).where("doc_id = 7").collect()) and stages.sharded(spark, docs, SF).count() == docs.count()


def test_results_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "the day", "x", "y", "z", "w")], "doc_id long, text string, n_words string, lang_pred string, Score string, n_lines string")
    assert decontaminate.find_contamination(docs, spark.createDataFrame([(1, "the")], "item_id long, text string")).first().n_words == 2
    model = language_id.learned(["en", "fr"], language_id.codewords(2), np.ones(2), np.ones((1, 2, language_id.DIM)))
    assert language_id.identify(docs, model).select("lang_pred", "score").first().lang_pred in ("en", "fr")
    fitted = quality_crf.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_crf.score(docs, fitted).select("score", "n_lines").first().n_lines == 1
