"""The curriculum: each source's words fall where its schedule asks for them, over all passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.llm import mixing, stages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    # a hot source beside small ones, which reach the cap of three passes
    rows = [(i, "w " * (3 + i % 5), "a" if i % 10 else "b" if i % 20 else "c") for i in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


def test_words_in_every_interval_follow_the_schedules(docs):
    mixed = mixing.mix(docs)
    plan = {r.source: r for r in mixed.groupBy("source").agg(F.first("target").alias("target"), F.first("slope").alias("slope"), F.first("source_size").alias("size")).collect()}
    assert max(round(r.target / r["size"], 6) for r in plan.values()) == 3
    rows = mixing.in_training_order(mixing.passes(mixed)).collect()
    for source, r in plan.items():
        t, n = (np.array([x[k] for x in rows if x.source == source]) for k in ("position", "taken"))
        assert n.sum() == np.floor(r.target + 0.5) and t.min() >= 0 and t.max() <= 1
        for lo in np.arange(0, 1, 0.1):
            asked = [r.target * (x + r.slope * (x * x - x)) for x in (lo, lo + 0.1)]
            assert abs(n[(t >= lo) & (t < lo + 0.1)].sum() - (asked[1] - asked[0])) <= 8, (source, lo)


def test_every_pass_has_a_row_and_the_passes_add_up(docs):
    mixed = mixing.mix(docs)
    whole = {r.doc_id: (r.taken, r.size, r.position) for r in mixed.collect()}
    got = {}
    for r in mixing.passes(mixed).orderBy("doc_id", "pass").collect():
        got.setdefault(r.doc_id, []).append((r["pass"], r.taken, r.position))
    assert got.keys() == {d for d, (taken, _, _) in whole.items() if taken}
    for d, x in got.items():
        taken, size, position = whole[d]
        assert [k for k, _, _ in x] == list(range(-(-taken // size))) and sum(n for _, n, _ in x) == taken
        assert x[0][2] == position and all(a[2] < b[2] for a, b in zip(x, x[1:]))


def test_the_query_goes_through_the_curriculum(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    query = mixing.op10_mixing(spark, SF)
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" in plan and "RepartitionByExpression" in plan
    rows = query.collect()
    assert len(rows) == len(at) and all(r.position == at[r.doc_id] for r in rows)
    got = [(r.position is None, r.position or 0, r.doc_id) for r in rows]
    assert got == sorted(got)
    read = sorted((x.position, x.doc_id, x["pass"]) for x in mixing.passes(mixing.mix(docs)).collect())
    first = {d: k for k, (_, d, p) in enumerate(read) if p == 0}
    assert {r.doc_id: r.training_rank for r in rows if r.taken} == first


def test_a_very_long_text_and_clashing_columns(spark):
    rows = [(1, "w " * 300_000, "a"), (2, "w", "a"), (None, "w w", "b"), (None, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit(1).alias(c) for c in ("size", "key", "slice", "src", "target", "taken", "position", "pass")))
    out = mixing.mix(docs).collect()
    assert sorted(r.size for r in out) == [0, 1, 2, 300_000] and all(r.taken <= 3 * r.size for r in out)


def test_slots_follow_the_position_through_the_last_stages(spark, docs):
    rows = stages.mixed(spark, docs, "")
    assert rows.columns == [*docs.columns, "position"]
    want = sorted((r.position, r.doc_id) for r in mixing.passes(mixing.mix(docs)).collect())
    assert sorted((r.position, r.doc_id) for r in rows.collect()) == want
    shards = {}
    for r in stages.sharded(spark, rows, "").collect():
        shards.setdefault(r.shard, []).append((r.slot, r.position, r.doc_id))
    assert sorted((t, d) for x in shards.values() for _, t, d in x) == want
    for x in map(sorted, shards.values()):
        assert [k for k, _, _ in x] == list(range(len(x))) and [y[1:] for y in x] == sorted(y[1:] for y in x)
