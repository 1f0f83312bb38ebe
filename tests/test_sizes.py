"""What larger tables bring: ids of more digits, more files and rows than one batch, bucket or task should hold."""

import glob
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from turnlake.sources import bucketed
from turnlake.streaming import replies


def _rows(spark, folder, name):
    """The rows of a query and those of its SQL, on the tables of a folder."""
    duck = duckdb.connect()
    for path in folder.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    df, sql = entry.queries()[name](spark, str(folder)), duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    order = [sql.columns.index(c) for c in cols]
    return sorted([str(r[c]) for c in cols] for r in df.collect()), sorted([str(r[i]) for i in order] for r in sql.fetchall())


def test_sends_to_conversations_with_longer_ids(spark, tmp_path):
    duckdb.sql("SELECT 9990 + i AS conv_id, j AS turn, CASE j % 2 WHEN 0 THEN 'user' ELSE 'assistant' END AS role, 'text' AS text FROM range(30) x(i), range(2) y(j)").write_parquet(str(tmp_path / "conversations.parquet"))
    got, wanted = _rows(spark, tmp_path, "send_message")
    assert len(got) == 30 and got == wanted


def test_a_checkpoint_frees_its_shuffles(spark):
    common = pytest.importorskip("turnlake.llm.common")
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()

    def kept():
        return {f for d in env.blockManager().diskBlockManager().localDirsString() for f in glob.glob(f"{d}/*/shuffle_*")}

    before = kept()
    rows = common.checkpointed(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 10
    while kept() - before and time.time() < until:
        time.sleep(0.2)
    assert not kept() - before
    assert rows.count() == 7 and rows.agg(F.sum("count")).first()[0] == 1000


def test_buckets_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(bucketed, "BUCKET_ROWS", 500, raising=False)
    parents = spark.range(1500).select("id", (F.col("id") % 2).alias("kind"))
    # a third of the children are one parent's, a few have none or a null one
    parent = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, -1).when(F.col("id") % 50 == 2, None).otherwise(F.col("id") % 1500)
    children = spark.range(6000).select(parent.alias("parent"), F.col("id").alias("message")).repartition(3)
    pair = bucketed.together(parents, children, "id", "parent", 2)
    sizes = [r["n"] for r in pair.children.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 1500
    assert sorted(r.message for r in pair.orphans().collect()) == [i for i in range(6000) if i % 3 and i % 50 == 1]
    assert pair.without_children_of("kind = 1").where("parent = 7").count() == 0
    assert pair.joined().count() == sum(1 for i in range(6000) if i % 3 == 0 or i % 50 not in (1, 2))


def test_batches_of_repaints_do_not_grow_with_files(spark, tmp_path):
    rows = "SELECT (i * 31 + {k}) % 97 AS user_id, TIMESTAMP '2024-01-01' + to_seconds((i * 10 + {k}) * 977) AS ts, i * 10 + {k} AS event_id, '' AS props FROM range(200) x(i)"
    (tmp_path / "events.parquet").mkdir()
    for k in range(10):
        duckdb.sql(rows.format(k=k)).write_parquet(str(tmp_path / "events.parquet" / f"{k}.parquet"))
    seen = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/repaints-*"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a file a task
    try:
        got = {r.conversation_id: r.paints for r in entry.queries()["repaint_stream"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    sql = entry.oracle_sql()["repaint_stream"].replace("FROM events", f"FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert len(got) == 97 and got == dict(duckdb.sql(sql).fetchall())
    (folder,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/repaints-*")) - seen
    assert len(glob.glob(f"{folder}/checkpoint/offsets/[0-9]*")) <= 5


def test_replies_share_keys_of_the_state(spark, tmp_path):
    # none of 1,500 replies has ended, then all do: a null conversation is one, too
    kind = "conversation_id long, message_seq long, chunk_index int, delta string, kind string"
    part = F.when(F.col("id") != 5, F.col("id") * 10**15).alias("conversation_id"), F.lit(3).cast("long").alias("message_seq")
    spark.range(1500).select(*part, F.lit(1).alias("chunk_index"), F.lit("b").alias("delta"), F.lit("delta").alias("kind")).coalesce(1).write.parquet(f"{tmp_path}/in")

    def run():
        query = replies.collected(replies.told(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")), str(tmp_path))
        query.awaitTermination()
        return query.recentProgress[0]["stateOperators"][0]["numRowsTotal"]

    assert 0 < run() <= 1024
    more = [spark.range(1500).select(*part, F.lit(i).alias("chunk_index"), F.lit(d).cast("string").alias("delta"), F.lit(k).alias("kind")) for i, d, k in ((0, "a", "delta"), (2, None, "end"))]
    more[0].unionByName(more[1]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == 0
    got = spark.read.schema("conversation_id long, message_seq long, content string, stopped boolean").parquet(f"{tmp_path}/out").collect()
    assert {r.conversation_id for r in got} == {None if i == 5 else i * 10**15 for i in range(1500)} and len(got) == 1500
    assert {(r.message_seq, r.content, r.stopped) for r in got} == {(3, "ab", False)}
