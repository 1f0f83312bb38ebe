"""Replies that arrive as a stream of deltas: state by bucket of replies, of which each goes when the reply has ended.

A reply's deltas are kept in a list until its marker has come: `stop` with the chunk at which it was
stopped, or `end` with the number of its chunks. They may come in any order and in any batches; a reply
is told once, when all that belongs to it is there, and its state is dropped when all its chunks
were seen. What is kept thus grows with the replies that run at a time, not with those that ever ran.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnlake.operators.reads import fold, heads
from turnlake.sources.schemas import DELTAS

#: Keys of the state, to which replies or conversations are dealt.
BUCKETS = 1024


def deltas(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines deltas that arrive as files."""
    return spark.readStream.schema(DELTAS).json(path)


def bucket(*key: str) -> Column:
    """The bucket of a key, which many share: one key of the state."""
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).alias("bucket")


def _replies(_: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Deltas of a bucket's replies (conversation, message, chunk_index, delta, kind) to their texts, each told once."""
    # of each reply: how many chunks were seen; at which it was stopped, how many it has (-1: not known yet), whether it was told; what waits
    running: dict[tuple, list] = {}
    if state.exists:
        *each, flat, texts = state.get
        upto = 0
        for conversation, message, seen, stop, chunks, told, many in zip(*each):
            running[conversation, message] = [seen, stop, chunks, told, list(zip(flat[upto : upto + many], texts[upto : upto + many]))]
            upto += many
    for pdf in rows:
        for conversation, message, chunk, delta, kind in zip(*(pdf[c].tolist() for c in ("conversation", "message")), pdf["chunk_index"].astype("int64").tolist(), pdf["delta"].tolist(), pdf["kind"].tolist()):
            reply = running.setdefault((conversation, message), [0, -1, -1, False, []])
            if kind == "stop":
                reply[1] = chunk
            elif kind == "end":
                reply[2] = chunk
            else:
                reply[0] += 1
                if not reply[3]:
                    reply[4].append((chunk, delta))
    ended = []
    for key, reply in list(running.items()):
        seen, stop, chunks, told, parts = reply
        wanted = stop if 0 <= stop and (chunks < 0 or stop < chunks) else chunks
        if wanted >= 0 and not told:
            had = sorted(p for p in parts if p[0] < wanted)
            if len(had) == wanted:
                told, reply[3:] = True, [True, []]
                ended.append((*key, "".join(d for _, d in had), wanted != chunks))
        if told and seen == chunks:
            del running[key]
    if running:
        left = list(running.values())
        waiting = [p for r in left for p in r[4]]
        state.update((*([k[i] for k in running] for i in (0, 1)), *([r[i] for r in left] for i in range(4)), [len(r[4]) for r in left], [c for c, _ in waiting], [d for _, d in waiting]))
    elif state.exists:
        state.remove()
    if ended:
        yield pd.DataFrame(ended, columns=["conversation", "message", "content", "stopped"])


def told(stream: DataFrame) -> DataFrame:
    """conversation_id, message_seq, content, stopped of each reply, from deltas (conversation_id, message_seq, chunk_index, delta, kind).

    Replies are dealt to BUCKETS by hash, and a bucket is one key of the state: a call of Python costs milliseconds, so one
    for each reply and batch would be most of the time. A batch writes the state of the buckets that it meets.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    names = {"conversation": "conversation_id", "message": "message_seq"}
    rows = stream.select(bucket("conversation_id", "message_seq"), *(F.col(c).cast("string").alias(n) for n, c in names.items()), "chunk_index", "delta", "kind")
    ended = rows.groupBy("bucket").applyInPandasWithState(
        _replies, "conversation string, message string, content string, stopped boolean",
        "conversations array<string>, messages array<string>, seen array<int>, stop array<int>, chunks array<int>, told array<boolean>, held array<int>, at array<int>, parts array<string>",
        "append", GroupStateTimeout.NoTimeout,
    )
    return ended.select(*(F.col(n).cast(kinds[c]).alias(c) for n, c in names.items()), "content", "stopped")


def with_markers(deltas: DataFrame, stop_at: DataFrame | None = None) -> DataFrame:
    """deltas (conversation_id, message_seq, chunk_index, delta) with the markers of their replies; stop_at: conversation_id, message_seq, chunk_index."""
    ends = deltas.groupBy("conversation_id", "message_seq").agg((F.max("chunk_index") + 1).alias("chunk_index"))
    none = F.lit(None).cast("string").alias("delta")
    both = deltas.withColumn("kind", F.lit("delta")).unionByName(ends.select("*", none, F.lit("end").alias("kind")))
    return both if stop_at is None else both.unionByName(stop_at.select("conversation_id", "message_seq", "chunk_index", none, F.lit("stop").alias("kind")))


def collected(stream: DataFrame, folder: str) -> StreamingQuery:
    """Runs what is there into Parquet files of a shared folder, each reply once; state lies in RocksDB and its checkpoint in that folder."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def folded(stream: DataFrame) -> DataFrame:
    """The text received so far of each reply; a finished and a partial one look alike."""
    return fold(stream, "conversation_id", "message_seq")


def latest(stream: DataFrame) -> DataFrame:
    return heads(stream.withColumn("created_at", F.col("created_at").cast("timestamp")))


def start(frame: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Runs what is there into an in-memory table."""
    return frame.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(query: StreamingQuery, stop: threading.Event, poll: float = 0.05) -> str:
    """Waits for a query, or stops it when the flag is set; an error passes only if it was not asked to stop."""
    try:
        while not query.awaitTermination(poll):
            if stop.is_set():
                query.stop()
                return "stopped"
    except Exception:
        if stop.is_set():
            return "stopped"
        raise
    return "ended"
