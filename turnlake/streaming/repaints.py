"""Repaints of a display on a stream: it waits for the gap since its last paint.

Times may come in any order within the watermark. They wait in the state of a bucket of conversations until the watermark has passed them,
are then taken in order, and go; what stays of a conversation is when it was painted last and how often. An event-time timeout at the
earliest time that waits wakes a bucket nothing more is heard of.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnlake.streaming.replies import bucket


def _painting(gap: int):
    def painting(_: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Times of a bucket's conversations (us: microseconds) to the paints they lead to; a first one, which starts the clock, is number 0."""
        known: dict[str | None, tuple[int | None, int, list[int]]] = {}
        if state.exists:
            names, lasts, nths, held, flat = state.get
            upto = 0
            for name, last, nth, many in zip(names, lasts, nths, held):
                known[name] = last, nth, flat[upto : upto + many]
                upto += many
        for pdf in () if state.hasTimedOut else rows:
            for name, us in zip(pdf["name"].tolist(), pdf["us"].tolist()):
                if name not in known:
                    known[name] = None, -1, []
                known[name][2].append(us)
        until, painted = state.getCurrentWatermarkMs() * 1000, []
        for name, (last, nth, waiting) in known.items():
            waiting.sort()
            # what the watermark has passed is taken: what comes later lies after it
            passed = bisect_right(waiting, until)
            for us in waiting[:passed]:
                if last is None or us - last >= gap:
                    last, nth = us, nth + 1
                    painted.append((name, nth, us))
            known[name] = last, nth, waiting[passed:]
        left = list(known.values())
        state.update((list(known), [x[0] for x in left], [x[1] for x in left], [len(x[2]) for x in left], [us for x in left for us in x[2]]))
        earliest = min((x[2][0] for x in left if x[2]), default=None)
        if earliest is not None:
            state.setTimeoutTimestamp(-(-earliest // 1000))
        if painted:
            yield pd.DataFrame(painted, columns=["name", "nth", "us"])

    return painting


def repaints(activity: DataFrame, gap_micros: int, late: str) -> DataFrame:
    """conversation_id, nth, us of each paint, from a stream of activity (conversation_id, created_at) that comes at most so late.

    A null time paints nothing. Conversations are dealt to BUCKETS by hash, and a bucket is one key of the state: a call of Python costs
    milliseconds, so one for each conversation and batch would be most of the time. A batch writes the state of the buckets that it meets.
    """
    kind = dict(activity.dtypes)["conversation_id"]
    times = activity.where("created_at IS NOT NULL").select(bucket("conversation_id"), F.col("conversation_id").cast("string").alias("name"), "created_at", F.unix_micros("created_at").alias("us")).withWatermark("created_at", late)
    painted = times.groupBy("bucket").applyInPandasWithState(
        _painting(gap_micros), "name string, nth long, us long", "names array<string>, lasts array<long>, nths array<long>, held array<int>, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return painted.select(F.col("name").cast(kind).alias("conversation_id"), "nth", "us")


def paints(painted: DataFrame) -> DataFrame:
    """How often each conversation was painted after the first time, as the batch fold counts it."""
    return painted.groupBy("conversation_id").agg(F.max("nth").alias("paints"))
