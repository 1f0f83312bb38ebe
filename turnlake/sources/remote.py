"""Replies of remote model servers: one request row becomes the lines of its event stream, or one row with an error."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = "request long, line_no int, line string, error string, status int"


def requests(contexts: DataFrame, profiles: DataFrame, max_tokens: int, temperature: float) -> DataFrame:
    """What is sent for each context (request, model_profile, context: a JSON list of messages): its address and body."""
    by = profiles.select(F.col("key").alias("model_profile"), "base_url", "model")
    body = F.concat(
        F.lit('{"model":'), F.to_json(F.array("model")).substr(F.lit(2), F.length(F.to_json(F.array("model"))) - 2), F.lit(',"messages":'), "context",
        F.lit(f',"max_tokens":{max_tokens},"temperature":{temperature},"stream":true}}'),
    )
    return contexts.join(F.broadcast(by), "model_profile").select("request", F.concat("base_url", F.lit("/chat/completions")).alias("url"), body.alias("body"))


def streamed(asked: DataFrame, api_key: str, timeout: float) -> DataFrame:
    """The lines that came for each of the requests (request, url, body), and how it failed: connection, timeout or status.

    Requests run beside one another, one in each task at a time; connections are closed on every path. A
    retried task asks again.
    """

    def lines(request: int, url: str, body: str) -> Iterator[tuple]:
        call = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"})
        n = 0
        try:
            with urllib.request.urlopen(call, timeout=timeout) as reply:
                for raw in reply:
                    yield request, n, raw.decode("utf-8", "replace").rstrip("\r\n"), None, None
                    n += 1
        except urllib.error.HTTPError as e:
            e.close()
            yield request, n, None, "status", e.code
        except TimeoutError:
            yield request, n, None, "timeout", None
        except (urllib.error.URLError, ConnectionError) as e:
            yield request, n, None, "timeout" if isinstance(getattr(e, "reason", None), TimeoutError) else "connection", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32())
        for batch in batches:
            for r in batch.to_pylist():
                rows = list(lines(r["request"], r["url"], r["body"]))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=["request", "line_no", "line", "error", "status"])

    return asked.select("request", "url", "body").mapInArrow(run, LINES)
