"""Benchmark decontamination with an Aho-Corasick automaton.

Texts and benchmark items are normalised alike: A-Z lower-cased, words of digits, letters and
non-ASCII characters, one space between. Every window of WINDOW consecutive item words (an item
of fewer words is one window) is a pattern of one automaton; a text is scanned once, and every
occurrence is found, overlapping ones too. Hit words are mapped back to code points of the
original text.

An automaton holds MOST pattern characters (about 250 MB); items are cut wherever one is full. A
benchmark with more of them streams through the driver in several, each broadcast; a task then
gathers SWEEP characters of text and works them through one automaton after another, so memory
stays bounded and each is built once a sweep. (Words as letters would make patterns a sixth as
long, but the automaton looks its children up one by one, and the root would have thousands:
measured on sf0.1 that took twice as long.)

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no
window; equal items all count; a null item_id counts as ''; repeated rows are judged each; a text or
item of any length is worked on whole; empty tables give no rows or no hits; other columns pass
through, but one with the name of a result gives way to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import table

WINDOW = 13
MOST, SWEEP = 4_000_000, 32 << 20
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def _spaced(text: str | None) -> tuple[bytes, list[bytes]]:
    flat = (text or "").encode().translate(_TABLE)
    return flat, flat.split()


def _pattern(words: list[bytes]) -> str:
    return f" {b' '.join(words).decode('latin-1')} "


def windows(bench: DataFrame, size: int = WINDOW, most: int = MOST) -> Iterator[dict[str, list[str]]]:
    """The windows of all items and the items that hold each, so many characters of them in a block."""
    block: dict[str, list[str]] = {}
    chars = 0
    for r in bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").toLocalIterator():
        words = _spaced(r.text)[1]
        for i in range(max(1, len(words) - size + 1) if words else 0):
            if chars >= most:
                yield block
                block, chars = {}, 0
            w = _pattern(words[i : i + size])
            items = block.setdefault(w, [])
            chars += 0 if items else len(w)
            if not items or items[-1] != r.item_id:
                items.append(r.item_id)
    if block:
        yield block


def automaton(block: dict[str, list[str]]):
    a = ahocorasick.Automaton()
    for w, items in block.items():
        a.add_word(w, (w.count(" ") - 1, len(w), items))
    a.make_automaton()
    return a


def occurrences(words: list[bytes], a) -> list[tuple[int, int, list[str]]]:
    """First word, word after the last, items of each occurrence."""
    plain = _pattern(words)
    found = list(a.iter(plain))
    if not found:
        return []
    gaps = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), np.uint8) == 32)
    first = np.searchsorted(gaps, [end - length + 1 for end, (_, length, _) in found]).tolist()
    return [(i, i + n, items) for i, (_, (n, _, items)) in zip(first, found)]


def judged(text: str | None, found: list[tuple[int, int, list[str]]]) -> tuple[int, int, list[str], list[dict]]:
    """Words, hit words, items and spans (start, stop: code points) of a text with these occurrences."""
    flat, words = _spaced(text)
    edge, items = np.zeros(len(words) + 1, np.int64), set()
    for first, stop, own in found:
        edge[first] += 1
        edge[stop] -= 1
        items.update(own)
    hit = np.cumsum(edge[:-1]) > 0
    spans, body, at, point = [], (text or "").encode(), 0, 0
    starts = np.flatnonzero((np.frombuffer(b" " + flat, np.uint8)[:-1] == 32) & (np.frombuffer(flat, np.uint8) != 32))
    turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for i, j in turn.reshape(-1, 2):
        begin, stop = int(starts[i]), int(starts[j - 1]) + len(words[j - 1])
        first = point + len(body[at:begin].decode())
        point = first + len(body[begin:stop].decode())
        at = stop
        spans.append({"start": first, "stop": point})
    return len(words), int(hit.sum()), sorted(items), spans


FOUND = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
_FOUND_DDL = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>"
_built: dict[tuple[str, int], object] = {}  # in a Python worker: the automaton at hand


def find_contamination(docs: DataFrame, bench: DataFrame, size: int = WINDOW, most: int = MOST, sweep: int = SWEEP) -> DataFrame:
    """The columns of docs without the text, and n_words, n_hit, items, spans for each row."""
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(b) for b in windows(bench, size, most)]
    keep = [c for c in docs.columns if c.lower() not in ("text", *FOUND.names)]
    name = uuid.uuid4().hex

    def automata():
        for k, b in enumerate(sent):
            if (name, k) not in _built:
                _built.clear()
                _built[name, k] = automaton(b.value)
            yield _built[name, k]

    def worked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [b.column(b.schema.get_field_index("text")) for b in held]
        count = [np.zeros(len(col), np.int64) for col in cols]
        found: list[dict[int, list]] = [{} for _ in cols]  # of the rows that have any
        for k, a in enumerate(automata() if sent else [None]):
            for col, n, hits in zip(cols, count, found):
                for i, t in enumerate(col):
                    words = _spaced(t.as_py())[1]
                    if not k:
                        n[i] = len(words)
                    if a and words and (own := occurrences(words, a)):
                        hits.setdefault(i, []).extend(own)
        for batch, col, n, hits in zip(held, cols, count, found):
            rows = [judged(col[i].as_py(), hits[i]) if i in hits else (int(n[i]), 0, [], []) for i in range(len(col))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array([r[i] for r in rows], FOUND.field(i).type) for i in range(4)], names=[*keep, *FOUND.names]
            )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        chars = 0
        for batch in batches:
            held.append(batch)
            chars += batch.column(batch.schema.get_field_index("text")).nbytes
            if len(sent) <= 1 or chars >= sweep:
                yield from worked(held)
                held, chars = [], 0
        yield from worked(held)

    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), _FOUND_DDL])
    return docs.select(*(F.col(f"`{c}`") for c in [*keep, "text"])).mapInArrow(scan, ddl)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",").alias("spans"),
    )


SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
  FROM benchmark WHERE text IS NOT NULL),
w AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS k, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
  FROM documents),
h AS (
  SELECT doc_id, i, k, item_id
  FROM (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS w
        FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w) WHERE len(ws) >= k)) JOIN w USING (k, w)),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h),
n AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY doc_id),
a AS (
  SELECT doc_id, p, sum(len(gap) + len(w)) OVER (PARTITION BY doc_id ORDER BY p) AS stop, len(w) AS size
  FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w, unnest(regexp_split_to_array(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')[1:len(ws)]) AS gap
        FROM d WHERE doc_id IN (SELECT doc_id FROM p))),
s AS (
  SELECT doc_id, string_agg(first || ':' || last, ',' ORDER BY first) AS spans
  FROM (SELECT doc_id, CAST(min(stop - size) AS BIGINT) AS first, CAST(max(stop) AS BIGINT) AS last
        FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM p JOIN a USING (doc_id, p)) GROUP BY doc_id, run) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), FALSE) AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)
"""
