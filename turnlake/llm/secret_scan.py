"""Secret scans (DataFrame operations only).

Base spans come from the patterns of KINDS, leftmost and non-overlapping within a kind. The
method adds spans: for each character class of CLASSES, candidate strings are the runs of its
characters; a window slides over a candidate while the count of every character, and with it the
sum of c * log2(c), is kept up to date by one step in and one step out, so each window's Shannon
entropy costs the same whatever its width. A candidate shorter than WINDOW characters, but of SHORT at
least, is one window, and the bits it needs shrink with the logarithm of its length, as the most it
can have do; shorter ones can't be told from words and numbers and are not candidates. Each stretch of a candidate that adjoining high-entropy
windows cover is a span, unless the stretch lacks the kinds of characters that keys have, matches
the allow list, or overlaps a base span.

Matches and characters are folded in pieces of PIECE, a candidate's with as much overlap as windows
need, so that the work grows with the text and not with its square.

Offsets are code points, end exclusive. Defined cases: a null text counts as empty and has no
spans; a null doc_id stays null; repeated rows are scanned each; an empty table gives no rows;
other columns are not looked at, whatever their names. The scan is one pass without a shuffle,
whatever the length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import table

#: kind, pattern, group that holds the value, characters the value needs at least.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs of 24 and more, as the longest run from a leftmost start is the same match
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: kind, its characters, bits of entropy a window needs, what the candidate has to hold.
CLASSES = (
    ("entropy_hex", "0-9A-Fa-f", 3.2, ("[0-9]", "[A-Fa-f]")),
    ("entropy_base64", "A-Za-z0-9+/_=-", 3.9, ("[0-9]", "[a-z]", "[A-Z]")),
)
WINDOW, SHORT = 24, 16
#: Matches, or characters, that are folded at once.
PIECE = 512
ALLOWED = (r"(?i)example|sample|dummy|placeholder|changeme", r"(.)\1{7}", r"0123456789|(?i:abcdefghij)")

_SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"
_PLACED = "array<struct<start:int,word:string,value:string>>"


def _placed(text: Column, pattern: str, group: int) -> Column:
    """Matches in order, with the code point where each starts: the text between them is what split() leaves."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("word"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        F.split(text, pattern, -1).alias("gap"),
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_PLACED).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        one = F.struct(start.alias("start"), m["word"].alias("word"), m["value"].alias("value"))
        return F.struct((start + F.coalesce(F.length(m["word"]), F.lit(0))).alias("at"), F.when(m["word"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    # each piece from its own start, then the pieces one after another
    pieces = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PIECE).cast("int")), lambda k: F.aggregate(F.slice(all_, k * PIECE + 1, PIECE), empty, step))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PLACED}>").alias("out"))

    def join(acc: Column, piece: Column) -> Column:
        moved = F.transform(piece["out"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), m["word"].alias("word"), m["value"].alias("value")))
        return F.struct((acc["at"] + piece["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    all_ = F.get(F.transform(F.array(found), lambda f: F.aggregate(pieces(f), none, join, lambda acc: F.flatten(acc["out"]))), 0)
    return F.when(text.rlike(pattern), all_).otherwise(F.array().cast(_PLACED))


def _span(start: Column, stop: Column, rank: int, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), stop.cast("int").alias("stop"), F.lit(kind).alias("kind"))


def limit(size: int, bits: float, window: int) -> float:
    """The most that the sum of c * log2(c) may be in a window of this size; a smaller one needs as large a part of the bits it can have."""
    return size * math.log2(size) * (1 - bits / math.log2(window)) + 1e-9


def _hot(word: Column, bits: float, window: int, short: int) -> Column:
    """array of struct(first, last): the stretches of characters that adjoining high-entropy windows cover."""
    size = F.least(F.length(word), F.lit(window))
    most = F.get(F.array(*(F.lit(limit(n, bits, window)) for n in range(short, window + 1))), size - short)
    clog = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    event = lambda x, d, at: F.struct(F.ascii(x).alias("code"), F.lit(d).alias("d"), at.cast("int").alias("at"))
    stretch = lambda first, last: F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))
    none = F.array().cast("array<struct<first:int,last:int>>")

    def events(chars: Column) -> Column:
        into = lambda x, i: event(x, 1, i + 1)
        return F.flatten(F.transform(chars, lambda x, i: F.when(i < size, F.array(into(x, i))).otherwise(F.array(event(F.get(chars, i - size), -1, F.lit(0)), into(x, i)))))

    # The counts are the characters of a string of 128, 'A' for none: one is replaced at each step.
    zero = F.struct(F.lit("A" * 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(0).alias("last"), none.alias("out"))

    def step(acc: Column, e: Column) -> Column:
        c = F.ascii(F.substring(acc["counts"], e["code"] + 1, F.lit(1))) - 65
        total = acc["sum"] + F.get(clog, c + e["d"]) - F.get(clog, c)
        high = (e["at"] >= size) & (total <= most)
        new = acc["first"].isNull() | (e["at"] - size > acc["last"])
        return F.struct(
            F.overlay(acc["counts"], F.char(65 + c + e["d"]), e["code"] + 1, F.lit(1)).alias("counts"),
            total.alias("sum"),
            F.when(high & new, e["at"] - size).otherwise(acc["first"]).alias("first"),
            F.when(high, e["at"]).otherwise(acc["last"]).alias("last"),
            F.when(high & new & acc["first"].isNotNull(), F.concat(acc["out"], F.array(stretch(acc["first"], acc["last"])))).otherwise(acc["out"]).alias("out"),
        )

    closed = lambda acc: F.when(acc["first"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(stretch(acc["first"], acc["last"]))))
    fold = lambda ev: F.aggregate(ev, zero, step, closed)

    def piece(chars: Column, start: Column) -> Column:
        """The stretches of the windows that start in the PIECE characters from start on."""
        part = F.get(F.transform(F.array(F.slice(chars, start + 1, PIECE + window - 1)), lambda x: fold(events(x))), 0)
        return F.transform(part, lambda x: stretch(x["first"] + start, x["last"] + start))

    def join(acc: Column, x: Column) -> Column:
        new = acc["first"].isNull() | (x["first"] > acc["last"])
        grown = F.when(new & acc["first"].isNotNull(), F.concat(acc["out"], F.array(stretch(acc["first"], acc["last"])))).otherwise(acc["out"])
        return F.struct(F.when(new, x["first"]).otherwise(acc["first"]).alias("first"), x["last"].alias("last"), grown.alias("out"))

    def pieces(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(chars) - size, F.lit(PIECE))
        begin = F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), none.alias("out"))
        return F.aggregate(F.flatten(F.transform(starts, lambda s: piece(chars, s))), begin, join, closed)

    return F.get(F.transform(F.array(F.split(word, "")), pieces), 0)


def scan_secrets(docs: DataFrame, window: int = WINDOW, allowed: Sequence[str] = ALLOWED, short: int = SHORT) -> DataFrame:
    """doc_id, base and added (arrays of start, rank, stop, kind, in that order) for each row of docs (doc_id, text)."""
    text = F.col("text")
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        *(_placed(text, p, g).alias(k) for k, p, g, _ in KINDS),
        *(_placed(text, f"[{chars}]{{{short},}}", 0).alias(k) for k, chars, _, _ in CLASSES),
    )

    def kept(rank: int, kind: str, least: int) -> Column:
        return F.transform(F.filter(kind, lambda m: F.length(m["value"]) >= least), lambda m: _span(m["start"], m["start"] + F.length(m["word"]), rank, kind))

    base = [kept(r, k, least) for r, (k, _, _, least) in enumerate(KINDS)]
    based = placed.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), *(k for k, *_ in CLASSES))

    def added(r: int, kind: str, bits: float, needs: Sequence[str]) -> Column:
        def likely(word: Column, *other: str) -> Column:
            ok = F.lit(True)
            for p in needs:
                ok = ok & word.rlike(p)
            for p in other:
                ok = ok & ~word.rlike(p)
            return ok

        hot = F.transform(F.filter(kind, lambda m: likely(m["word"])), lambda m: F.transform(_hot(m["word"], bits, window, short), lambda x: F.struct(
            (m["start"] + x["first"]).alias("start"), (m["start"] + x["last"]).alias("stop"), F.substring(m["word"], x["first"] + 1, x["last"] - x["first"]).alias("word"))))
        kept = F.filter(F.flatten(hot), lambda x: likely(x["word"], *allowed) & ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
        return F.transform(kept, lambda x: _span(x["start"], x["stop"], r, kind))

    more = [added(len(KINDS) + i, kind, bits, needs) for i, (kind, _, bits, needs) in enumerate(CLASSES)]
    return based.select("doc_id", "base", F.array_sort(F.concat(*more)).cast(_SPAN).alias("added"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k, *_ in KINDS),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


_DUCK = (*KINDS, *((k, f"[{c}]{{{SHORT},}}", 0, 0) for k, c, _, _ in CLASSES))
_quoted = lambda p: "'" + p.replace("'", "''") + "'"
_hits = " UNION ALL ".join(
    f"SELECT row, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, {_quoted(p)}, 0) AS words, regexp_extract_all(t, {_quoted(p)}, {g}) AS vals, regexp_split_to_array(t, {_quoted(p)}) AS gaps, {least} AS least FROM d WHERE regexp_matches(t, {_quoted(p)})"
    for rank, (kind, p, g, least) in enumerate(_DUCK)
)
_needs = lambda word: "CASE kind " + " ".join(f"WHEN '{k}' THEN " + " AND ".join(f"regexp_matches({word}, {_quoted(p)})" for p in needs) for k, _, _, needs in CLASSES) + " END"
#: RE2 has no back-references: a character eight times in a row is found by comparing neighbours.
_allowed = "regexp_matches(word, {}) OR regexp_matches(word, {}) OR len(list_filter(range(1, length(word) - 6), lambda i: substring(word, i, 8) = repeat(substring(word, i, 1), 8))) > 0".format(_quoted(ALLOWED[0]), _quoted(ALLOWED[2]))
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
h AS (SELECT row, rank, kind, least, unnest(range(1, len(words) + 1)) AS i, words, vals, gaps FROM ({_hits})),
p AS (
  SELECT row, rank, kind, least, words[i] AS word, vals[i] AS value,
         CAST(sum(length(gaps[i]) + CASE WHEN i > 1 THEN length(words[i - 1]) ELSE 0 END) OVER (PARTITION BY row, rank ORDER BY i) AS BIGINT) AS start
  FROM h),
b AS (SELECT row, rank, kind, start, start + length(word) AS stop FROM p WHERE rank < {len(KINDS)} AND length(value) >= least),
w AS (
  SELECT row, rank, kind, word, start, s, size, string_split(substring(word, s + 1, size), '') AS cs
  FROM (SELECT *, unnest(range(length(word) - size + 1)) AS s FROM (SELECT *, least(length(word), {WINDOW}) AS size FROM p WHERE rank >= {len(KINDS)} AND ({_needs("word")})))),
e AS (
  SELECT * FROM w
  WHERE list_sum(list_transform(list_distinct(cs), lambda c: len(list_filter(cs, lambda x: x = c)) * log2(len(list_filter(cs, lambda x: x = c)))))
        <= size * log2(size) * (1 - CASE kind {" ".join(f"WHEN '{k}' THEN {bits}" for k, _, bits, _ in CLASSES)} END / log2({WINDOW})) + 1e-9),
g AS (SELECT *, s - lag(s, 1, s - size - 1) OVER (PARTITION BY row, rank, start ORDER BY s) > size AS new FROM e),
n AS (SELECT *, sum(new::INT) OVER (PARTITION BY row, rank, start ORDER BY s) AS nth FROM g),
x AS (SELECT row, rank, kind, start + min(s) AS start, start + max(s) + any_value(size) AS stop, substring(any_value(word), min(s) + 1, max(s) - min(s) + any_value(size)) AS word FROM n GROUP BY row, rank, kind, n.start, nth),
a AS (
  SELECT row, rank, kind, start, stop FROM x
  WHERE ({_needs("word")}) AND NOT ({_allowed}) AND NOT EXISTS (SELECT 1 FROM b WHERE b.row = x.row AND b.start < x.stop AND x.start < b.stop)),
l AS (SELECT row, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM (SELECT * FROM b UNION ALL SELECT * FROM a) GROUP BY row),
k AS (
  SELECT row, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in KINDS)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM b GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in KINDS)}, sha256(coalesce(k.spans, '')) AS base_sha256, coalesce(l.spans, '') AS spans
FROM d LEFT JOIN k USING (row) LEFT JOIN l USING (row)
"""
