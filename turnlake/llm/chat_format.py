"""Chat formatting by a finite-state machine over roles (DataFrame operations only).

A Template declares, per role, whether its text is learned, and which role may follow which. A
conversation's turns are folded through the machine (valid, first bad turn) and emitted as
segments: header, text, footer of each turn, each with a loss flag; only the text of a learned
role carries it. Control strings inside texts are broken by a backslash after their first
character and backslashes are doubled, so no text can hold a live control string and the original
comes back exactly. Roles are URL-encoded in the header.

Defined cases: a null text or role counts as empty; a turn without a number comes before all others; turns with the same number go by role, then
text; repeated rows are turns of their own; rows with a null conv_id are one conversation;
invalid orders are formatted too, and flagged; an empty table gives no rows; other columns are
not looked at, whatever their names. A conversation is one row of the result, and its digests run over
its turns in order, so one of very many turns is one task's; nothing is cut from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import table


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)
    #: state -> roles that may come next; each role is the state it leads to.
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    accepting: tuple[str, ...] = ("assistant",)
    #: Control strings of this and other common templates: first characters, and what follows them.
    controls: str = r"([<\[])(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"


CHAT = Template()


def escape(text: Column, t: Template = CHAT) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), t.controls, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(turns: DataFrame, t: Template = CHAT) -> DataFrame:
    """conv_id, valid, bad_turn, segments (text, loss), formatted for each conversation of turns (conv_id, turn, role, text)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, nexts in t.follows.items() for b in nexts))
    zero = F.struct(F.lit("").alias("state"), F.lit(0).alias("nth"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, x: Column) -> Column:
        fits = F.array_contains(allowed, F.concat(acc["state"], F.lit(">"), x["role"]))
        return F.struct(x["role"].alias("state"), (acc["nth"] + 1).alias("nth"), F.when(acc["bad"].isNull() & ~fits, acc["nth"]).otherwise(acc["bad"]).alias("bad"))

    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = lambda x: F.array(
        piece(F.concat(F.lit(t.start), F.url_encode(x["role"]), F.lit("\n")), F.lit(False)),
        piece(escape(x["text"], t), x["role"].isin(*t.learned)),
        piece(F.lit(f"{t.end}\n"), F.lit(False)),
    )
    run = chats.select("conv_id", F.aggregate("turns", zero, step).alias("run"), F.flatten(F.transform("turns", parts)).alias("segments"))
    return run.select(
        "conv_id",
        (F.col("run.bad").isNull() & F.col("run.state").isin(*t.accepting)).alias("valid"),
        F.col("run.bad").alias("bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(chats: DataFrame, t: Template = CHAT) -> DataFrame:
    """Adds roles and texts, parsed from formatted, and learned, the text under the loss mask."""
    quote = lambda s: "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in s)
    turn = F.lit(rf"(?s){quote(t.start)}(.*?)\n(.*?){quote(t.end)}\n")
    return chats.withColumns({
        "roles": F.transform(F.regexp_extract_all("formatted", turn, F.lit(1)), F.url_decode),
        "texts": F.transform(F.regexp_extract_all("formatted", turn, F.lit(2)), unescape),
        "learned": F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""),
    })


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    back = read_back(format_chats(turns.unionByName(extra)))
    said = F.array_join(F.zip_with("roles", "texts", lambda r, x: F.concat(r, F.lit("\n"), x, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        "valid",
        "bad_turn",
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g') AS escaped
  FROM c),
m AS (
  SELECT conv_id, role, CAST(row_number() OVER w - 1 AS INTEGER) AS nth, row_number() OVER back = 1 AS last,
         lag(role, 1, '') OVER w || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS fits
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), back AS (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC)),
v AS (SELECT conv_id, min(nth) FILTER (NOT fits) AS bad_turn, bool_or(last AND role = 'assistant') AS closed FROM m GROUP BY conv_id),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS learned,
         CAST(sum(length('<|im_start|>') + length(role) + 1 + length(escaped) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT g.conv_id, bad_turn IS NULL AND closed AS valid, bad_turn, n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars
FROM g JOIN v ON g.conv_id IS NOT DISTINCT FROM v.conv_id
"""
