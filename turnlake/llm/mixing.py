"""Mixing sources to target weights by a time-varying curriculum (DataFrame operations only).

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of
all sources; no target passes LIMIT times its source's size, and the excess goes to the others by
weight. Over sources sorted by cap / weight the capped ones are a prefix, so one running sum over
the per-source totals finds the level, without a loop.

Positions: training runs over t in [0, 1]. Source k asks for words at the rate
target * (1 + slope_k * (2t - 1)), slope_k cycling through SLOPES; its integral, the cumulative
demand, is target * (t + slope_k * (t * t - t)). A document that starts at the c-th word of its
source's supply is trained on where the cumulative demand reaches c: the quadratic is inverted
in closed form, and documents are range-sorted by that position. Supply goes on over the passes:
in pass k (from 0) the document starts k * source_size words later, and each pass of a document
has a position of its own.

Supply: documents of a source in the order of a digest of doc_id and text, whole passes first; the document in which
the target falls gives only the words up to it, so a source takes exactly its rounded target. The
running sum is taken within hash slices of a source plus the totals of the slices before, so a
source that holds most rows, or rows without an id, are spread over many tasks. What the plan needs
of a text is written once, as its size and digest.

The training order is a range sort: every reading of a document gets its rank from RANGES ranges of
the position, numbered by themselves and moved up by the counts of those before.

Defined cases: a null text has 0 words and takes none; a null doc_id counts as ''; a text of any length is counted whole; a null source
is a source of its own; repeated rows each count; a table without words takes nothing; an empty
table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.common import checkpointed, numbered, table

LIMIT = 3
WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)
#: Hex digits of the digest that name a slice.
SLICE_DIGITS = 3
#: Ranges of the position that are numbered by themselves.
RANGES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _targets(totals: DataFrame) -> DataFrame:
    """From src, source_size: src, source_size, target, slope. One row a source."""
    everything = Window.orderBy("missing", "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(Window.orderBy("missing", "src")) - 1) % len(WEIGHTS)
    ranked = totals.withColumn("turn", turn).withColumn("total", F.sum("source_size").over(everything))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("turn") + 1)).withColumn("cap", LIMIT * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "missing", "src")
    upto, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0))).cast("double") / F.sum("weight").over(rest).cast("double")
    level = ranked.withColumn("level", level)
    free = level.withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
    found = free.withColumn("at", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight")))
    return found.select("src", "missing", "source_size", target.alias("target"), F.element_at(F.array(*map(F.lit, SLOPES)), F.col("turn") + 1).alias("slope"))


def mix(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, position, start, slope for each row of docs.

    position: where in training, from 0 to 1, the first words of the row's first pass come; null if
    none are taken. start: words of the source before the row. carry: further columns of docs to return.
    """
    rows = docs.select(
        *carry,
        "doc_id",
        "source",
        F.coalesce("source", F.lit("")).alias("src"),
        F.col("source").isNull().alias("missing"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")).alias("key"),
    ).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    if not carry:  # a few numbers a row: the texts are read once
        rows = checkpointed(rows)
    by = ["missing", "src", "slice"]
    sums = rows.groupBy(*by).agg(F.sum("size").alias("slice_size"))
    targets = _targets(sums.groupBy("missing", "src").agg(F.sum("slice_size").alias("source_size")))
    before = sums.select(*by, (F.sum("slice_size").over(Window.partitionBy("missing", "src").orderBy("slice")) - F.col("slice_size")).alias("before"))
    plan = before.join(targets, ["missing", "src"])
    within = rows.withColumn("upto", F.sum("size").over(Window.partitionBy(*by).orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = within.join(plan, by)
    start = F.col("before") + F.col("upto") - F.col("size")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    left = budget - passes * F.col("source_size")
    taken = F.col("size") * passes + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - start))
    position = F.when(taken > 0, _position(start, F.col("target"), F.col("slope")))
    return joined.select(*carry, "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), position.alias("position"), start.alias("start"), "slope")


def _position(start: Column, target: Column, s: Column) -> Column:
    """The t where t + s (t^2 - t) = start / target."""
    share = F.least(F.lit(1.0), start / target)
    root = (s - 1 + F.sqrt((1 - s) * (1 - s) + 4 * s * share)) / (2 * s)
    return F.when(s == 0, share).otherwise(root)


def passes(mixed: DataFrame) -> DataFrame:
    """From what mix() returns one row for each pass over a document that takes words of it.

    pass counts from 0; taken is what this pass takes, total what all do, position where it begins.
    """
    size, nth = F.col("size"), F.col("pass")
    drawn = mixed.where("taken > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / size).cast("int") - 1)))
    position = _position(nth * F.col("source_size") + F.col("start"), F.col("target"), F.col("slope"))
    return drawn.withColumns({"position": position, "total": F.col("taken"), "taken": F.least(size, F.col("taken") - nth * size)})


def in_training_order(drawn: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows that passes() drew, range-sorted by position."""
    n = partitions or int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("position"), F.col("doc_id")]
    return drawn.where("taken > 0").repartitionByRange(n, *order).sortWithinPartitions(*order)


def ranked(drawn: DataFrame) -> DataFrame:
    """The rows that passes() drew with training_rank, from 0, in the order of position."""
    ranges = F.least(F.floor(F.col("position") * RANGES), F.lit(RANGES - 1)).cast("int")
    placed = numbered(drawn.withColumns({"all": F.lit(0), "range": ranges}), ["all"], "range", [F.col("position"), F.col("doc_id"), F.col("pass")])
    return placed.withColumnRenamed("nth", "training_rank").drop("all", "range")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: in the order in which training first reads them, those it never reads last.

    position and training_rank are those of the first reading, among all readings; n_passes counts them.
    """
    mixed = mix(table(spark, sf_dir, "documents"))
    told = ["doc_id", "size", "source_size", "target"]
    read = ranked(passes(mixed)).where("pass = 0").select(*told, F.col("total").alias("taken"), F.ceil(F.col("total") / F.col("size")).cast("long").alias("n_passes"), "position", "training_rank")
    unread = mixed.where("taken = 0").select(*told, "taken", F.lit(0).cast("long").alias("n_passes"), F.lit(None).cast("double").alias("position"), F.lit(None).cast("long").alias("training_rank"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("training_rank").asc_nulls_last(), F.col("doc_id")]
    return read.unionByName(unread).repartitionByRange(n, *order).sortWithinPartitions(*order)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS missing, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT missing, src, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY missing, src) - 1) % 3 AS weight,
         CAST([-0.5, 0.0, 0.5][1 + (row_number() OVER (ORDER BY missing, src) - 1) % 3] AS DOUBLE) AS slope
  FROM d GROUP BY missing, src),
c AS (SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
l AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER before, 0) AS DOUBLE) / CAST(sum(weight) OVER rest AS DOUBLE) AS level,
         row_number() OVER ordered AS nth
  FROM c
  WINDOW ordered AS (ORDER BY cap / weight, missing, src),
         before AS (ORDER BY cap / weight, missing, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY cap / weight, missing, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (
  SELECT missing, src, source_size, slope,
         CASE WHEN found IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), found * weight) END AS target
  FROM l, (SELECT arg_min(level, nth) FILTER (level * weight < cap) AS found FROM l)),
r AS (
  SELECT doc_id, size, source_size, target, slope, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CAST(sum(size) OVER (PARTITION BY missing, src ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM d JOIN t USING (missing, src)),
m AS (
  SELECT *, row_number() OVER () AS row,
         CAST(size * CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END
              + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - start)) AS BIGINT) AS taken
  FROM r),
p AS (
  SELECT row, doc_id, pass, slope, least(1.0::DOUBLE, CAST(pass * source_size + start AS DOUBLE) / target) AS share
  FROM (SELECT *, unnest(range((taken + size - 1) // size)) AS pass FROM m WHERE taken > 0)),
q AS (
  SELECT *, CASE WHEN slope = 0 THEN share
            ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) / (2 * slope) END AS position
  FROM p),
o AS (SELECT row, pass, position, row_number() OVER (ORDER BY position, doc_id, pass) - 1 AS training_rank FROM q)
SELECT doc_id, size, source_size, target, taken, CAST(CASE WHEN taken > 0 THEN (taken + size - 1) // size ELSE 0 END AS BIGINT) AS n_passes, position, training_rank
FROM m LEFT JOIN o ON o.row = m.row AND pass = 0
"""
