"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone.

The budget (share of all words) is dealt to sources by weight; a source stops at `epochs` times its size, and what is
over is dealt again by weight until no source is above. With sources in ascending order of cap / weight the clamped ones
are a prefix, so one cumulative pass over the source table (a row per source) finds them.

A source at r epochs gives every document floor(r) whole repetitions and one more to those at the front of a seeded
order that sum to the fractional part. That front is found without sorting a source in one task: documents fall into
buckets by the leading hash digits, a source's bucket sums (16 ** digits at most) give the bucket in which the front ends,
and only that bucket is put in order. A source may hold any part of all rows.

Edge cases: null text has size 0 and no words to take, so it is repeated like the rest; an empty mix gives no rows.
Sources are ordered by code point with null last, null being a source of its own. Documents that tie in the order (equal
hash of equal id) are taken together or split by text. Repeated rows count each. Columns are kept, and those named like a
result column are not lost: results are one struct column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, read, table

WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """sources (source, source_size) with weight, target and epochs taken, by capped water-filling."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
    cap = F.col("source_size") * F.lit(epochs)
    everything = Window.partitionBy()
    rising = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "cap": cap,
            "left": F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("source_size").over(rising), F.lit(0)) * F.lit(epochs),
            "heavy": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0)),
        }
    )
    # the level at which sources from here on would share what the clamped ones before leave
    s = s.withColumn("clamped", F.col("cap") * F.col("heavy") <= F.col("left") * F.col("weight"))
    free = F.when(~F.col("clamped"), F.struct("heavy", "left"))
    s = s.withColumn("level", F.max(free).over(everything))  # most weight is left at the first source that isn't clamped
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * F.col("level.left") / F.col("level.heavy"))
    s = s.withColumn("target", target.cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.select("source", "source_size", "weight", "target", rate.alias("epochs"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5, epochs: float = 2.0, seed: int = 7, digits: int = 3,
) -> DataFrame:
    """All rows and columns of docs plus a struct column `mix` (replaced where it exists): size, source_size, target, repetitions and taken."""
    # the hash is md5, so that SQL engines without Spark's hashes can repeat the order
    own = [F.col(f"`{c}`") for c in docs.columns]
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(
        F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), order.alias("order"),
        F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit("")).alias("tie"),
    )
    # a row per document without its text, a fraction of the input
    buckets = rows.groupBy("source", F.substring("order", 1, digits).alias("bucket"))
    buckets = table(buckets.agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    wanted = table(targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, epochs), "mix-targets")
    plan = wanted
    extra = F.col("target") - F.floor("epochs") * F.col("source_size")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    fronts = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    fronts = fronts.join(plan.select(F.col("source").alias("s"), "target", "epochs", "source_size"), F.col("source").eqNullSafe(F.col("s")))
    fronts = fronts.where((F.col("before") < extra) & (F.col("before") + F.col("bucket_size") >= extra))
    fronts = table(fronts.select("s", F.col("bucket").alias("last_bucket"), (extra - F.col("before")).alias("room")), "mix-fronts")

    # the last document before the front's end, by the nearest whole document
    edge = rows.join(fronts, F.col("source").eqNullSafe(F.col("s")) & F.substring("order", 1, digits).eqNullSafe(F.col("last_bucket")))
    upto = Window.partitionBy("s").orderBy("order", "tie").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") - F.col("size") / 2 <= F.col("room"))
    edge = edge.groupBy("s").agg(F.max(F.struct("order", "tie")).alias("end"))
    plan = plan.join(fronts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    end = F.coalesce(F.col("end"), F.struct(F.col("last_bucket").alias("order"), F.lit("").alias("tie")))
    plan = table(plan.select(F.col("source").alias("s"), "source_size", "target", "epochs", end.alias("end")), "mix-plan")
    for old in (buckets, wanted, fronts):
        drop_table(old)

    held = docs.select(F.struct(*own).alias("d"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), order.alias("order"), F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit("")).alias("tie"))
    held = held.join(plan, F.col("source").eqNullSafe(F.col("s")))
    more = F.coalesce(F.struct("order", "tie") <= F.col("end"), F.lit(False)).cast("int")
    times = (F.floor("epochs") + F.when(F.floor("epochs") < epochs, more).otherwise(0)).cast("int")
    held = held.withColumn("times", times)
    return held.select(
        *[F.col(f"d.`{c}`") for c in docs.columns if c.lower() != "mix"],
        F.struct("size", "source_size", "target", F.col("times").alias("repetitions"), (F.col("times") * F.col("size")).alias("taken")).alias("mix"),
    )


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken, without the mix column."""
    rows = mixed.where("mix.repetitions > 0")
    return rows.withColumn("mix", F.explode(F.sequence(F.lit(1), F.col("mix.repetitions")))).drop("mix")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o, coalesce(md5(text), '') AS tie FROM documents),
s AS (
  SELECT source, source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
-- clamp the sources whose share is above their cap, share out again, until none is
f AS (
  SELECT 0 AS step, source, source_size, weight, FALSE AS clamped FROM s
  UNION ALL
  SELECT step + 1, source, source_size, weight,
    clamped OR weight * (1.5 * sum(source_size) OVER () - sum(CASE WHEN clamped THEN 2 * source_size ELSE 0 END) OVER ())
      >= 2 * source_size * sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER ()
  FROM f WHERE step < (SELECT count(*) FROM s)),
t AS (
  SELECT source, source_size, CASE WHEN clamped THEN 2.0::DOUBLE * source_size
    ELSE (weight * (1.5::DOUBLE * sum(source_size) OVER () - sum(CASE WHEN clamped THEN 2 * source_size ELSE 0 END) OVER ())::DOUBLE)
      / (sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER ()) END AS target
  FROM f WHERE step = (SELECT count(*) FROM s)),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY d.source ORDER BY o, tie ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (whole + CASE WHEN whole < 2 AND target - whole * source_size > 0
    AND upto - size / 2 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
