"""Overlapping and gapped intervals: continuous periods and the gaps between them.

Two levels, so that one entity may own any share of the rows.  An interval is clipped at the borders of time shards: its
first and last shard get a piece each, and the shards it covers whole in between become one *run* (of the runs that start at
a shard only the longest is kept), however long it is.  Pieces merge locally within (entity, shard).  What is left for a
window over the whole entity is one summary row per shard.  It carries how far earlier shards reach, and the stitched
coverage gives each period's true start; the end of a period is the reach just before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import checkpointed

#: Width of a time shard in the unit of the bounds: ten minutes of milliseconds. It bounds a task by the segments that start
#: in ten minutes of one entity, not by the entity.
SHARD = 600_000


def milliseconds(seconds: str | Column) -> Column:
    """Seconds as whole milliseconds, half away from zero; null for null, NaN and infinite times."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(9.0e15))
    return F.when(finite, F.round(s * F.lit(1000.0)).cast("long"))


def merge_intervals(rows: DataFrame, keys: list[str], start: str, end: str, shard: int = SHARD) -> DataFrame:
    """Continuous periods and gaps of whole-numbered intervals: (keys, kind, start, end).

    kind ``period``: the longest stretches covered without interruption; intervals that touch belong together; a single
    interval is a period. kind ``gap``: what lies between two consecutive periods of the same keys.
    Rows with a null bound, or whose end isn't after their start, do not count; null keys form an entity of their own;
    repeated rows change nothing; an empty input gives no rows. Other columns are dropped, so their names cannot clash.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    s, e, n = F.col("__s"), F.col("__e"), F.lit(shard).cast("long")
    base = rows.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e")).filter(e > s)
    first, last = F.expr(f"(__s - pmod(__s, {shard}L)) div {shard}L"), F.expr(f"(__e - 1 - pmod(__e - 1, {shard}L)) div {shard}L")
    head = F.struct(first.alias("b"), s.alias("s"), F.least(e, (first + 1) * n).alias("e"), F.lit(None).cast("long").alias("run"))
    tail = F.struct(last.alias("b"), (last * n).alias("s"), e.alias("e"), F.lit(None).cast("long").alias("run"))
    run = F.struct((first + 1).alias("b"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"), (last * n).alias("run"))
    parts = F.when(last == first, F.array(head)).when(last == first + 1, F.array(head, tail)).otherwise(F.array(head, run, tail))
    pieces = base.select(*k, F.explode(parts).alias("p")).select(*k, "p.*")

    shard_rows = Window.partitionBy(*k, "b").orderBy(F.col("s").asc_nulls_first(), F.col("e"))
    before = shard_rows.rowsBetween(Window.unboundedPreceding, -1)
    local = (
        pieces.withColumn("reach", F.max("e").over(before))
        .withColumn("new", F.col("s").isNotNull() & (F.col("reach").isNull() | (F.col("s") > F.col("reach"))))
        .withColumn("island", F.sum(F.col("new").cast("long")).over(shard_rows.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*k, "b", "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("run").alias("run"))
    )
    # the local stretches are read four times below; the written table also cuts the lineage
    local = checkpointed(local)
    # island 0 holds the runs that start at this shard; the others are disjoint stretches of it
    summary = local.groupBy(*k, "b").agg(F.max(F.greatest(F.coalesce("e", "run"), F.coalesce("run", "e"))).alias("far"))
    by_entity = Window.partitionBy(*k).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("carry", F.max("far").over(by_entity)).select(*[F.col(c).alias(f"{c}_") for c in k], F.col("b").alias("b_"), "carry")

    same = F.col("b") == F.col("b_")
    for c in k:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    stitched = local.join(carried, same).drop(*[f"{c}_" for c in k], "b_")
    in_shard = Window.partitionBy(*k, "b").orderBy("island")
    so_far = F.max(F.coalesce("e", "run")).over(in_shard.rowsBetween(Window.unboundedPreceding, -1))
    # a piece begins a period if nothing before it, in its shard or in earlier ones, reaches it
    begins = (
        stitched.withColumn("reach", F.greatest(so_far, F.col("carry")))
        .withColumn("from", F.coalesce(F.col("s"), F.col("b") * n))
        .filter(F.col("reach").isNull() | (F.col("from") > F.col("reach")))
    )
    # the end of a period is the reach before the next one, in this shard or a later one, else the entity's furthest reach
    firsts = begins.groupBy(*k, "b").agg(F.min_by("reach", "from").alias("reach"))
    ends = (
        summary.join(firsts.select(*[F.col(c).alias(f"{c}_") for c in k], F.col("b").alias("b_"), F.col("reach").alias("first_reach")), same, "left")
        .drop(*[f"{c}_" for c in k], "b_")
        .withColumn("later", F.first("first_reach", ignorenulls=True).over(Window.partitionBy(*k).orderBy("b").rowsBetween(1, Window.unboundedFollowing)))
        .withColumn("furthest", F.max("far").over(Window.partitionBy(*k)))
        .select(*[F.col(c).alias(f"{c}_") for c in k], F.col("b").alias("b_"), F.coalesce("later", "furthest").alias("last_end"))
    )
    periods = begins.join(ends, same).drop(*[f"{c}_" for c in k], "b_").withColumn("to", F.coalesce(F.lead("reach").over(in_shard), F.col("last_end")))
    out = periods.select(
        *k,
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("from").alias("s"), F.col("to").alias("e")),
                    F.when(F.col("reach").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("reach").alias("s"), F.col("from").alias("e"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("o"),
    )
    return out.select(*[F.col(a).alias(c) for c, a in zip(keys, k)], F.col("o.kind").alias("kind"), F.col("o.s").alias(start), F.col("o.e").alias(end))


def speaker_periods(segments: DataFrame, shard: int = SHARD) -> DataFrame:
    """Periods and gaps of each (conv_id, speaker) in whole milliseconds: (conv_id, speaker, kind, start_ms, end_ms)."""
    rows = segments.select("conv_id", "speaker", milliseconds("start_time").alias("start_ms"), milliseconds("end_time").alias("end_ms"))
    return merge_intervals(rows, ["conv_id", "speaker"], "start_ms", "end_ms", shard)
