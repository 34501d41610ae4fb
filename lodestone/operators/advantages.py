"""Group-relative statistics of scores: windows over the results of one prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-6


def group_relative(score: Column, group: WindowSpec) -> Column:
    """(score - mean) / (sample deviation + eps); a single result has mean 0 and deviation 1."""
    single = F.count(F.lit(1)).over(group) == 1
    return F.when(single, score / (1 + EPS)).otherwise((score - F.avg(score).over(group)) / (F.stddev_samp(score).over(group) + EPS))


def pass_at_k(score: Column, group: WindowSpec, tie: str) -> Column:
    """Only the best result gets its lead over the second, by the deviation; 0 for the others and for single results."""
    ranked = group.orderBy(score.desc(), F.col(tie))
    lead = (score - F.lead(score).over(ranked)) / (F.stddev_samp(score).over(group) + EPS)
    return F.when((F.count(F.lit(1)).over(group) < 2) | (F.row_number().over(ranked) > 1), 0.0).otherwise(lead)


def mean_baseline(score: Column, group: WindowSpec) -> Column:
    """score - mean; a single result keeps its score."""
    return F.when(F.count(F.lit(1)).over(group) == 1, score).otherwise(score - F.avg(score).over(group))


def leave_one_out(score: Column, group: WindowSpec) -> Column:
    """score - mean of the others; a single result keeps its score."""
    n = F.count(F.lit(1)).over(group)
    return F.when(n == 1, score).otherwise((score - F.avg(score).over(group)) * n / (n - 1))


def length_weighted(score: Column, length: Column, group: WindowSpec) -> Column:
    """score - mean weighted by lengths; a single result keeps its score."""
    base = F.coalesce(F.try_divide(F.sum(score * length).over(group), F.sum(length.cast("double")).over(group)), F.lit(0.0))
    return F.when(F.count(F.lit(1)).over(group) == 1, score).otherwise(score - base)


def _series(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """One array a key, latest first."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in fields if c not in order])), asc=False).alias("__x"))


def generalised_advantage(rows: DataFrame, key: str, order: list[str], id_col: str, value: str, reward: float, gamma: float, lam: float) -> DataFrame:
    """(id, advantage): A = delta + gamma lambda A' with delta = reward + gamma V' - V, folded over a key's steps, latest first.

    The steps of one trajectory are one task's work, as in any recursion over them."""
    step = lambda acc, x: F.struct(
        x[value].alias("v"),
        (F.lit(reward) + gamma * acc["v"] - x[value] + gamma * lam * acc["a"]).alias("a"),
        F.concat(acc["out"], F.array(F.struct(x[id_col].alias("id"), (F.lit(reward) + gamma * acc["v"] - x[value] + gamma * lam * acc["a"]).alias("a")))).alias("out"),
    )
    kind = rows.schema[id_col].dataType.simpleString()
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("a"), F.array().cast(f"array<struct<id:{kind},a:double>>").alias("out"))
    folded = _series(rows, key, order, [id_col, value]).select(F.explode(F.aggregate("__x", zero, step, lambda acc: acc["out"])).alias("o"))
    return folded.select(F.col("o.id").alias(id_col), F.col("o.a").alias("advantage"))


def discounted_return(rows: DataFrame, key: str, order: list[str], id_col: str, value: str, mask: str, gamma: float) -> DataFrame:
    """(id, total): reverse discounted sums of values, starting anew where the mask is 0."""
    run = lambda acc, x: x[value] + gamma * acc["r"] * x[mask]
    step = lambda acc, x: F.struct(run(acc, x).alias("r"), F.concat(acc["out"], F.array(F.struct(x[id_col].alias("id"), run(acc, x).alias("r")))).alias("out"))
    kind = rows.schema[id_col].dataType.simpleString()
    zero = F.struct(F.lit(0.0).alias("r"), F.array().cast(f"array<struct<id:{kind},r:double>>").alias("out"))
    folded = _series(rows, key, order, [id_col, value, mask]).select(F.explode(F.aggregate("__x", zero, step, lambda acc: acc["out"])).alias("o"))
    return folded.select(F.col("o.id").alias(id_col), F.round("o.r", 6).alias("total"))


def divergence(d: Column) -> tuple[Column, Column, Column, Column]:
    """Estimates of a divergence from log ratios: d, |d|, d²/2 and exp(-d) + d - 1 with clamps of 20 and 10."""
    bounded = F.greatest(F.least(-d, F.lit(20.0)), F.lit(-20.0))
    k3 = F.greatest(F.least(F.exp(bounded) + d - 1, F.lit(10.0)), F.lit(-10.0))
    return d, F.abs(d), 0.5 * d * d, k3


def clipped_loss(advantage: Column, ratio: Column, clip: float) -> Column:
    """The larger of the plain and the clipped policy loss."""
    bounded = F.greatest(F.least(ratio, F.lit(1 + clip)), F.lit(1 - clip))
    return F.greatest(-advantage * ratio, -advantage * bounded)
