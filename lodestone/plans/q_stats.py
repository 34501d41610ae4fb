"""Queries of aggregations and group statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import token_estimate
from lodestone.plans.registry import query
from lodestone.session import checkpointed, table

CHUNK_N = "(SELECT instance_id, count(*) AS n FROM chunks GROUP BY instance_id)"
#: Resamples of the bootstrap, and the distribution of Poisson(1) weights as far as doubles tell it from 1.
DRAWS, POISSON = 1000, np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
_OK = "score IS NOT NULL AND NOT isnan(score)"


def r6(c: Column) -> Column:
    return F.round(c, 6)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Results with a score."""
    return table(spark, sf, "eval_results").filter(F.col("score").isNotNull() & ~F.isnan("score"))


def upper_median(values: DataFrame, c: str) -> DataFrame:
    """The element at place n div 2 of the sorted values, found by counts of distinct values: no list of all values is made.

    Distinct values are ranked in range partitions: a partition's count before it comes from a small summary.
    """
    counts = values.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    ranked = checkpointed(counts.repartitionByRange(c).withColumn("part", F.spark_partition_id()))
    parts = ranked.groupBy("part").agg(F.sum("n").alias("in_part"), F.min(c).alias("low"))
    order = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    before = parts.select("part", F.coalesce(F.sum("in_part").over(order), F.lit(0)).alias("before"), F.sum("in_part").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    w = Window.partitionBy("part").orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
    upto = ranked.join(before, "part").withColumn("upto", F.col("before") + F.sum("n").over(w))
    return upto.filter(F.expr("upto > total div 2 AND upto - n <= total div 2")).select(F.col(c).alias("median"))


@query("AGG1_corpus_statistics", f"SELECT count(*) AS instances, round(avg(n), 6) AS mean_chunks, round(avg(num_questions), 6) AS mean_questions FROM instances JOIN {CHUNK_N} USING (instance_id)")
def agg1(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "chunks").groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "instances").join(n, "instance_id").agg(F.count(F.lit(1)).alias("instances"), r6(F.avg("n")).alias("mean_chunks"), r6(F.avg("num_questions")).alias("mean_questions"))


@query(
    "AGG2_detailed_statistics",
    "WITH t AS (SELECT length(chunk) // 4 AS k FROM chunks WHERE chunk IS NOT NULL) SELECT min(k) AS least, max(k) AS most, round(avg(k), 6) AS mean, count(*) FILTER (WHERE k > 4096) AS over_4096, count(*) FILTER (WHERE k > 1024) AS over_1024, round(100.0 * count(*) FILTER (WHERE k > 1024) / count(*), 6) AS over_1024_percent, list_sort(list(k))[count(*) // 2 + 1] AS median FROM t",
)
def agg2(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "chunks").filter("chunk IS NOT NULL").select(token_estimate("chunk").alias("k"))
    over = lambda m: F.count_if(F.col("k") > m)
    one = t.agg(F.min("k").alias("least"), F.max("k").alias("most"), r6(F.avg("k")).alias("mean"), over(4096).alias("over_4096"), over(1024).alias("over_1024"), r6(100.0 * over(1024) / F.count(F.lit(1))).alias("over_1024_percent"))
    return one.withColumn("median", upper_median(t, "k").scalar())


@query("AGG3_split_statistics", f"SELECT data_source, count(*) AS instances, sum(num_questions) AS questions, round(avg(num_questions), 6) AS mean_questions, round(avg(n), 6) AS mean_chunks FROM instances JOIN {CHUNK_N} USING (instance_id) GROUP BY data_source")
def agg3(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "chunks").groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"))
    g = table(spark, sf, "instances").join(n, "instance_id").groupBy("data_source")
    return g.agg(F.count(F.lit(1)).alias("instances"), F.sum("num_questions").alias("questions"), r6(F.avg("num_questions")).alias("mean_questions"), r6(F.avg("n")).alias("mean_chunks"))


@query("AGG4_value_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def agg4(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source", "lang")


@query("AGG5_agent_summary", f"WITH i AS (SELECT agent_name, instance_id, avg(score) AS m FROM eval_results WHERE {_OK} GROUP BY ALL) SELECT agent_name, round(avg(m), 6) AS mean, round(min(m), 6) AS least, round(max(m), 6) AS most, round(stddev_pop(m), 6) AS std FROM i GROUP BY agent_name")
def agg5(spark: SparkSession, sf: str) -> DataFrame:
    i = scored(spark, sf).groupBy("agent_name", "instance_id").agg(F.avg("score").alias("m"))
    return i.groupBy("agent_name").agg(r6(F.avg("m")).alias("mean"), r6(F.min("m")).alias("least"), r6(F.max("m")).alias("most"), r6(F.stddev_pop("m")).alias("std"))


@query("AGG6_source_summary", f"WITH a AS (SELECT data_source, agent_name, count(*) AS n, avg(score) AS m FROM eval_results WHERE {_OK} GROUP BY ALL) SELECT data_source, sum(n)::BIGINT AS n, round(avg(m), 6) AS mean, round(min(m), 6) AS least, round(max(m), 6) AS most, round(CASE WHEN count(*) > 1 THEN stddev_pop(m) ELSE 0 END, 6) AS std FROM a GROUP BY data_source")
def agg6(spark: SparkSession, sf: str) -> DataFrame:
    a = scored(spark, sf).groupBy("data_source", "agent_name").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m"))
    std = F.when(F.count(F.lit(1)) > 1, F.stddev_pop("m")).otherwise(0.0)
    return a.groupBy("data_source").agg(F.sum("n").alias("n"), r6(F.avg("m")).alias("mean"), r6(F.min("m")).alias("least"), r6(F.max("m")).alias("most"), r6(std).alias("std"))


@query("AGG7_macro_mean", f"WITH i AS (SELECT instance_id, item_index, arg_min(data_source, result_id) AS source, avg(score) AS m FROM eval_results WHERE {_OK} GROUP BY instance_id, item_index) SELECT source, round(avg(m), 6) AS score, count(*) AS items FROM i GROUP BY source")
def agg7(spark: SparkSession, sf: str) -> DataFrame:
    i = scored(spark, sf).groupBy("instance_id", "item_index").agg(F.min_by("data_source", "result_id").alias("source"), F.avg("score").alias("m"))
    return i.groupBy("source").agg(r6(F.avg("m")).alias("score"), F.count(F.lit(1)).alias("items"))


@query("AGG8_mean_with_spine", f"SELECT i.instance_id, round(coalesce(avg(e.score) FILTER (WHERE e.score IS NOT NULL AND NOT isnan(e.score)), 0), 6) AS score FROM instances i LEFT JOIN eval_results e USING (instance_id) GROUP BY i.instance_id")
def agg8(spark: SparkSession, sf: str) -> DataFrame:
    m = scored(spark, sf).groupBy("instance_id").agg(F.avg("score").alias("m"))
    return table(spark, sf, "instances").select("instance_id").join(m, "instance_id", "left").select("instance_id", r6(F.coalesce("m", F.lit(0.0))).alias("score"))


def reduce_by_name(metrics: DataFrame) -> DataFrame:
    """(key, value) to one value a key: the maximum if the key contains max, the minimum if it contains min, else the mean."""
    return metrics.groupBy("key").agg(F.when(F.contains("key", F.lit("max")), F.max("value")).when(F.contains("key", F.lit("min")), F.min("value")).otherwise(F.avg("value")).alias("value"))


@query("AGG9_reduce_by_name", f"WITH m AS (SELECT 'max_' || agent_name AS key, score AS value FROM eval_results WHERE {_OK} UNION ALL SELECT 'min_' || agent_name, score FROM eval_results WHERE {_OK} UNION ALL SELECT agent_name, score FROM eval_results WHERE {_OK}) SELECT key, round(CASE WHEN contains(key, 'max') THEN max(value) WHEN contains(key, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM m GROUP BY key")
def agg9(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.array(F.concat(F.lit("max_"), "agent_name"), F.concat(F.lit("min_"), "agent_name"), F.col("agent_name"))
    return reduce_by_name(scored(spark, sf).select(F.explode(keys).alias("key"), F.col("score").alias("value"))).select("key", r6(F.col("value")).alias("value"))


@query("AGG10_batch_metrics", f"SELECT data_source, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, round(min(score), 6) AS min_score, round(avg(length(predicted_answer)), 6) AS mean_length, round(1 - var_samp(score - memory_tokens / 1000.0) / (var_samp(score) + 1e-5), 4) AS explained_variance FROM eval_results WHERE {_OK} AND memory_tokens IS NOT NULL GROUP BY data_source")
def agg10(spark: SparkSession, sf: str) -> DataFrame:
    g = scored(spark, sf).filter("memory_tokens IS NOT NULL").groupBy("data_source")
    explained = 1 - F.var_samp(F.col("score") - F.col("memory_tokens") / 1000.0) / (F.var_samp("score") + 1e-5)
    return g.agg(r6(F.avg("score")).alias("mean_score"), r6(F.max("score")).alias("max_score"), r6(F.min("score")).alias("min_score"), r6(F.avg(F.length("predicted_answer"))).alias("mean_length"), F.round(explained, 4).alias("explained_variance"))


@query("AGG11_masked_statistics", "WITH v AS (SELECT event_type, value, CAST(event_id % 3 <> 0 AS INTEGER) AS m FROM events WHERE value IS NOT NULL), a AS (SELECT event_type, sum(value * m) / (sum(m) + 1e-8) AS mean, sum(m) AS n FROM v GROUP BY event_type) SELECT v.event_type, round(any_value(a.mean), 4) AS mean, round(sum((v.value - a.mean) * (v.value - a.mean) * v.m) / (any_value(a.n) + 1e-8) * any_value(a.n) / (any_value(a.n) - 1), 3) AS var FROM v JOIN a USING (event_type) GROUP BY v.event_type")
def agg11(spark: SparkSession, sf: str) -> DataFrame:
    """Masked mean and variance with Bessel's correction, from sums of one pass."""
    v = table(spark, sf, "events").filter("value IS NOT NULL").select("event_type", "value", (F.col("event_id") % 3 != 0).cast("int").alias("m"))
    n, s, ss = F.sum("m"), F.sum(F.col("value") * F.col("m")), F.sum(F.col("value") * F.col("value") * F.col("m"))
    mean = s / (n + 1e-8)
    var = (ss - 2 * mean * s + mean * mean * n) / (n + 1e-8) * n / (n - 1)
    return v.groupBy("event_type").agg(F.round(mean, 4).alias("mean"), F.round(var, 3).alias("var"))


@query("AGG12_means_and_total", f"SELECT data_source, agent_name, round(avg(score), 6) AS score, count(*) AS n FROM eval_results WHERE {_OK} GROUP BY GROUPING SETS ((data_source, agent_name), (data_source), ())")
def agg12(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    s.createOrReplaceTempView("lodestone_agg12")
    return spark.sql("SELECT data_source, agent_name, round(avg(score), 6) AS score, count(*) AS n FROM lodestone_agg12 GROUP BY data_source, agent_name GROUPING SETS ((data_source, agent_name), (data_source), ())")


@query("AGG14_majority_vote", "WITH c AS (SELECT instance_id, item_index, predicted_answer, count(*) AS n, min(result_id) AS pos FROM eval_results WHERE predicted_answer IS NOT NULL GROUP BY ALL) SELECT instance_id, item_index, arg_max(predicted_answer, n * 1000000000 - pos) AS answer FROM c GROUP BY ALL")
def agg14(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent answer of a question, the first seen of several."""
    c = table(spark, sf, "eval_results").filter("predicted_answer IS NOT NULL").groupBy("instance_id", "item_index", "predicted_answer").agg(F.count(F.lit(1)).alias("n"), F.min("result_id").alias("pos"))
    return c.groupBy("instance_id", "item_index").agg(F.max_by("predicted_answer", F.struct("n", (-F.col("pos")).alias("p"))).alias("answer"))


@query("AGG15_validation_table", f"WITH p AS (SELECT data_source, question, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, max(score) AS best, min(score) AS worst FROM eval_results WHERE {_OK} AND question IS NOT NULL GROUP BY ALL) SELECT data_source, n, round(avg(mean), 9) AS mean, round(avg(std), 9) AS std, round(avg(best), 9) AS best, round(avg(worst), 9) AS worst FROM p GROUP BY ALL")
def agg15(spark: SparkSession, sf: str) -> DataFrame:
    p = scored(spark, sf).filter("question IS NOT NULL").groupBy("data_source", "question").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.max("score").alias("best"), F.min("score").alias("worst"))
    return p.groupBy("data_source", "n").agg(*[F.round(F.avg(c), 9).alias(c) for c in ("mean", "std", "best", "worst")])


@query("AGG16_memory_length", "SELECT instance_id, coalesce(sum(length(chunk) // 4), 0)::BIGINT AS tokens FROM chunks GROUP BY instance_id")
def agg16(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").groupBy("instance_id").agg(F.coalesce(F.sum(token_estimate("chunk")), F.lit(0)).alias("tokens"))


@query("AGG17_averages_without_nulls", "SELECT agent_name, round(avg(memory_tokens), 6) AS memory_tokens, count(memory_tokens) AS n FROM eval_results GROUP BY agent_name")
def agg17(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_results").groupBy("agent_name").agg(r6(F.avg("memory_tokens")).alias("memory_tokens"), F.count("memory_tokens").alias("n"))


@query("AGG18_throughput", "SELECT conv_id, round(sum(end_time - start_time), 3) AS seconds, round(1000.0 * sum(end_time - start_time) / count(*), 1) AS ms_per_line FROM transcript_lines WHERE start_time IS NOT NULL AND end_time IS NOT NULL GROUP BY conv_id")
def agg18(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "transcript_lines").filter("start_time IS NOT NULL AND end_time IS NOT NULL")
    s = F.sum(F.col("end_time") - F.col("start_time"))
    return t.groupBy("conv_id").agg(F.round(s, 3).alias("seconds"), F.round(1000.0 * s / F.count(F.lit(1)), 1).alias("ms_per_line"))


@query("AGG19_offline_evaluation", f"WITH r AS (SELECT data_source, instance_id, item_index, avg(score) AS m FROM eval_results WHERE {_OK} GROUP BY ALL) SELECT data_source, round(avg(m), 6) AS score FROM r GROUP BY data_source")
def agg19(spark: SparkSession, sf: str) -> DataFrame:
    r = scored(spark, sf).groupBy("data_source", "instance_id", "item_index").agg(F.avg("score").alias("m"))
    return r.groupBy("data_source").agg(r6(F.avg("m")).alias("score"))


@query("AGG20_distinct_labels", "SELECT lang, array_to_string(list_sort(list(DISTINCT domain)), ',') AS domains FROM documents WHERE domain IS NOT NULL GROUP BY lang")
def agg20(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("domain IS NOT NULL").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))


@query("AGG21_multimap", "SELECT instance_id, string_agg(result_id, ',' ORDER BY result_id) AS results FROM eval_results GROUP BY instance_id")
def agg21(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "eval_results").groupBy("instance_id").agg(F.array_sort(F.collect_list("result_id")).alias("r"))
    return g.select("instance_id", F.array_join(F.transform("r", lambda x: x.cast("string")), ",").alias("results"))


@query("AGG22_difficulty_bins", f"WITH i AS (SELECT instance_id, round(avg(score), 6) AS m FROM eval_results WHERE {_OK} GROUP BY instance_id) SELECT CASE WHEN floor(m * 10) / 10 > 0.7 THEN 'easy' WHEN floor(m * 10) / 10 >= 0.6 THEN 'medium' ELSE 'hard' END AS difficulty, count(*) AS n FROM i GROUP BY 1")
def agg22(spark: SparkSession, sf: str) -> DataFrame:
    """The start of a mean score's tenth: over .7 easy, from .6 medium, else hard."""
    i = scored(spark, sf).groupBy("instance_id").agg(r6(F.avg("score")).alias("m")).withColumn("b", F.floor(F.col("m") * 10) / 10)
    return i.groupBy(F.when(F.col("b") > 0.7, "easy").when(F.col("b") >= 0.6, "medium").otherwise("hard").alias("difficulty")).agg(F.count(F.lit(1)).alias("n"))


@query("AGG23_balance_statistics", "WITH p AS (SELECT instance_id % 8 AS part, sum(length(coalesce(chunk, '')) // 4) AS tokens FROM chunks GROUP BY 1) SELECT min(tokens)::BIGINT AS least, max(tokens)::BIGINT AS most, round(avg(tokens), 6) AS mean FROM p")
def agg23(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "chunks").groupBy((F.col("instance_id") % 8).alias("part")).agg(F.sum(token_estimate("chunk")).alias("tokens"))
    return p.agg(F.min("tokens").alias("least"), F.max("tokens").alias("most"), r6(F.avg("tokens")).alias("mean"))


@query("AGG24_sample_deviation", "SELECT event_type, round(avg(value), 4) AS mean, round(max(value), 4) AS most, round(min(value), 4) AS least, round(stddev_samp(value), 4) AS std FROM events GROUP BY event_type")
def agg24(spark: SparkSession, sf: str) -> DataFrame:
    r4 = lambda c: F.round(c, 4)
    return table(spark, sf, "events").groupBy("event_type").agg(r4(F.avg("value")).alias("mean"), r4(F.max("value")).alias("most"), r4(F.min("value")).alias("least"), r4(F.stddev_samp("value")).alias("std"))


@query("AGG25_strict_union", "SELECT instance_id, min(data_source) AS data_source FROM (SELECT instance_id, data_source FROM instances UNION ALL SELECT instance_id, data_source FROM eval_results) GROUP BY instance_id HAVING count(DISTINCT data_source) = 1")
def agg25(spark: SparkSession, sf: str) -> DataFrame:
    """Entries on which both tables agree."""
    both = table(spark, sf, "instances").select("instance_id", "data_source").unionByName(table(spark, sf, "eval_results").select("instance_id", "data_source"))
    return both.groupBy("instance_id").agg(F.min("data_source").alias("data_source"), F.max("data_source").alias("other")).filter("data_source = other").drop("other")


def poisson_weights(ids: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of each id in each of DRAWS resamples, by the inverse of the distribution at a hash of id and draw (splitmix64)."""
    x = ids.astype("int64").view("uint64")[:, None] * np.uint64(DRAWS) + np.arange(1, DRAWS + 1, dtype="uint64")
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype("float64") / 2.0**53
    return np.searchsorted(POISSON, u, "right")


def bootstrap_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(data_source, draw, weighted sum, weight) of a partition: two arrays of DRAWS sums a source, no row for a draw of a row."""
    sums: dict = {}
    for pdf in batches:
        for source, rows in pdf.groupby("data_source", dropna=False):
            key = None if pd.isna(source) else source
            total, weight = sums.setdefault(key, (np.zeros(DRAWS), np.zeros(DRAWS)))
            for i in range(0, len(rows), 1024):
                w = poisson_weights(rows["result_id"].to_numpy()[i : i + 1024])
                total += rows["score"].to_numpy()[i : i + 1024] @ w
                weight += w.sum(axis=0)
    for source, (total, weight) in sums.items():
        yield pd.DataFrame({"data_source": pd.Series([source] * DRAWS, dtype=object), "draw": np.arange(DRAWS, dtype="int32"), "total": total, "weight": weight})


@query("AGG13_bootstrap")
def agg13(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation of 1000 resampled means by source: Poisson weights from hashes need neither a collected list nor a join."""
    s = scored(spark, sf).select("data_source", F.col("score").cast("double").alias("score"), F.coalesce("result_id", F.lit(0)).cast("long").alias("result_id"))
    sums = s.mapInPandas(bootstrap_sums, "data_source string, draw int, total double, weight double")
    means = sums.groupBy("data_source", "draw").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("m"))
    return means.groupBy("data_source").agg(r6(F.avg("m")).alias("mean"), r6(F.stddev_pop("m")).alias("std"))


@query("EXT1_rollup", f"SELECT data_source, agent_name, count(*) AS n, round(sum(score), 4) AS score FROM eval_results WHERE {_OK} GROUP BY ROLLUP (data_source, agent_name)")
def ext1(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).rollup("data_source", "agent_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query("EXT2_approximate_distinct")
def ext2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("texts"))


@query("EXT3_approximate_percentiles")
def ext3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").groupBy("data_source").agg(F.percentile_approx(F.length("chunk"), [0.5, 0.9, 0.99], 10000).alias("lengths"))


@query(
    "EXT5_pricing_summary",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
)
def ext5(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), r6(F.avg("l_discount")).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query(
    "EXT6_star_join",
    "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name",
)
def ext6(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda x: table(spark, sf, x)
    priced = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p"))
    joined = t("orders").join(priced, F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("p"), 2).alias("revenue"))
