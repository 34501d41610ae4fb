"""Queries of sources, sinks and the remaining sequential operators."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import token_estimate
from lodestone.functions.tokens import token_count
from lodestone.operators import chunking as K
from lodestone.operators import dialogue as D
from lodestone.operators import memory as M
from lodestone.plans.q_retrieval import operation_log
from lodestone.plans.q_stats import r6, scored
from lodestone.plans.registry import query
from lodestone.session import shared_folder, table
from lodestone.sources import readers as S


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_INSTANCE = "SELECT instance_id, prompt, questions_and_answers, data_source, metadata FROM instances"


@query("SRC2_json_array", _INSTANCE)
def src2(spark: SparkSession, sf: str) -> DataFrame:
    """Instances written as files of one JSON array each and read back with the declared schema."""
    path = _folder(spark, "arrays")
    columns = S.INSTANCE.fieldNames()
    rows = table(spark, sf, "instances").select(*columns).withColumn("file", F.col("instance_id") % 8)
    rows.groupBy("file").agg(F.to_json(F.collect_list(F.struct(*columns))).alias("value")).select("value").write.option("lineSep", "\n\n").text(path)
    lines = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", T.ArrayType(S.INSTANCE))).alias("x"))
    return lines.select("x.*")


@query("SRC3_json_lines", _INSTANCE)
def src3(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "lines")
    table(spark, sf, "instances").select(*S.INSTANCE.fieldNames()).write.json(path)
    return S.read_jsonl(spark, path, S.INSTANCE)


@query("SRC4_tolerant_json_lines", "SELECT instance_id AS i, arg_max(data_source, instance_id) AS s FROM instances WHERE data_source IS NOT NULL GROUP BY instance_id")
def src4(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose values have lost their quotation marks in one of three rows."""
    path = _folder(spark, "tolerant")
    quote = F.when(F.col("instance_id") % 3 == 0, "").otherwise('"')
    line = F.concat(F.lit('{"i": '), F.col("instance_id").cast("string"), F.lit(', "s": '), quote, F.col("data_source"), quote, F.lit("}"))
    table(spark, sf, "instances").filter("data_source IS NOT NULL").select(line.alias("value")).write.text(path)
    return S.read_tolerant_jsonl(spark, path, T.StructType.fromDDL("i long, s string"), "i")


@query("SRC6_marked_cache", "SELECT trim(question) AS key, min(score >= 0.5) AS flag FROM eval_results WHERE question IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND NOT contains(question, chr(10)) GROUP BY trim(question) HAVING count(DISTINCT score >= 0.5) = 1")
def src6(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "cache")
    e = scored(spark, sf).filter(F.col("question").isNotNull() & ~F.contains("question", F.lit("\n")))
    e.select(F.concat(F.when(F.col("score") >= 0.5, "✓").otherwise("✗"), F.lit(" ... "), F.col("question")).alias("value")).write.text(path)
    return S.read_marked_cache(spark, path)


@query("SRC9_complete_directories", "SELECT collection_key AS directory FROM documents WHERE source IN ('qa_single', 'qa_multihop') AND collection_key IS NOT NULL GROUP BY collection_key HAVING count(DISTINCT source) = 2")
def src9(spark: SparkSession, sf: str) -> DataFrame:
    return S.directories_with(table(spark, sf, "documents").select(F.concat_ws("/", "collection_key", "source").alias("path")).filter("collection_key IS NOT NULL"), ["qa_single", "qa_multihop"])


@query("SRC11_paired_files", "SELECT 'V' || conv_id || '_S0_I0' AS key, array_to_string(list_sort(list(DISTINCT 'P' || channel)), ',') AS speakers FROM speaker_roster GROUP BY conv_id HAVING count(*) > 1")
def src11(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("V"), F.col("conv_id").cast("string"), F.lit("_S0_I0_P"), F.col("channel").cast("string"), F.lit(".wav"))
    return S.paired_files(table(spark, sf, "speaker_roster").select(path.alias("path"))).select("key", F.array_join("speakers", ",").alias("speakers"))


@query("SRC13_arrays_from_binary", "SELECT vec_id, round(list_sum(embedding), 3) AS total FROM embeddings")
def src13(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as little-endian bytes and back: numbers of the binary column are read by Arrow batches."""
    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, "<f4").tobytes())

    @F.pandas_udf("double")
    def total(b: pd.Series) -> pd.Series:
        return b.map(lambda x: float(np.frombuffer(x, "<f4").astype(float).sum()))

    return table(spark, sf, "embeddings").select("vec_id", F.round(total(pack("embedding")), 3).alias("total"))


@query("SNK2_json_sink", "SELECT result_id, agent_name, score FROM eval_results")
def snk2(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "json")
    table(spark, sf, "eval_results").select("result_id", "agent_name", "score").write.option("ignoreNullFields", "true").json(path)
    return spark.read.schema("result_id long, agent_name string, score double").json(path)


@query("SNK3_generation_dump", "SELECT result_id, question AS input, predicted_answer AS output FROM eval_results")
def snk3(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "dump")
    table(spark, sf, "eval_results").select("result_id", F.col("question").alias("input"), F.col("predicted_answer").alias("output")).write.json(path)
    return S.read_jsonl(spark, path, T.StructType.fromDDL("result_id long, input string, output string"))


@query("SNK7_partitioned_snapshot", "SELECT agent_name, instance_id, count(*) AS n FROM eval_results GROUP BY ALL")
def snk7(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot by agent, written with Spark's commit protocol and read with partition pruning."""
    path = _folder(spark, "snapshot")
    S.write_partitioned(table(spark, sf, "eval_results").select("agent_name", "instance_id", "result_id"), path, ["agent_name"])
    return spark.read.schema("instance_id long, result_id long, agent_name string").parquet(path).groupBy("agent_name", "instance_id").agg(F.count(F.lit(1)).alias("n"))


@query("SNK10_metric_fan_out", "SELECT 'eval/' || agent_name || '/score' AS metric, round(avg(score), 6) AS value FROM eval_results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY agent_name")
def snk10(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).groupBy("agent_name").agg(r6(F.avg("score")).alias("value")).select(F.concat(F.lit("eval/"), "agent_name", F.lit("/score")).alias("metric"), "value")


@query("MTH2_token_count")
def mth2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("chunk_id", token_count("chunk").alias("n_tokens"))


@query(
    "MTH11_selected_by_covariance",
    "WITH c AS (SELECT result_id, (score - avg(score) OVER ()) * (memory_tokens - avg(memory_tokens) OVER ()) AS cov FROM eval_results WHERE score IS NOT NULL AND NOT isnan(score) AND memory_tokens IS NOT NULL) SELECT result_id FROM c WHERE round(cov, 6) > 100",
)
def mth11(spark: SparkSession, sf: str) -> DataFrame:
    """Results whose covariance lies over a bound: the means are one row, handed out by scalar subqueries."""
    e = scored(spark, sf).filter("memory_tokens IS NOT NULL")
    mean = lambda c: e.agg(F.avg(c)).scalar()
    return e.withColumn("cov", (F.col("score") - mean("score")) * (F.col("memory_tokens") - mean("memory_tokens"))).filter(F.round("cov", 6) > 100).select("result_id")


@query("MEM3_bounded_core")
def mem3(spark: SparkSession, sf: str) -> DataFrame:
    """The core memory after an instance's chunks came as updates."""
    log = table(spark, sf, "chunks").select("instance_id", F.col("chunk_id").alias("seq"), F.lit("update").alias("op"), F.lit("core").alias("memory_type"), F.lit(None).cast("string").alias("memory_id"), F.coalesce("chunk", F.lit("")).alias("content"))
    return M.fold(log)


@query("MEM6_chunk_ordered_operations")
def mem6(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk of an instance in order, then the operations of its results."""
    c = table(spark, sf, "chunks").filter("chunk IS NOT NULL").select("instance_id", (F.col("chunk_idx").cast("long") * 1_000_000_000).alias("seq"), F.lit("insert").alias("op"), F.lit("episodic").alias("memory_type"), F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("memory_id"), F.col("chunk").alias("content"))
    ops = operation_log(spark, sf)
    return M.fold(c.unionByName(ops)).groupBy("instance_id", "memory_type").agg(F.count(F.lit(1)).alias("n"))


@query("STM6_stream_of_operations")
def stm6(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a stream: the state of each instance after the last batch."""
    root = _folder(spark, "log")
    operation_log(spark, sf).repartition(2, "instance_id").sortWithinPartitions("seq").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("instance_id long, seq long, op string, memory_type string, memory_id string, content string").parquet(f"{root}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{root}/out")

    M.stream_fold(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema("instance_id long, state string, batch int").parquet(f"{root}/out")
    return states.groupBy("instance_id").agg(F.max_by("state", "batch").alias("state"))


@query("CHK4_titled_packs")
def chk4(spark: SparkSession, sf: str) -> DataFrame:
    """An instance's chunks under their domains as titles, packed into chunks of 1,024 tokens."""
    return K.titled_packs(table(spark, sf, "chunks"), "instance_id", "chunk_idx", "domain", "chunk")


@query("CHK9_session_segments")
def chk9(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of 2,048 tokens; lines of the first speaker, who asks, stay with the line after them."""
    return K.pack_sessions(table(spark, sf, "transcript_lines"), 2048, "lower(trim(speaker)) = 'a'").drop("text")


@query("CHK10_aggregated_segments")
def chk10(spark: SparkSession, sf: str) -> DataFrame:
    return K.gather_segments(K.pack_sessions(table(spark, sf, "transcript_lines"), 512, "lower(trim(speaker)) = 'a'")).drop("text")


@query("CHK6_greedy_batches")
def chk6(spark: SparkSession, sf: str) -> DataFrame:
    """Instances of a source in order, batched while their chunks stay within 10,000 tokens at the source's mean size of a chunk."""
    mean = table(spark, sf, "chunks").groupBy("data_source").agg(F.avg(token_estimate("chunk")).alias("mean"))
    most = F.greatest(F.lit(1), F.floor(10000 / F.greatest(F.lit(1.0), "mean")))
    items = table(spark, sf, "instances").select("data_source", "instance_id", "num_chunks").join(mean, "data_source").withColumn("most", most)
    return K.greedy_batches(items, "data_source", "instance_id", "num_chunks", "most")


@query("SPK6_two_track_pipeline")
def spk6(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each speaker, without those inside another one."""
    s = D.sessions(D.valid_segments(table(spark, sf, "diar_segments")), 500).select("conv_id", "speaker", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    return D.drop_contained(s)


@query("PAR5_greedy_parts")
def par5(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of chunks to four parts of even token sums, the largest first to the emptiest part."""
    sizes = table(spark, sf, "chunks").groupBy("data_source").agg(F.sum(token_estimate("chunk")).alias("tokens"))
    return K.partitioned(sizes, "data_source", "tokens", 4, K.greedy_partitions)
