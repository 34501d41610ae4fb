"""Queries of registries, table functions, dispatch and the service's batch contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.embed import HashedWords
from lodestone.functions.registry import SCORES
from lodestone.functions.text import numbered_block, token_estimate
from lodestone.operators import chunking as K
from lodestone.operators import memory as M
from lodestone.operators import retrieval as R
from lodestone.plans.q_retrieval import _ASKED, _asked, _chunk_hits, _chunks, _documents, bm25_sql, operation_log
from lodestone.plans.registry import query
from lodestone.session import shared_folder, table
from lodestone.sources.readers import write_partitioned

#: Tools and their parameters, and the numbers of hits that each search asks for.
TOOLS = {"memory_insert": ("memory_type", "content"), "memory_update": ("memory_type", "memory_id", "new_content"), "memory_delete": ("memory_type", "memory_id"), "memory_search": ("query", "k")}
HITS = {"tool": 20, "batch": 20, "response": 15, "agentic": 10, "chunks": 2}


@query("RET7_batch_search", bm25_sql("SELECT doc_id AS id, text FROM documents", _ASKED, 3))
def ret7(spark: SparkSession, sf: str) -> DataFrame:
    """The remote search's batch form: three hits a query."""
    return R.bm25(_documents(spark, sf), _asked(spark, sf), "id", "text", "q", "text", 3)


@query("TOP2_hits_by_use")
def top2(spark: SparkSession, sf: str) -> DataFrame:
    """How many hits each use keeps of one ranking: the uses are a list of five."""
    uses = F.array(*[F.struct(F.lit(n).alias("use"), F.lit(k).alias("k")) for n, k in HITS.items()])
    hits = _chunk_hits(spark, sf, max(HITS.values())).select("q", "id", "rank", F.explode(uses).alias("u"))
    return hits.filter(F.col("rank") <= F.col("u.k")).groupBy("u.use").agg(F.count(F.lit(1)).alias("hits"))


@query("MEM2_updated_in_place")
def mem2(spark: SparkSession, sf: str) -> DataFrame:
    """Stores without deletes: updates keep an item's place."""
    return M.fold(operation_log(spark, sf).filter("op <> 'delete'")).filter("memory_type = 'semantic'").select("instance_id", "memory_id", "position")


@query("MEM7_dispatched_calls")
def mem7(spark: SparkSession, sf: str) -> DataFrame:
    """Logged calls by what their arguments allow: broken JSON, a missing parameter, an unknown tool, or a call."""
    c = table(spark, sf, "chunks").filter(F.startswith("chunk", F.lit("{"))).select("chunk_id", F.split("chunk", "\n")[0].alias("j"))
    tool = F.get_json_object("j", "$.tool")
    known = F.coalesce(tool, F.get_json_object("j", "$.name"))
    kind = F.get_json_object("j", "$.arguments.memory_type")
    status = F.when(F.get_json_object("j", "$").isNull(), "broken JSON").when(known.isNull() | ~known.isin(*TOOLS), "unknown tool").when(kind.isNull(), "missing parameter").otherwise("call")
    return c.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SNK4_atomic_checkpoint", "SELECT instance_id, max(result_id) AS last_result FROM eval_results GROUP BY instance_id")
def snk4(spark: SparkSession, sf: str) -> DataFrame:
    """A checkpoint written twice over: readers see the old or the new one, as a job's files appear on commit."""
    import uuid

    path = f"{shared_folder(spark)}/checkpoint-{uuid.uuid4().hex}"
    state = table(spark, sf, "eval_results").groupBy("instance_id").agg(F.max("result_id").alias("last_result")).withColumn("part", F.col("instance_id") % 4)
    for _ in range(2):
        write_partitioned(state, path, ["part"])
    return spark.read.schema("instance_id long, last_result long, part long").parquet(path).select("instance_id", "last_result")


@query("SNK9_batch_contract")
def snk9(spark: SparkSession, sf: str) -> DataFrame:
    """The service's batch form: for each question the memory block of its hits within 2,000 tokens, numbered."""
    sizes = _chunks(spark, sf).select("id", F.coalesce("text", F.lit("")).alias("text"), token_estimate("text").alias("tokens"))
    hits = R.within_budget(_chunk_hits(spark, sf, 20).join(sizes, "id"), "q", "tokens", 2000)
    blocks = hits.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("h"))
    return _asked(spark, sf).select("q").join(blocks, "q", "left").select("q", F.coalesce(numbered_block(F.transform("h", lambda x: x["text"])), F.lit("Empty.")).alias("block"))


@query("SRC7_named_split", "SELECT CASE WHEN instance_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM instances GROUP BY 1")
def src7(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "instances").groupBy(F.when(F.col("instance_id") % 10 == 0, "test").otherwise("train").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("SRC10_conversation_discovery", "SELECT conv_id, count(*) AS files FROM (SELECT DISTINCT conv_id, speaker FROM diar_segments) GROUP BY conv_id")
def src10(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations from paths pair/conversation/speaker.wav."""
    path = F.concat_ws("/", F.lit("pair"), F.col("conv_id").cast("string"), F.concat(F.coalesce("speaker", F.lit("")), F.lit(".wav")))
    found = table(spark, sf, "diar_segments").select(path.alias("path")).distinct().select(F.regexp_extract("path", r"^pair/(\d+)/[^/]*\.wav$", 1).cast("long").alias("conv_id"))
    return found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("files"))


@query("UDF1_tool_registry", "SELECT * FROM (VALUES ('memory_delete', 2), ('memory_insert', 2), ('memory_search', 2), ('memory_update', 3)) AS t(tool, parameters)")
def udf1(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n, len(p)) for n, p in sorted(TOOLS.items())], "tool string, parameters int")


@query("UDF6_batch_scorer")
def udf6(spark: SparkSession, sf: str) -> DataFrame:
    """All registered scores of a result in one pass."""
    p, g = F.col("predicted_answer"), F.col("gold_answer")
    return table(spark, sf, "eval_results").select("result_id", *[F.round(F.coalesce(f(p, g).cast("double"), F.lit(0.0)), 6).alias(n) for n, f in SCORES.items()])


@query("UDF7_embedding_backend")
def udf7(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest documents of every fiftieth one by hashed words."""
    d = table(spark, sf, "documents").select("doc_id", HashedWords().column()("text").alias("v"))
    return R.cosine_top_k(d, d.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "q"), "doc_id", "v", "q", 5)


class Chunker:
    """Sentences of a text packed under a budget, as rows."""

    def eval(self, text: str, most: int):  # noqa: ANN201
        for k, chunk in enumerate(K.pack_sentences(text, most)):
            yield k, chunk


@query("UDTF1_chunks_in_sql")
def udtf1(spark: SparkSession, sf: str) -> DataFrame:
    """The packer as a table function of SQL."""
    spark.udtf.register("lodestone_chunks", F.udtf(Chunker, returnType="chunk_no int, chunk string"))
    table(spark, sf, "chunks").createOrReplaceTempView("lodestone_udtf1")
    return spark.sql("SELECT c.chunk_id, t.chunk_no, t.chunk FROM lodestone_udtf1 c, LATERAL lodestone_chunks(c.chunk, 256) t")


@query("UDF3_policy_losses", "SELECT result_id, round(greatest(-a * ratio, -a * greatest(least(ratio, 1.2), 0.8)), 6) AS clipped, round(-a * ratio, 6) AS plain FROM (SELECT result_id, score - 0.5 AS a, exp(score - 0.5) AS ratio FROM eval_results WHERE score IS NOT NULL AND NOT isnan(score))")
def udf3(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.operators.advantages import clipped_loss
    from lodestone.plans.q_stats import scored

    a = F.col("score") - 0.5
    ratio = F.exp(a)
    return scored(spark, sf).select("result_id", F.round(clipped_loss(a, ratio, 0.2), 6).alias("clipped"), F.round(-a * ratio, 6).alias("plain"))


@query("UDF4_reward_managers", "SELECT instance_id, round(avg(CASE WHEN isnan(score) OR score IS NULL THEN 0 ELSE score END), 6) AS naive, round(avg(CASE WHEN isnan(score) OR score IS NULL THEN 0 ELSE score END + least(-(length(predicted_answer) - 100) / 50.0 * 0.5, 0)), 6) AS with_length FROM eval_results WHERE predicted_answer IS NOT NULL GROUP BY instance_id")
def udf4(spark: SparkSession, sf: str) -> DataFrame:
    s = F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0))
    penalty = F.least(-(F.length("predicted_answer") - 100) / 50.0 * 0.5, F.lit(0.0))
    e = table(spark, sf, "eval_results").filter("predicted_answer IS NOT NULL")
    return e.groupBy("instance_id").agg(F.round(F.avg(s), 6).alias("naive"), F.round(F.avg(s + penalty), 6).alias("with_length"))


@query("PAR7_error_column", "SELECT result_id, CAST(NULL AS VARCHAR) AS error, TRY_CAST(gold_answer AS BIGINT) AS number FROM eval_results WHERE regexp_matches(gold_answer, '^[0-9]{1,9}$') UNION ALL SELECT result_id, 'not a number', NULL FROM eval_results WHERE NOT regexp_matches(gold_answer, '^[0-9]{1,9}$')")
def par7(spark: SparkSession, sf: str) -> DataFrame:
    """What can't be computed gets an error instead of failing the job."""
    g = F.col("gold_answer")
    number = F.when(g.rlike("^[0-9]{1,9}$"), g.try_cast("long"))
    return table(spark, sf, "eval_results").filter(g.isNotNull()).select("result_id", F.when(number.isNull(), "not a number").alias("error"), number.alias("number"))
