"""Queries of retrieval, top-k, memory stores and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import token_estimate, words
from lodestone.operators import chunking as K
from lodestone.operators import memory as M
from lodestone.operators import retrieval as R
from lodestone.plans.registry import query
from lodestone.session import table

_WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"


def bm25_sql(items: str, asked: str, k: int, store: str | None = None, having: str = "") -> str:
    """BM25 in SQL: items (store, id, text) and asked (store, q, text)."""
    s, on, part = (f"{store}, ", f"{store}, ", f"GROUP BY {store}") if store else ("", "", "")
    join = f"JOIN size USING ({store})" if store else "CROSS JOIN size"
    join_mean = f"JOIN mean USING ({store})" if store else "CROSS JOIN mean"
    return f"""WITH items AS ({items}), asked AS ({asked}),
    tok AS (SELECT {s}id, {_WORDS.format('text')} AS w FROM items),
    size AS (SELECT {s}count(*) AS n, avg(len(w)) AS avgdl FROM tok {part}),
    post AS (SELECT {s}id, dl, term, count(*) AS tf FROM (SELECT {s}id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
    df AS (SELECT {s}term, count(*) AS df FROM post GROUP BY ALL),
    raw AS (SELECT {s}term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df {join}),
    mean AS (SELECT {s}avg(idf) AS mean_idf FROM raw {part}),
    idf AS (SELECT {s}term, avgdl, CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS idf FROM raw {join_mean}),
    qt AS (SELECT {s}q, term, count(*) AS times FROM (SELECT {s}q, unnest({_WORDS.format('text')}) AS term FROM asked) GROUP BY ALL),
    sc AS (SELECT q, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING ({on}term) JOIN post USING ({on}term) GROUP BY q, id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM sc)
    SELECT q, id, rank, score FROM rk WHERE rank <= {k} {having}"""


_ASKED = "SELECT result_id AS q, question AS text FROM eval_results WHERE result_id % 50 = 0"
_ASKED_IN = "SELECT instance_id, result_id AS q, question AS text FROM eval_results WHERE result_id % 50 = 0"
_CHUNKS = "SELECT instance_id, chunk_id AS id, chunk AS text FROM chunks"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: results whose number is divisible by 50."""
    return table(spark, sf, "eval_results").filter("result_id % 50 = 0").select("instance_id", F.col("result_id").alias("q"), F.col("question").alias("text"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("instance_id", F.col("chunk_id").alias("id"), F.col("chunk").alias("text"))


def _hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return R.bm25(_documents(spark, sf), _asked(spark, sf), "id", "text", "q", "text", k)


def _chunk_hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return R.bm25(_chunks(spark, sf), _asked(spark, sf), "id", "text", "q", "text", k, ["instance_id"])


@query("RET1_bm25_top_k", bm25_sql("SELECT doc_id AS id, text FROM documents", _ASKED, 5, having="AND score >= 0"))
def ret1(spark: SparkSession, sf: str) -> DataFrame:
    """The five best documents of each question; negative scores are dropped."""
    return _hits(spark, sf, 5).filter("score >= 0")


@query("RET2_bm25_by_store", bm25_sql(_CHUNKS, _ASKED_IN, 20, "instance_id"))
def ret2(spark: SparkSession, sf: str) -> DataFrame:
    """Every instance is a store of its own: statistics and hits are its chunks'."""
    return _chunk_hits(spark, sf, 20)


@query("RET3_chunks_for_question", bm25_sql(_CHUNKS, _ASKED_IN, 2, "instance_id"))
def ret3(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_hits(spark, sf, 2)


_COS = """WITH v AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings),
    s AS (SELECT a.vec_id AS q, b.vec_id AS vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) / a.n * (CAST(x[2] AS DOUBLE) / b.n))), 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.n > 0 AND b.n > 0)"""


@query("RET4_cosine_top_k", _COS + " SELECT q, vec_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10")
def ret4(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "q")
    return R.cosine_top_k(v, q, "vec_id", "embedding", "q", 10)


@query("RET5_dispatch", bm25_sql("SELECT doc_id AS id, text FROM documents", "SELECT result_id AS q, question AS text FROM eval_results WHERE result_id % 50 = 0 AND trim(question) <> ''", 3))
def ret5(spark: SparkSession, sf: str) -> DataFrame:
    """The method that a query asks for; blank queries find nothing."""
    asked = _asked(spark, sf).filter(F.trim("text") != "")
    return R.bm25(_documents(spark, sf), asked, "id", "text", "q", "text", 3)


@query("RET6_followed_up_hits")
def ret6(spark: SparkSession, sf: str) -> DataFrame:
    """Two seeds, then the two best of the next ten that weren't among them."""
    # a question's hits differ, so those are its ranks 3 and 4: one ranking serves both rounds
    return _chunk_hits(spark, sf, 12).filter("rank <= 4").select("q", "id", (F.col("rank") > 2).cast("int").alias("round"))


@query("MTH1_cosine_of_neighbours", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def mth1(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", R.unit("embedding").alias("v"))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(b, "vec_id").select("vec_id", F.round(F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 4).alias("cosine"))


@query("TOP1_best_scores", "SELECT data_source, result_id, k FROM (SELECT data_source, result_id, row_number() OVER (PARTITION BY data_source ORDER BY score DESC, result_id) AS k FROM eval_results WHERE score IS NOT NULL AND NOT isnan(score)) WHERE k <= 20")
def top1(spark: SparkSession, sf: str) -> DataFrame:
    """Top-k by source: each row ranks within one of 64 salts first, the survivors within the source."""
    e = table(spark, sf, "eval_results").filter(F.col("score").isNotNull() & ~F.isnan("score")).select("data_source", "result_id", "score", F.pmod(F.hash("result_id"), F.lit(64)).alias("salt"))
    order = [F.desc("score"), F.col("result_id")]
    best = e.withColumn("k", F.row_number().over(Window.partitionBy("data_source", "salt").orderBy(*order))).filter("k <= 20")
    return best.withColumn("k", F.row_number().over(Window.partitionBy("data_source").orderBy(*order))).filter("k <= 20").select("data_source", "result_id", "k")


@query("TOP3_within_token_budget", bm25_sql(_CHUNKS, _ASKED_IN, 20, "instance_id").replace("SELECT q, id, rank, score FROM rk WHERE rank <= 20", "SELECT q, id, rank FROM (SELECT q, id, rank, sum(length(coalesce(i.text, '')) // 4) OVER (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM rk JOIN items i USING (id) WHERE rank <= 20) WHERE upto <= 2000 OR rank = 1"))
def top3(spark: SparkSession, sf: str) -> DataFrame:
    """The most hits whose tokens fit a budget, in one pass over the ranks."""
    sizes = _chunks(spark, sf).select("id", token_estimate("text").alias("tokens"))
    return R.within_budget(_chunk_hits(spark, sf, 20).join(sizes, "id"), "q", "tokens", 2000).select("q", "id", "rank")


@query("TOP4_first_chunks_for_blank_queries", "SELECT instance_id, chunk_id FROM (SELECT instance_id, chunk_id, row_number() OVER (PARTITION BY instance_id ORDER BY chunk_idx, chunk_id) AS k FROM chunks) WHERE k <= 2")
def top4(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("instance_id").orderBy("chunk_idx", "chunk_id")
    return table(spark, sf, "chunks").select("instance_id", "chunk_id", F.row_number().over(w).alias("k")).filter("k <= 2").drop("k")


@query("TOP5_arg_max", "SELECT instance_id, arg_max(result_id, score * 1000000000 - result_id) AS best, arg_min(result_id, score * 1000000000 + result_id) AS worst FROM eval_results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY instance_id")
def top5(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_results").filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return e.groupBy("instance_id").agg(F.max_by("result_id", F.struct("score", -F.col("result_id"))).alias("best"), F.min_by("result_id", F.struct("score", "result_id")).alias("worst"))


@query("TOP6_two_best", "SELECT instance_id, item_index, max(score) AS first, max(score) FILTER (WHERE k = 2) AS second FROM (SELECT instance_id, item_index, score, row_number() OVER (PARTITION BY instance_id, item_index ORDER BY score DESC, result_id) AS k FROM eval_results WHERE score IS NOT NULL AND NOT isnan(score)) GROUP BY ALL")
def top6(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_results").filter(F.col("score").isNotNull() & ~F.isnan("score"))
    w = Window.partitionBy("instance_id", "item_index").orderBy(F.desc("score"), "result_id")
    k = e.withColumn("k", F.row_number().over(w)).filter("k <= 2")
    return k.groupBy("instance_id", "item_index").agg(F.max("score").alias("first"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("second"))


@query("TOP9_head", "SELECT instance_id, num_chunks FROM instances ORDER BY num_chunks DESC, instance_id LIMIT 20")
def top9(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "instances").select("instance_id", "num_chunks").orderBy(F.desc("num_chunks"), "instance_id").limit(20)


@query("TOP10_conversation_window", "SELECT conv_id, line_id FROM (SELECT conv_id, line_id, row_number() OVER (PARTITION BY conv_id ORDER BY line_id DESC) AS k FROM transcript_lines) WHERE k <= 10")
def top10(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("line_id"))
    return table(spark, sf, "transcript_lines").select("conv_id", "line_id", F.row_number().over(w).alias("k")).filter("k <= 10").drop("k")


def operation_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of operations from the results: the agent decides the operation, the item the memory it is about."""
    e = table(spark, sf, "eval_results")
    op = F.when(F.col("result_id") % 7 == 0, "delete").when(F.col("result_id") % 3 == 0, "update").otherwise("insert")
    kind = F.when(F.col("item_index") % 2 == 0, "semantic").otherwise("episodic")
    return e.select("instance_id", F.col("result_id").alias("seq"), op.alias("op"), kind.alias("memory_type"), F.concat(F.lit("i"), F.col("item_index").cast("string")).alias("memory_id"), F.coalesce("predicted_answer", F.lit("")).alias("content"))


_LOG = "SELECT instance_id, result_id AS seq, CASE WHEN result_id % 7 = 0 THEN 'delete' WHEN result_id % 3 = 0 THEN 'update' ELSE 'insert' END AS op, CASE WHEN item_index % 2 = 0 THEN 'semantic' ELSE 'episodic' END AS memory_type, 'i' || item_index AS memory_id, coalesce(predicted_answer, '') AS content FROM eval_results"


@query("MEM1_folded_stores")
def mem1(spark: SparkSession, sf: str) -> DataFrame:
    return M.fold(operation_log(spark, sf))


@query("MEM4_operation_outcomes")
def mem4(spark: SparkSession, sf: str) -> DataFrame:
    return M.outcomes(operation_log(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("MEM5_enabled_types", f"SELECT memory_type, count(*) AS n FROM ({_LOG}) WHERE memory_type IN ('semantic', 'core') GROUP BY memory_type")
def mem5(spark: SparkSession, sf: str) -> DataFrame:
    return operation_log(spark, sf).filter(F.col("memory_type").isin("semantic", "core")).groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"))


@query("MEM8_recurrent_summary", r"SELECT instance_id, array_to_string(list_filter(regexp_split_to_array(string_agg(coalesce(chunk, ''), ' ' ORDER BY chunk_idx, chunk_id), '\s+'), lambda x: x <> '')[-64:], ' ') AS memory FROM chunks GROUP BY instance_id")
def mem8(spark: SparkSession, sf: str) -> DataFrame:
    return M.recurrent_summary(table(spark, sf, "chunks"), "instance_id", ["chunk_idx", "chunk_id"], "chunk")


@query("MEM9_latest_content", f"SELECT instance_id, memory_type, memory_id, content FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, memory_type, memory_id ORDER BY seq DESC) AS k FROM ({_LOG})) WHERE k = 1 AND op <> 'delete'")
def mem9(spark: SparkSession, sf: str) -> DataFrame:
    return M.latest_content(operation_log(spark, sf))


def _chunked(name: str, chunker) -> None:  # noqa: ANN001
    @query(name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return K.explode_chunks(table(spark, sf, "documents"), "doc_id", "text", chunker, 256)


_chunked("CHK1_sentence_packs", K.pack_sentences)
_chunked("CHK3_paragraph_packs", K.pack_paragraphs)
_chunked("CHK8_split_turns", K.split_turn)


@query("CHK2_session_packs")
def chk2(spark: SparkSession, sf: str) -> DataFrame:
    return K.pack_sessions(table(spark, sf, "transcript_lines"))


@query("CHK7_fixed_groups", "SELECT instance_id, chunk_idx // 10 AS part, count(*) AS n FROM chunks GROUP BY ALL")
def chk7(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").groupBy("instance_id", F.expr("chunk_idx div 10").cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("CHK11_event_chunks", "SELECT instance_id, chunk_idx // 16 AS part, '# ' || coalesce(data_source, '') || chr(10) || string_agg(coalesce(chunk, ''), chr(10) ORDER BY chunk_idx, chunk_id) AS text FROM (SELECT instance_id, chunk_idx, chunk_id, chunk FROM chunks) JOIN instances USING (instance_id) GROUP BY instance_id, chunk_idx // 16, data_source")
def chk11(spark: SparkSession, sf: str) -> DataFrame:
    """A header and the texts of sixteen places of an instance each, in order."""
    part = F.expr("chunk_idx div 16").cast("int").alias("part")
    c = table(spark, sf, "chunks").groupBy("instance_id", part).agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_id", F.coalesce("chunk", F.lit("")).alias("s")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["s"]), "\n")
    return table(spark, sf, "instances").join(c, "instance_id").select("instance_id", "part", F.concat(F.lit("# "), F.coalesce("data_source", F.lit("")), F.lit("\n"), body).alias("text"))


@query("CHK13_even_parts", "SELECT chunk_id, CAST(ntile(3) OVER (PARTITION BY instance_id ORDER BY chunk_id) AS INTEGER) AS part FROM chunks")
def chk13(spark: SparkSession, sf: str) -> DataFrame:
    return K.even_groups(table(spark, sf, "chunks"), "instance_id", "chunk_id", 3).select("chunk_id", "part")


@query("CHK14_missing_labels", "WITH a AS (SELECT DISTINCT domain FROM chunks WHERE domain IS NOT NULL), i AS (SELECT DISTINCT instance_id FROM chunks), h AS (SELECT DISTINCT instance_id, domain FROM chunks) SELECT i.instance_id, a.domain FROM i, a WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.instance_id = i.instance_id AND h.domain = a.domain)")
def chk14(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that an instance lacks: the few labels are one array row, so instances are exploded, not crossed."""
    c = table(spark, sf, "chunks")
    labels = sorted(r[0] for r in c.filter("domain IS NOT NULL").select("domain").distinct().collect())  # a closed list of domains
    have = c.groupBy("instance_id").agg(F.collect_set("domain").alias("have"))
    return have.select("instance_id", F.explode(F.array_except(F.array(*[F.lit(x) for x in labels]), "have")).alias("domain"))


@query("PAR4_balanced_partitions")
def par4(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of documents to four parts of even token sums by differencing."""
    sizes = table(spark, sf, "documents").groupBy("source").agg(F.sum(token_estimate("text")).alias("tokens"))
    return K.partitioned(sizes, "source", "tokens", 4, K.differencing_partitions)


@query("PAR6_micro_batches", "SELECT instance_id, CAST(ceil(sum(length(coalesce(chunk, '')) // 4) / 2000.0) AS BIGINT) AS batches FROM chunks GROUP BY instance_id")
def par6(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").groupBy("instance_id").agg(F.ceil(F.sum(token_estimate("chunk")) / 2000.0).alias("batches"))
