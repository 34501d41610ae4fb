"""Queries of projections, filters, joins, set operations and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import keywords, normalize_answer, token_estimate, words
from lodestone.operators import corpus as C
from lodestone.plans.registry import query
from lodestone.session import table

QA_SQL = "(SELECT instance_id, data_source, unnest(range(CAST(json_array_length(questions_and_answers) AS BIGINT))) AS qa_idx, questions_and_answers AS j FROM instances)"
QAS = f"(SELECT instance_id, data_source, qa_idx, json_extract_string(j, '$[' || qa_idx || '].question') AS question, CASE WHEN json_type(j, '$[' || qa_idx || '].answer') = 'ARRAY' THEN CAST(json_extract(j, '$[' || qa_idx || '].answer') AS VARCHAR) ELSE json_extract_string(j, '$[' || qa_idx || '].answer') END AS answer FROM {QA_SQL})"
EXCLUDED = ("abstract_labels", "ttl_rules", "keyword_sum")


def _simple(name: str, tab: str, cols: list[str], where: str, sql_where: str | None = None) -> None:
    @query(name, f"SELECT {', '.join(cols)} FROM {tab} WHERE {sql_where or where}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, tab).filter(where).select(*cols)


_simple("FLT1_source_equality", "instances", ["instance_id", "num_questions"], "data_source = 'qa_single'")
_simple("FLT2_source_membership", "instances", ["instance_id", "data_source"], "data_source IN ('qa_single', 'qa_multihop')")
_simple("FLT3_literal_prefix", "documents", ["doc_id", "source"], "startswith(source, 'lme_s*')", "starts_with(source, 'lme_s*')")
_simple("FLT4_exclusion_list", "documents", ["doc_id", "source"], f"NOT (contains(source, 'niah') OR source IN {EXCLUDED})")
_simple("FLT16_kind_exclusion", "transcript_lines", ["line_id", "turn_type"], "turn_type <> 'BACKCHANNEL'")
_simple("FLT17_nonempty_text", "documents", ["doc_id", "n_chars"], "length(text) > 0")
_simple("FLT8_short_question", "eval_results", ["result_id", "question"], "length(question) div 4 < 16", "length(question) // 4 < 16")


@query("SRC1_scan_with_source_filter", "SELECT data_source, count(*) AS n, sum(num_questions) AS questions FROM instances WHERE data_source <> 'ttl_rules' GROUP BY data_source")
def src1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "instances").filter("data_source <> 'ttl_rules'").groupBy("data_source").agg(F.count(F.lit(1)).alias("n"), F.sum("num_questions").alias("questions"))


@query("FLT5_chunk_count_cap", "SELECT instance_id, count(DISTINCT chunk_idx) AS n_chunks FROM chunks GROUP BY instance_id HAVING count(DISTINCT chunk_idx) <= 20")
def flt5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").groupBy("instance_id").agg(F.countDistinct("chunk_idx").alias("n_chunks")).filter("n_chunks <= 20")


@query("FLT6_minimum_chunks", "SELECT instance_id, count(DISTINCT chunk_idx) AS n_chunks FROM chunks GROUP BY instance_id HAVING count(DISTINCT chunk_idx) >= 5")
def flt6(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").groupBy("instance_id").agg(F.countDistinct("chunk_idx").alias("n_chunks")).filter("n_chunks >= 5")


@query("FLT7_question_bounds", "SELECT instance_id, json_array_length(questions_and_answers) AS n FROM instances WHERE json_array_length(questions_and_answers) BETWEEN 2 AND 200")
def flt7(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "instances").select("instance_id", F.json_array_length("questions_and_answers").alias("n")).filter("n BETWEEN 2 AND 200")


@query("FLT9_short_answer_placeholder", "SELECT result_id, CASE WHEN length(gold_answer) // 4 < 5 THEN predicted_answer ELSE '[FILTERED_LONG_ANSWER]' END AS response FROM eval_results")
def flt9(spark: SparkSession, sf: str) -> DataFrame:
    short = F.length("gold_answer") / 4
    return table(spark, sf, "eval_results").select("result_id", F.when(F.floor(short) < 5, F.col("predicted_answer")).otherwise("[FILTERED_LONG_ANSWER]").alias("response"))


@query(
    "FLT12_stop_after_enough_kept",
    """WITH k AS (SELECT result_id, instance_id, CAST(coalesce(score, 1) < 0.5 OR isnan(score) AS INTEGER) AS keep FROM eval_results),
    t AS (SELECT *, coalesce(sum(keep) OVER (PARTITION BY instance_id ORDER BY result_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5 AS tested FROM k)
    SELECT result_id, instance_id FROM t WHERE tested AND keep = 1""",
)
def flt12(spark: SparkSession, sf: str) -> DataFrame:
    """Results in order until five of an instance are kept; a null score isn't kept."""
    score = F.col("score")
    keep = F.coalesce((score < 0.5) | F.isnan(score), F.lit(False)).cast("int")
    w = Window.partitionBy("instance_id").orderBy("result_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf, "eval_results").select("result_id", "instance_id", keep.alias("keep")).withColumn("before", F.coalesce(F.sum("keep").over(w), F.lit(0)))
    return e.filter("before < 5 AND keep = 1").select("result_id", "instance_id")


@query(
    "FLT13_answerable_parts",
    """WITH p AS (SELECT result_id, list_filter(list_transform(string_split(gold_answer, ','), lambda x: trim(x)), lambda x: x <> '' AND contains(lower(predicted_answer), lower(x))) AS hit FROM eval_results)
    SELECT result_id, array_to_string(hit, ';') AS answer FROM p WHERE len(hit) > 0""",
)
def flt13(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.filter(keywords("gold_answer"), lambda x: F.contains(F.lower("predicted_answer"), F.lower(x)))
    return table(spark, sf, "eval_results").select("result_id", hit.alias("hit")).filter(F.size("hit") > 0).select("result_id", F.array_join("hit", ";").alias("answer"))


@query(
    "FLT14_cached_answerability",
    """WITH c AS (SELECT lower(display_name) || '?' AS ending, min(conv_id * 10 + channel) AS pos FROM speaker_roster GROUP BY 1),
    q AS (SELECT DISTINCT question FROM eval_results WHERE question IS NOT NULL)
    SELECT question, min_by(ending, pos) AS ending FROM q JOIN c ON ends_with(lower(question), ending) GROUP BY question""",
)
def flt14(spark: SparkSession, sf: str) -> DataFrame:
    """The first cached ending that a question ends with: its last words are the keys of an equi-join, so nothing is compared with everything."""
    cache = table(spark, sf, "speaker_roster").groupBy(F.concat(F.lower("display_name"), F.lit("?")).alias("ending")).agg(F.min(F.col("conv_id") * 10 + F.col("channel")).alias("pos"))
    asked = table(spark, sf, "eval_results").filter("question IS NOT NULL").select("question").distinct()
    last = lambda c: F.regexp_extract(F.lower(c), r"([\p{L}\p{N}]+)\W*$", 1)
    met = asked.withColumn("k", last("question")).join(cache.withColumn("k", last("ending")), "k").filter(F.endswith(F.lower("question"), F.col("ending")))
    return met.groupBy("question").agg(F.min_by("ending", "pos").alias("ending"))


@query("FLT15_hash_resume", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND source = 'qa_multihop')")
def flt15(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text isn't among those done (here, those of one source)."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return d.join(d.filter("source = 'qa_multihop'").select("h"), "h", "left_anti").select("doc_id")


@query("PRJ1_standard_row", "SELECT result_id, coalesce(gold_answer, predicted_answer, '') AS answer, json_object('agent', agent_name, 'source', data_source) AS metadata FROM eval_results")
def prj1(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.to_json(F.struct(F.col("agent_name").alias("agent"), F.col("data_source").alias("source")), {"ignoreNullFields": "false"})
    return table(spark, sf, "eval_results").select("result_id", F.coalesce("gold_answer", "predicted_answer", F.lit("")).alias("answer"), meta.alias("metadata"))


@query("PRJ2_renumbered_instances", "SELECT instance_id, row_number() OVER (ORDER BY md5(CAST(instance_id AS VARCHAR) || '|42'), instance_id) - 1 AS new_id FROM instances")
def prj2(spark: SparkSession, sf: str) -> DataFrame:
    """Positions after a shuffle: ranks within the first byte of the hash, shifted by the rows of smaller bytes, so no window runs over all rows."""
    i = table(spark, sf, "instances").select("instance_id", C.hashed_order("instance_id").alias("h")).withColumn("b", F.substring("h", 1, 2))
    sizes = i.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("b", (F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    return i.join(before, "b").select("instance_id", (F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("h", "instance_id")) - 1).alias("new_id"))


@query("PRJ3_source_label", "SELECT instance_id, coalesce(sub_source, data_source, json_extract_string(metadata, '$.domain')) AS label FROM instances")
def prj3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "instances").select("instance_id", F.coalesce("sub_source", "data_source", F.get_json_object("metadata", "$.domain")).alias("label"))


@query("PRJ4_decorated_question", "SELECT e.result_id, CASE WHEN l.max_chars IS NOT NULL THEN 'At most ' || l.max_chars || ' characters.' || chr(10) || chr(10) || e.question ELSE e.question END AS question FROM eval_results e LEFT JOIN source_limits l USING (data_source)")
def prj4(spark: SparkSession, sf: str) -> DataFrame:
    limits = table(spark, sf, "source_limits").select("data_source", "max_chars")
    text = F.concat(F.lit("At most "), F.col("max_chars"), F.lit(" characters.\n\n"), F.col("question"))
    return table(spark, sf, "eval_results").join(limits, "data_source", "left").select("result_id", F.when(F.col("max_chars").isNotNull(), text).otherwise(F.col("question")).alias("question"))


@query(
    "PRJ5_prompt_assembly",
    "SELECT i.instance_id, md5(i.prompt || chr(10) || chr(10) || c.body) AS prompt_md5 FROM instances i JOIN (SELECT instance_id, string_agg(chunk, chr(10) || chr(10) ORDER BY chunk_idx, chunk_id) AS body FROM chunks WHERE chunk IS NOT NULL GROUP BY instance_id) c USING (instance_id)",
)
def prj5(spark: SparkSession, sf: str) -> DataFrame:
    body = table(spark, sf, "chunks").filter("chunk IS NOT NULL").groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_id", "chunk"))).alias("c"))
    joined = F.array_join(F.transform("c", lambda x: x["chunk"]), "\n\n")
    return table(spark, sf, "instances").join(body, "instance_id").select("instance_id", F.md5(F.concat("prompt", F.lit("\n\n"), joined)).alias("prompt_md5"))


@query("PRJ6_column_union", "SELECT i.instance_id, i.data_source AS source, c.n AS n_chunks FROM instances i JOIN (SELECT instance_id, count(*) AS n FROM chunks GROUP BY instance_id) c USING (instance_id)")
def prj6(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "chunks").groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return table(spark, sf, "instances").select("instance_id", F.col("data_source").alias("source")).join(n, "instance_id")


@query("PRJ7_slice_with_step", "SELECT result_id, instance_id FROM eval_results WHERE result_id >= 10 AND (result_id - 10) % 3 = 0")
def prj7(spark: SparkSession, sf: str) -> DataFrame:
    """Every third row from the tenth: the slice is the feature."""
    return table(spark, sf, "eval_results").filter("result_id >= 10 AND (result_id - 10) % 3 = 0").select("result_id", "instance_id")


@query("PRJ8_numbered_block", "SELECT instance_id, string_agg(n || '. ' || question, chr(10) ORDER BY n) AS block FROM (SELECT instance_id, question, row_number() OVER (PARTITION BY instance_id ORDER BY result_id) AS n FROM eval_results WHERE question IS NOT NULL) GROUP BY instance_id")
def prj8(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "eval_results").filter("question IS NOT NULL").groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("result_id", "question"))).alias("q"))
    block = F.array_join(F.transform("q", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["question"])), "\n")
    return items.select("instance_id", block.alias("block"))


@query("PRJ9_id_tagged_block", "SELECT i.instance_id, coalesce(string_agg('[' || e.result_id || '] ' || e.gold_answer, chr(10) ORDER BY e.result_id), 'Empty.') AS block FROM instances i LEFT JOIN eval_results e ON e.instance_id = i.instance_id AND e.gold_answer IS NOT NULL GROUP BY i.instance_id")
def prj9(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_results").filter("gold_answer IS NOT NULL").groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("result_id", "gold_answer"))).alias("g"))
    block = F.array_join(F.transform("g", lambda x: F.concat(F.lit("["), x["result_id"].cast("string"), F.lit("] "), x["gold_answer"])), "\n")
    return table(spark, sf, "instances").select("instance_id").join(e, "instance_id", "left").select("instance_id", F.coalesce(block, F.lit("Empty.")).alias("block"))


@query("PRJ10_prompt_by_source", "SELECT doc_id, CASE WHEN source = 'book_chapters' OR contains(source, 'sum') THEN 'book' WHEN contains(source, 'label') OR starts_with(source, 'ttl') THEN 'classify' WHEN starts_with(source, 'lme_s') THEN 'personal' ELSE 'default' END AS prompt FROM documents")
def prj10(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("source")
    kind = F.when((s == "book_chapters") | F.contains(s, F.lit("sum")), "book").when(F.contains(s, F.lit("label")) | F.startswith(s, F.lit("ttl")), "classify").when(F.startswith(s, F.lit("lme_s")), "personal").otherwise("default")
    return table(spark, sf, "documents").select("doc_id", kind.alias("prompt"))


@query(
    "JOIN1_substring_join",
    r"""WITH p AS (SELECT DISTINCT gold_answer AS part FROM eval_results WHERE gold_answer IS NOT NULL AND len(regexp_extract_all(lower(gold_answer), '[\p{L}\p{N}_]+')) > 2)
    SELECT c.chunk_id, p.part FROM chunks c JOIN p ON contains(c.chunk, p.part)""",
)
def join1(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "eval_results").select(F.col("gold_answer").alias("part")).filter(F.col("part").isNotNull() & (F.size(words("part")) > 2)).distinct()
    return C.contains_join(table(spark, sf, "chunks").select("chunk_id", "chunk"), parts, "chunk_id", "chunk", "part")


@query("JOIN1_all_parts", "WITH p AS (SELECT DISTINCT gold_answer AS part FROM eval_results WHERE gold_answer IS NOT NULL) SELECT c.chunk_id, p.part FROM chunks c JOIN p ON contains(c.chunk, p.part)")
def join1_all(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN1 with the answers of one or two words, or of signs only."""
    parts = table(spark, sf, "eval_results").select(F.col("gold_answer").alias("part")).filter("part IS NOT NULL").distinct()
    return C.contains_join(table(spark, sf, "chunks").select("chunk_id", "chunk"), parts, "chunk_id", "chunk", "part")


@query("JOIN2_left_with_default", "SELECT c.chunk_id, coalesce(m.score, 1) AS score FROM chunks c LEFT JOIN (SELECT instance_id, round(avg(score), 6) AS score FROM eval_results WHERE NOT isnan(score) GROUP BY instance_id) m USING (instance_id)")
def join2(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "eval_results").filter(~F.isnan("score")).groupBy("instance_id").agg(F.round(F.avg("score"), 6).alias("score"))
    return table(spark, sf, "chunks").select("chunk_id", "instance_id").join(m, "instance_id", "left").select("chunk_id", F.coalesce("score", F.lit(1.0)).alias("score"))


@query("JOIN3_inner_join", "SELECT e.result_id, i.data_source AS source, i.num_questions FROM eval_results e JOIN instances i USING (instance_id)")
def join3(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "instances").select("instance_id", F.col("data_source").alias("source"), "num_questions")
    return table(spark, sf, "eval_results").join(i, "instance_id").select("result_id", "source", "num_questions")


@query(
    "JOIN4_first_match",
    r"""WITH w AS (SELECT instance_id, chunk_idx, unnest(list_distinct(regexp_extract_all(lower(coalesce(chunk, '')), '[\p{L}\p{N}_]+'))) AS word FROM chunks),
    f AS (SELECT instance_id, word, min(chunk_idx) AS first_idx FROM w GROUP BY ALL)
    SELECT e.result_id, coalesce(list_sort(list_distinct(list(f.first_idx) FILTER (WHERE f.first_idx IS NOT NULL))), [0])::VARCHAR AS evidence
    FROM (SELECT result_id, instance_id, unnest(CASE WHEN len(w) = 0 THEN [''] ELSE w END) AS word FROM (SELECT result_id, instance_id, list_distinct(regexp_extract_all(lower(coalesce(gold_answer, '')), '[\p{L}\p{N}_]+')) AS w FROM eval_results)) e
    LEFT JOIN f USING (instance_id, word) GROUP BY e.result_id""",
)
def join4(spark: SparkSession, sf: str) -> DataFrame:
    """Lowest chunk that has each word of the answer, as sorted distinct numbers; [0] without any."""
    w = table(spark, sf, "chunks").select("instance_id", "chunk_idx", F.explode(F.array_distinct(words("chunk"))).alias("word"))
    first = w.groupBy("instance_id", "word").agg(F.min("chunk_idx").alias("first_idx"))
    asked = table(spark, sf, "eval_results").select("result_id", "instance_id", F.explode_outer(F.array_distinct(words("gold_answer"))).alias("word"))
    found = asked.join(first, ["instance_id", "word"], "left").groupBy("result_id").agg(F.array_sort(F.collect_set("first_idx")).alias("s"))
    listed = F.when(F.size("s") == 0, F.array(F.lit(0))).otherwise(F.col("s"))
    return found.select("result_id", F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("evidence"))


@query("JOIN5_prefix_join", "WITH p AS (SELECT DISTINCT substr(collection_key, 1, 6) AS prefix FROM documents WHERE doc_id % 50 = 0 AND collection_key IS NOT NULL) SELECT p.prefix, count(*) AS n FROM p JOIN documents d ON starts_with(d.collection_key, p.prefix) GROUP BY p.prefix")
def join5(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that begin with a prefix: prefixes have one length each, so the join is an equi-join on that many characters."""
    d = table(spark, sf, "documents").filter("collection_key IS NOT NULL")
    p = d.filter("doc_id % 50 = 0").select(F.substring("collection_key", 1, 6).alias("prefix")).distinct()
    keys = d.groupBy(F.substring("collection_key", 1, 6).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return p.join(keys, "prefix")


@query("JOIN6_membership_semi_join", "SELECT i.instance_id FROM instances i WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.instance_id = i.instance_id AND c.lang IN ('fr', 'de'))")
def join6(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "instances").join(table(spark, sf, "chunks").filter(F.col("lang").isin("fr", "de")), "instance_id", "left_semi").select("instance_id")


@query(
    "JOIN7_inner_and_rewrite",
    """SELECT e.result_id, CASE WHEN contains(lower(e.question), 'summarize') THEN k.words ELSE e.gold_answer END AS answer FROM eval_results e
    JOIN (SELECT instance_id, string_agg(domain, ', ' ORDER BY domain) AS words FROM (SELECT DISTINCT instance_id, domain FROM chunks WHERE domain IS NOT NULL) GROUP BY instance_id) k USING (instance_id)""",
)
def join7(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "chunks").filter("domain IS NOT NULL").groupBy("instance_id").agg(F.array_join(F.array_sort(F.collect_set("domain")), ", ").alias("words"))
    rewritten = F.when(F.contains(F.lower("question"), F.lit("summarize")), F.col("words")).otherwise(F.col("gold_answer"))
    return table(spark, sf, "eval_results").join(k, "instance_id").select("result_id", rewritten.alias("answer"))


@query(
    "JOIN8_previous_answer",
    """SELECT e.result_id, p.previous FROM eval_results e LEFT JOIN (SELECT question, data_source, arg_max(predicted_answer, result_id) AS previous FROM eval_results WHERE trim(predicted_answer) <> '' GROUP BY ALL) p
    ON e.question = p.question AND e.data_source = p.data_source""",
)
def join8(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_results")
    p = C.last_wins(e.filter(F.trim("predicted_answer") != ""), ["question", "data_source"], "predicted_answer", "result_id").withColumnRenamed("predicted_answer", "previous")
    return e.select("result_id", "question", "data_source").join(p, ["question", "data_source"], "left").select("result_id", "previous")


@query("JOIN9_grouped_by_text_id", "SELECT c.instance_id, count(*) AS n, min(q.question) AS first_question FROM (SELECT DISTINCT instance_id FROM chunks) c JOIN eval_results q ON CAST(c.instance_id AS VARCHAR) = CAST(q.instance_id AS VARCHAR) GROUP BY c.instance_id")
def join9(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("instance_id", F.col("instance_id").cast("string").alias("k")).distinct()
    q = table(spark, sf, "eval_results").groupBy(F.col("instance_id").cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("question").alias("first_question"))
    return c.join(q, "k").drop("k")


@query("JOIN10_option_letter", "WITH m AS (SELECT conv_id, min_by(speaker, channel) AS letter, display_name FROM speaker_roster GROUP BY conv_id, display_name) SELECT t.line_id, m.letter FROM transcript_lines t JOIN m ON m.conv_id = t.conv_id AND m.display_name = trim(t.speaker)")
def join10(spark: SparkSession, sf: str) -> DataFrame:
    """The letter whose text equals the label."""
    m = table(spark, sf, "speaker_roster").groupBy("conv_id", "display_name").agg(F.min_by("speaker", "channel").alias("letter"))
    return table(spark, sf, "transcript_lines").select("line_id", "conv_id", F.trim("speaker").alias("display_name")).join(m, ["conv_id", "display_name"]).select("line_id", "letter")


@query("JOIN11_mapped_speakers", "SELECT t.line_id, r.display_name AS name, t.start_time FROM transcript_lines t JOIN speaker_roster r ON r.conv_id = t.conv_id AND r.speaker = upper(t.speaker)")
def join11(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "speaker_roster").select("conv_id", F.col("speaker").alias("code"), F.col("display_name").alias("name"))
    return table(spark, sf, "transcript_lines").withColumn("code", F.upper("speaker")).join(r, ["conv_id", "code"]).select("line_id", "name", "start_time")


@query(
    "JOIN12_unseen_hits",
    """WITH seen AS (SELECT DISTINCT instance_id, question FROM eval_results WHERE agent_name = 'bm25-small'),
    h AS (SELECT e.instance_id, e.result_id, row_number() OVER (PARTITION BY e.instance_id ORDER BY e.score DESC, e.result_id) AS rk FROM eval_results e
          WHERE e.score IS NOT NULL AND NOT isnan(e.score) AND e.question IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.instance_id = e.instance_id AND s.question = e.question))
    SELECT instance_id, result_id, rk FROM h WHERE rk <= 2""",
)
def join12(spark: SparkSession, sf: str) -> DataFrame:
    """The two best hits of an instance that weren't retrieved before."""
    e = table(spark, sf, "eval_results").select("instance_id", "result_id", "question", "score", "agent_name")
    fresh = e.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("question").isNotNull()).join(e.filter("agent_name = 'bm25-small'").select("instance_id", "question"), ["instance_id", "question"], "left_anti")
    return fresh.withColumn("rk", F.row_number().over(Window.partitionBy("instance_id").orderBy(F.desc("score"), "result_id"))).filter("rk <= 2").select("instance_id", "result_id", "rk")


@query("JOIN13_keep_untested", "SELECT c.chunk_id FROM chunks c LEFT JOIN (SELECT instance_id, max(CAST(score >= 0.2 AS INTEGER)) AS keep FROM eval_results WHERE NOT isnan(score) GROUP BY instance_id) t USING (instance_id) WHERE coalesce(t.keep, 1) = 1")
def join13(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "eval_results").filter(~F.isnan("score")).groupBy("instance_id").agg(F.max((F.col("score") >= 0.2).cast("int")).alias("keep"))
    return table(spark, sf, "chunks").join(t, "instance_id", "left").filter(F.coalesce("keep", F.lit(1)) == 1).select("chunk_id")


@query("JOIN14_calls_by_chunk", "SELECT c.instance_id, c.chunk_idx, count(e.result_id) AS calls FROM (SELECT DISTINCT instance_id, chunk_idx FROM chunks) c LEFT JOIN eval_results e ON e.instance_id = c.instance_id AND e.item_index = c.chunk_idx GROUP BY ALL")
def join14(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "eval_results").groupBy("instance_id", F.col("item_index").alias("chunk_idx")).agg(F.count("result_id").alias("calls"))
    spine = table(spark, sf, "chunks").select("instance_id", F.col("chunk_idx").cast("long").alias("chunk_idx")).distinct()
    return spine.join(calls, ["instance_id", "chunk_idx"], "left").select("instance_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), F.coalesce("calls", F.lit(0)).alias("calls"))


@query("JOIN15_processed_anti_join", "SELECT e.result_id FROM eval_results e WHERE NOT EXISTS (SELECT 1 FROM eval_results p WHERE p.agent_name = 'long-32b' AND p.question = e.question AND p.data_source = e.data_source)")
def join15(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_results").select("result_id", "question", "data_source", "agent_name")
    return e.join(e.filter("agent_name = 'long-32b'").select("question", "data_source"), ["question", "data_source"], "left_anti").select("result_id")


@query("JOIN16_person_dictionary", "SELECT r.conv_id, r.speaker, count(*) AS lines FROM speaker_roster r JOIN (SELECT conv_id, trim(speaker) AS name FROM transcript_lines) t ON t.conv_id = r.conv_id AND t.name = r.display_name GROUP BY ALL")
def join16(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "transcript_lines").groupBy("conv_id", F.trim("speaker").alias("display_name")).agg(F.count(F.lit(1)).alias("lines"))
    return table(spark, sf, "speaker_roster").join(t, ["conv_id", "display_name"]).groupBy("conv_id", "speaker").agg(F.sum("lines").alias("lines"))


@query("JOIN17_positional_zip", f"SELECT instance_id, CAST(qa_idx AS INTEGER) AS qa_idx, question, answer FROM {QAS}")
def join17(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "instances").withColumn("qa", F.from_json("questions_and_answers", C.QA))
    zipped = i.select("instance_id", F.posexplode(F.arrays_zip(F.col("qa.question"), F.col("qa.answer"))).alias("qa_idx", "z"))
    return zipped.select("instance_id", "qa_idx", F.col("z.question").alias("question"), F.col("z.answer").alias("answer"))


@query("JOIN18_index_gather", "SELECT e.result_id, c.chunk_id FROM eval_results e JOIN chunks c ON c.instance_id = e.instance_id AND c.chunk_idx = e.item_index % 5")
def join18(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("chunk_id", "instance_id", F.col("chunk_idx").cast("long").alias("k"))
    return table(spark, sf, "eval_results").select("result_id", "instance_id", (F.col("item_index") % 5).alias("k")).join(c, ["instance_id", "k"]).select("result_id", "chunk_id")


@query(
    "JOIN19_nearest_string",
    """WITH l AS (SELECT DISTINCT conv_id, lower(trim(speaker)) AS label FROM transcript_lines WHERE speaker IS NOT NULL)
    SELECT l.conv_id, l.label, min_by(r.speaker, levenshtein(l.label, lower(r.display_name)) * 10 + r.channel) AS nearest FROM l JOIN speaker_roster r USING (conv_id) GROUP BY ALL""",
)
def join19(spark: SparkSession, sf: str) -> DataFrame:
    """The speaker of the conversation whose name is nearest to a label by edit distance; ties go to the lower channel."""
    labels = table(spark, sf, "transcript_lines").filter("speaker IS NOT NULL").select("conv_id", F.lower(F.trim("speaker")).alias("label")).distinct()
    r = table(spark, sf, "speaker_roster").select("conv_id", F.col("speaker").alias("code"), F.lower("display_name").alias("name"), "channel")
    return labels.join(r, "conv_id").groupBy("conv_id", "label").agg(F.min_by("code", F.levenshtein("label", "name") * 10 + F.col("channel")).alias("nearest"))


@query("SET1_union_all", "SELECT 'documents' AS origin, lang, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'chunks', lang, count(*) FROM chunks GROUP BY lang")
def set1(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.lit("documents").alias("origin"), "lang")
    c = table(spark, sf, "chunks").select(F.lit("chunks").alias("origin"), "lang")
    return d.unionByName(c, allowMissingColumns=True).groupBy("origin", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SET2_difference_of_sets", "SELECT source FROM (SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM mix_targets)")
def set2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("source").distinct().exceptAll(table(spark, sf, "mix_targets").select("source").distinct())


@query("SET3_first_text_of_key", "SELECT collection_key, min_by(md5(text), doc_id) AS text_md5 FROM documents WHERE text IS NOT NULL GROUP BY collection_key")
def set3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text IS NOT NULL").groupBy("collection_key").agg(F.min_by(F.md5("text"), "doc_id").alias("text_md5"))


@query(
    "SET4_ordered_distinct_keywords",
    """SELECT result_id, array_to_string(list_filter(k, lambda x, i: NOT list_contains(list_transform(k[:i-1], lambda y: lower(y)), lower(x))), '|') AS keywords FROM (
    SELECT result_id, list_filter(list_transform(string_split(gold_answer, ','), lambda x: trim(x)), lambda x: x <> '') AS k FROM eval_results WHERE gold_answer IS NOT NULL)""",
)
def set4(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_results").filter("gold_answer IS NOT NULL").select("result_id", F.array_join(C.ordered_distinct(F.split("gold_answer", ",")), "|").alias("keywords"))


@query("SET5_identical_content_once", "SELECT source, count(DISTINCT md5(text)) AS n FROM documents WHERE text IS NOT NULL GROUP BY source")
def set5(spark: SparkSession, sf: str) -> DataFrame:
    """Inserts that aren't skipped: the first row of each (type, content)."""
    first = table(spark, sf, "documents").filter("text IS NOT NULL").select("source", F.md5("text").alias("h")).dropDuplicates(["source", "h"])
    return first.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SET6_last_answer_of_question", "SELECT question, arg_max(md5(predicted_answer), result_id) AS answer_md5 FROM eval_results WHERE question IS NOT NULL AND predicted_answer IS NOT NULL GROUP BY question")
def set6(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_results").filter("question IS NOT NULL AND predicted_answer IS NOT NULL").withColumn("answer_md5", F.md5("predicted_answer"))
    return C.last_wins(e, ["question"], "answer_md5", "result_id")


@query("SET7_conflicting_keys_removed", "SELECT question, any_value(score >= 0.5) AS flag FROM eval_results WHERE score IS NOT NULL AND NOT isnan(score) AND question IS NOT NULL GROUP BY question HAVING count(DISTINCT score >= 0.5) = 1")
def set7(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_results").filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("question").isNotNull()).withColumn("flag", F.col("score") >= 0.5)
    return e.groupBy("question").agg(F.min("flag").alias("flag"), F.max("flag").alias("high")).filter("flag = high").select("question", "flag")


@query("SET8_repeated_rows", "SELECT instance_id, copy FROM (SELECT instance_id, unnest(range(least(num_questions, 4))) AS copy FROM instances)")
def set8(spark: SparkSession, sf: str) -> DataFrame:
    return C.interleave(table(spark, sf, "instances").select("instance_id", "num_questions"), F.least("num_questions", F.lit(4).cast("long"))).select("instance_id", "copy")


@query("SET9_equal_batches", "SELECT (result_id - 1) // 1000 AS batch, count(*) AS n, min(result_id) AS first_id FROM eval_results GROUP BY 1")
def set9(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_results").groupBy(F.expr("(result_id - 1) div 1000").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("result_id").alias("first_id"))


@query("SET10_pad_to_divisor", "WITH n AS (SELECT count(*) AS n FROM instances), p AS (SELECT instance_id, row_number() OVER (ORDER BY instance_id) - 1 AS pos FROM instances) SELECT instance_id, false AS padded FROM p UNION ALL SELECT p.instance_id, true FROM p, n WHERE p.pos < (7 - n.n % 7) % 7")
def set10(spark: SparkSession, sf: str) -> DataFrame:
    """The rows and as many of the first ones again as make their number divisible by seven."""
    i = table(spark, sf, "instances").select("instance_id")
    missing = (7 - i.count() % 7) % 7
    head = i.orderBy("instance_id").limit(missing)  # fewer than the divisor
    return i.withColumn("padded", F.lit(False)).unionByName(head.withColumn("padded", F.lit(True)))


@query("SET11_folded_rows", "SELECT result_id // 8 AS fold, array_to_string(list(result_id ORDER BY result_id), ',') AS ids FROM eval_results GROUP BY 1")
def set11(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "eval_results").groupBy(F.expr("result_id div 8").alias("fold")).agg(F.array_sort(F.collect_list("result_id")).alias("i"))
    return g.select("fold", F.array_join(F.transform("i", lambda x: x.cast("string")), ",").alias("ids"))


@query("SET12_flatten_and_regroup", f"SELECT instance_id, string_agg(lower(question), '|' ORDER BY qa_idx) AS questions FROM {QAS} GROUP BY instance_id")
def set12(spark: SparkSession, sf: str) -> DataFrame:
    q = C.questions(table(spark, sf, "instances"))
    back = q.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("qa_idx", F.lower("question").alias("q")))).alias("x"))
    return back.select("instance_id", F.array_join(F.transform("x", lambda x: x["q"]), "|").alias("questions"))


_HASH = "md5(CAST({0} AS VARCHAR) || '|42')"


@query("RND1_sample_per_instance", f"SELECT result_id FROM (SELECT result_id, row_number() OVER (PARTITION BY instance_id ORDER BY {_HASH.format('result_id')}, result_id) AS k FROM eval_results) WHERE k <= 10")
def rnd1(spark: SparkSession, sf: str) -> DataFrame:
    return C.sample_per_group(table(spark, sf, "eval_results"), ["instance_id"], ["result_id"], 10).select("result_id")


@query("RND2_sample_per_source", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY {_HASH.format('doc_id')}, doc_id) AS k FROM documents) WHERE k <= 25")
def rnd2(spark: SparkSession, sf: str) -> DataFrame:
    return C.sample_per_group(table(spark, sf, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 25).select("doc_id")


@query("RND3_seeded_shuffle", f"SELECT instance_id, {_HASH.format('instance_id')} AS place FROM instances")
def rnd3(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in a range-partitioned hashed order."""
    return table(spark, sf, "instances").select("instance_id", C.hashed_order("instance_id").alias("place")).orderBy("place")


@query("RND4_template_choice", "SELECT result_id, ['Please recall: ', 'From memory: ', 'Think back: '][CAST(('0x' || substr(md5(CAST(result_id AS VARCHAR) || '|42'), 1, 6))::INTEGER % 3 AS INTEGER) + 1] || question AS question FROM eval_results")
def rnd4(spark: SparkSession, sf: str) -> DataFrame:
    pick = F.conv(F.substring(C.hashed_order("result_id"), 1, 6), 16, 10).cast("long") % 3 + 1
    template = F.element_at(F.array(F.lit("Please recall: "), F.lit("From memory: "), F.lit("Think back: ")), pick.cast("int"))
    return table(spark, sf, "eval_results").select("result_id", F.concat(template, F.col("question")).alias("question"))


@query("RND5_sample_by_ratio", f"SELECT result_id FROM (SELECT result_id, row_number() OVER (PARTITION BY instance_id ORDER BY {_HASH.format('result_id')}, result_id) AS k, count(*) OVER (PARTITION BY instance_id) AS n FROM eval_results) WHERE n <= 50 OR k <= n // 2")
def rnd5(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the results of instances with more than fifty."""
    e = table(spark, sf, "eval_results").select("result_id", "instance_id")
    w = Window.partitionBy("instance_id")
    k = e.withColumn("k", F.row_number().over(w.orderBy(C.hashed_order("result_id"), "result_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return k.filter(F.expr("n <= 50 OR k <= n div 2")).select("result_id")


@query("RND6_disjoint_samples", f"SELECT doc_id, (k - 1) // 20 AS part FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY {_HASH.format('doc_id')}, doc_id) AS k FROM documents) WHERE k <= 60")
def rnd6(spark: SparkSession, sf: str) -> DataFrame:
    """Three samples of twenty from each source without a common document."""
    sampled = C.sample_per_group(table(spark, sf, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 60)
    return sampled.select("doc_id", F.expr("(__rank - 1) div 20").alias("part"))


@query("RND7_display_shuffle", f"SELECT agent_name, arg_min(result_id, {_HASH.format('result_id')}) AS shown FROM eval_results GROUP BY agent_name")
def rnd7(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_results").groupBy("agent_name").agg(F.min_by("result_id", C.hashed_order("result_id")).alias("shown"))


@query("PAR1_mini_batches", "SELECT result_id, result_id // 32 AS batch FROM eval_results")
def par1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_results").select("result_id", F.expr("result_id div 32").alias("batch"))


@query("SNK1_standard_parquet_row", "SELECT instance_id, coalesce(sub_source, data_source) AS sub_source, md5(questions_and_answers) AS qa_md5, json_array_length(questions_and_answers) AS num_questions FROM instances")
def snk1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "instances").select("instance_id", F.coalesce("sub_source", "data_source").alias("sub_source"), F.md5("questions_and_answers").alias("qa_md5"), F.json_array_length("questions_and_answers").alias("num_questions"))


@query("SNK6_checkpoint_validation", "SELECT count(*) FILTER (WHERE question IS NULL) AS no_question, count(*) FILTER (WHERE predicted_answer IS NULL) AS no_answer, count(*) FILTER (WHERE score IS NULL) AS no_score, count(*) AS n FROM eval_results")
def snk6(spark: SparkSession, sf: str) -> DataFrame:
    missing = lambda c: F.count_if(F.col(c).isNull())
    return table(spark, sf, "eval_results").agg(missing("question").alias("no_question"), missing("predicted_answer").alias("no_answer"), missing("score").alias("no_score"), F.count(F.lit(1)).alias("n"))


@query("EXT4_shared_questions", "SELECT question FROM (SELECT DISTINCT question FROM eval_results WHERE data_source = 'qa_single' INTERSECT SELECT question FROM eval_results WHERE data_source = 'qa_multihop')")
def ext4(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_results")
    return e.filter("data_source = 'qa_single'").select("question").intersect(e.filter("data_source = 'qa_multihop'").select("question"))
