"""Queries of operators that SQL doesn't express, or only in part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import metrics as X
from lodestone.functions.registry import ADVANTAGES, SCORES
from lodestone.functions.text import capitalized, normalize_answer, token_estimate, words
from lodestone.operators import chunking as K
from lodestone.operators import corpus as C
from lodestone.plans.q_retrieval import operation_log
from lodestone.plans.q_stats import r6, scored
from lodestone.plans.registry import query
from lodestone.session import shared_folder, table
from lodestone.sources import readers as S

P, G = "predicted_answer", "gold_answer"


def _metric(name: str, f, one: bool = False, kind: str = "double") -> None:  # noqa: ANN001
    @query(name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        column = X.of_one(f, kind)(P) if one else X.of_two(f, kind)(P, G)
        return table(spark, sf, "eval_results").select("result_id", (F.round(column, 6) if kind == "double" else column).alias("value"))


_metric("SCO5_rouge_l", X.rouge_l)
_metric("SCO6_rouge_mean", X.rouge_mean)
_metric("SCO8_bleu", X.bleu)
_metric("SCO23_objectives", X.objectives_score)
_metric("SCO25_math_equality", X.same_math)
_metric("STR9_balanced_box", X.balanced_box, True, "string")
_metric("STR33_plain_latex", X.plain_latex, True, "string")


def _chunk_text(name: str, f) -> None:  # noqa: ANN001
    @query(name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, "chunks").select("chunk_id", X.of_one(f)("chunk").alias("value"))


_chunk_text("STR16_json_object", X.json_object)
_chunk_text("JSN2_repaired_json", lambda t: X.repaired_json(X.json_object(t)))


@query("SCO24_trajectory_metrics")
def sco24(spark: SparkSession, sf: str) -> DataFrame:
    """Longest step and dependency of tagged trajectories."""
    steps = F.regexp_extract_all("chunk", F.lit(r"(?s)<(?:think|search|information)>(.*?)</"), F.lit(1))
    sizes = F.transform(steps, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")))
    c = table(spark, sf, "chunks").select("chunk_id", sizes.alias("n")).filter(F.size("n") > 0)
    folded = F.aggregate("n", F.struct(F.lit(0).alias("before"), F.lit(0).alias("total")), lambda a, n: F.struct((a["before"] + n).alias("before"), (a["total"] + a["before"]).alias("total")))
    return c.select("chunk_id", F.array_max("n").alias("peak"), folded["total"].alias("dependency"))


@query(
    "SCO14_multi_label_f1",
    """WITH k AS (SELECT instance_id, list_sort(list(DISTINCT domain)) AS g, list_sort(list(DISTINCT domain) FILTER (WHERE chunk_idx < 3)) AS p FROM chunks WHERE domain IS NOT NULL GROUP BY instance_id)
    SELECT instance_id, round(CASE WHEN p IS NULL THEN 0 ELSE 2.0 * len(list_intersect(p, g)) / len(p) * len(list_intersect(p, g)) / len(g) / (1.0 * len(list_intersect(p, g)) / len(p) + 1.0 * len(list_intersect(p, g)) / len(g) + 1e-5) END, 5) AS f1 FROM k""",
)
def sco14(spark: SparkSession, sf: str) -> DataFrame:
    """The domains of the first three chunks against those of all."""
    c = table(spark, sf, "chunks").filter("domain IS NOT NULL")
    k = c.groupBy("instance_id").agg(F.collect_set("domain").alias("g"), F.collect_set(F.when(F.col("chunk_idx") < 3, F.col("domain"))).alias("p"))
    same = F.size(F.array_intersect("p", "g")).cast("double")
    pr, rc = F.coalesce(F.try_divide(same, F.size("p").cast("double")), F.lit(0.0)), same / F.size("g")
    return k.select("instance_id", F.round(2 * pr * rc / (pr + rc + 1e-5), 5).alias("f1"))


@query("SCO17_choice_score", "SELECT result_id, CAST(greatest(CAST(lower(trim(predicted_answer)) = lower(trim(gold_answer)) AS INTEGER), CAST(contains(lower(predicted_answer), lower(gold_answer)) AS INTEGER)) AS INTEGER) AS score FROM eval_results WHERE predicted_answer IS NOT NULL AND gold_answer IS NOT NULL")
def sco17(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_results").filter(F.col(P).isNotNull() & F.col(G).isNotNull())
    same = F.lower(F.trim(P)) == F.lower(F.trim(G))
    return e.select("result_id", F.greatest(same.cast("int"), F.contains(F.lower(P), F.lower(G)).cast("int")).alias("score"))


@query("SCO28_registered_scores", None)
def sco28(spark: SparkSession, sf: str) -> DataFrame:
    """Every registered score, with 0 for what has none."""
    e = table(spark, sf, "eval_results")
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(f(F.col(P), F.col(G)).cast("double"), F.lit(0.0)).alias("value")) for n, f in SCORES.items()])
    return e.select("result_id", F.explode(entries).alias("s")).groupBy("s.name").agg(r6(F.avg("s.value")).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("UDF2_registered_advantages", None)
def udf2(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("instance_id", "item_index")
    return scored(spark, sf).select("result_id", *[F.round(f(F.col("score"), w), 6).alias(n) for n, f in ADVANTAGES.items()])


@query("STR11_clean_lines", r"SELECT result_id, trim(regexp_replace(regexp_replace(regexp_replace(predicted_answer, '\([^)]*\)', '', 'g'), '^\s*\d+[.)]\s*', ''), '\s+', ' ', 'g')) AS value FROM eval_results")
def str11(spark: SparkSession, sf: str) -> DataFrame:
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(P, r"\([^)]*\)", ""), r"^\s*\d+[.)]\s*", ""), r"\s+", " ")
    return table(spark, sf, "eval_results").select("result_id", F.trim(x).alias("value"))


@query("STR12_last_segment", "SELECT doc_id, trim(translate(string_split(collection_key, '-')[-1], '_->', '   ')) AS value FROM documents WHERE collection_key IS NOT NULL")
def str12(spark: SparkSession, sf: str) -> DataFrame:
    x = F.translate(F.element_at(F.split("collection_key", "-"), -1), "_->", "   ")
    return table(spark, sf, "documents").filter("collection_key IS NOT NULL").select("doc_id", F.trim(x).alias("value"))


@query("STR13_list_entries", r"SELECT result_id, len(list_filter(string_split(replace(predicted_answer, ',', chr(10)), chr(10)), lambda x: trim(x) <> '')) AS entries FROM eval_results WHERE predicted_answer IS NOT NULL")
def str13(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_results").filter(F.col(P).isNotNull())
    return e.select("result_id", F.size(F.filter(F.split(F.replace(P, F.lit(","), F.lit("\n")), "\n"), lambda x: F.trim(x) != "")).alias("entries"))


@query("STR14_tool_calls", r"""SELECT chunk_id, array_to_string(regexp_extract_all(chunk, '"memory_type": "([a-z]+)"', 1), ',') AS types, len(regexp_extract_all(chunk, '"success": (true|false)', 1)) AS calls FROM chunks WHERE contains(chunk, '"memory_type"')""")
def str14(spark: SparkSession, sf: str) -> DataFrame:
    every = lambda p: F.regexp_extract_all("chunk", F.lit(p), F.lit(1))
    c = table(spark, sf, "chunks").filter(F.contains("chunk", F.lit('"memory_type"')))
    return c.select("chunk_id", F.array_join(every(r'"memory_type": "([a-z]+)"'), ",").alias("types"), F.size(every(r'"success": (true|false)')).alias("calls"))


@query("STR15_cut_after_last_brace", r"SELECT chunk_id, regexp_replace(chunk, '(?s)([}\]])[^}\]]*$', '\1') AS value FROM chunks WHERE contains(chunk, '}')")
def str15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").filter(F.contains("chunk", F.lit("}"))).select("chunk_id", F.regexp_replace("chunk", r"(?s)([}\]])[^}\]]*$", "$1").alias("value"))


@query("STR17_quoted_values", r"""SELECT chunk_id, regexp_replace(chunk, '(": )([a-zA-Z][a-zA-Z ]*)([,}])', '\1"\2"\3', 'g') AS value FROM chunks WHERE contains(chunk, '": ')""")
def str17(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").filter(F.contains("chunk", F.lit('": '))).select("chunk_id", F.regexp_replace("chunk", r'(": )([a-zA-Z][a-zA-Z ]*)([,}])', '$1"$2"$3').alias("value"))


@query("STR18_thought_and_answer", "SELECT chunk_id, trim(regexp_extract(chunk, '(?s)<think>(.*?)</think>', 1)) AS thought, trim(regexp_extract(chunk, '(?s)<answer>(.*?)</answer>', 1)) AS answer FROM chunks WHERE contains(chunk, '<think>')")
def str18(spark: SparkSession, sf: str) -> DataFrame:
    body = lambda t: F.trim(F.regexp_extract("chunk", rf"(?s)<{t}>(.*?)</{t}>", 1))
    return table(spark, sf, "chunks").filter(F.contains("chunk", F.lit("<think>"))).select("chunk_id", body("think").alias("thought"), body("answer").alias("answer"))


@query("STR19_logged_json", r"""SELECT chunk_id, regexp_extract(chunk, '"content": "([^"]*)"', 1) AS content FROM chunks WHERE starts_with(chunk, '{')""")
def str19(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").filter(F.startswith("chunk", F.lit("{"))).select("chunk_id", F.regexp_extract("chunk", r'"content": "([^"]*)"', 1).alias("content"))


@query("STR20_verdicts", "SELECT chunk_id, CASE WHEN contains(chunk, '\"success\": true') AND NOT contains(chunk, '\"success\": false') THEN 1.0 ELSE 0.0 END AS verdict FROM chunks WHERE contains(chunk, '\"success\"')")
def str20(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.contains("chunk", F.lit('"success": true')) & ~F.contains("chunk", F.lit('"success": false'))
    return table(spark, sf, "chunks").filter(F.contains("chunk", F.lit('"success"'))).select("chunk_id", F.when(ok, 1.0).otherwise(0.0).alias("verdict"))


@query(
    "STR25_label_examples",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE contains(text, 'Label: ')),
    n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM l)
    SELECT doc_id, pos, regexp_replace(line, '^Sample: ', '') AS example, trim(substr(nxt, 8)) AS label FROM n WHERE starts_with(nxt, 'Label: ') AND line <> ''""",
)
def str25(spark: SparkSession, sf: str) -> DataFrame:
    """A text line followed by its label line."""
    lines = F.split("text", "\n")
    d = table(spark, sf, "documents").filter(F.contains("text", F.lit("Label: "))).select("doc_id", lines.alias("l"))
    both = F.transform(F.col("l"), lambda x, i: F.struct((i + 1).alias("pos"), x.alias("line"), F.get(F.col("l"), i + 1).alias("nxt")))
    rows = d.select("doc_id", F.explode(both).alias("b")).select("doc_id", "b.*").filter(F.startswith("nxt", F.lit("Label: ")) & (F.col("line") != ""))
    return rows.select("doc_id", "pos", F.regexp_replace("line", "^Sample: ", "").alias("example"), F.trim(F.expr("substring(nxt, 8)")).alias("label"))


@query("STR26_blocks_with_one_label", r"SELECT doc_id, len(list_filter(string_split(text, chr(10) || chr(10)), lambda b: len(regexp_extract_all(b, 'Label: ')) = 1)) AS blocks FROM documents WHERE text IS NOT NULL")
def str26(spark: SparkSession, sf: str) -> DataFrame:
    blocks = F.filter(F.split("text", "\n\n"), lambda b: F.size(F.regexp_extract_all(b, F.lit("Label: "), F.lit(0))) == 1)
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.size(blocks).alias("blocks"))


@query("STR28_retagged_dialogue", r"SELECT doc_id, regexp_replace(text, '(^|\n)([A-D]): ', '\1<Speaker \2> ', 'g') AS value FROM documents WHERE regexp_matches(text, '(^|\n)[A-D]: ')")
def str28(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter(F.col("text").rlike(r"(^|\n)[A-D]: "))
    return d.select("doc_id", F.regexp_replace("text", r"(^|\n)([A-D]): ", "$1<Speaker $2> ").alias("value"))


@query("STR29_messages_with_one_colon", "SELECT line_id, split_part(word, ': ', 1) AS who, split_part(word, ': ', 2) AS what FROM transcript_lines WHERE len(string_split(word, ': ')) = 2")
def str29(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "transcript_lines").withColumn("p", F.split("word", ": ")).filter(F.size("p") == 2)
    return t.select("line_id", F.col("p")[0].alias("who"), F.col("p")[1].alias("what"))


@query("STR30_reference_ids", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\[([0-9a-f]{4})\]', 1), ',') AS ids FROM documents WHERE regexp_matches(text, '\[[0-9a-f]{4}\]')")
def str30(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter(F.col("text").rlike(r"\[[0-9a-f]{4}\]"))
    return d.select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(r"\[([0-9a-f]{4})\]"), F.lit(1)), ",").alias("ids"))


@query("STR31_numbered_passages", "SELECT instance_id, string_agg('Doc ' || n || ' (Title: ' || split_part(coalesce(chunk, ''), chr(10), 1) || ')', chr(10) ORDER BY n) AS passages FROM (SELECT instance_id, chunk, row_number() OVER (PARTITION BY instance_id ORDER BY chunk_idx, chunk_id) AS n FROM chunks) WHERE n <= 3 GROUP BY instance_id")
def str31(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("instance_id").orderBy("chunk_idx", "chunk_id")
    c = table(spark, sf, "chunks").select("instance_id", "chunk", F.row_number().over(w).alias("n")).filter("n <= 3")
    line = F.concat(F.lit("Doc "), F.col("n").cast("string"), F.lit(" (Title: "), F.substring_index(F.coalesce("chunk", F.lit("")), "\n", 1), F.lit(")"))
    g = c.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("x"))
    return g.select("instance_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("passages"))


@query("MAP1_merged_maps", "SELECT instance_id, json_extract_string(metadata, '$.domain') AS domain, json_extract_string(metadata, '$.book_title') AS book_title FROM instances")
def map1(spark: SparkSession, sf: str) -> DataFrame:
    m = F.from_json("metadata", "map<string,string>")
    return table(spark, sf, "instances").select("instance_id", F.try_element_at(m, F.lit("domain")).alias("domain"), F.try_element_at(m, F.lit("book_title")).alias("book_title"))


@query("MAP2_transposed_records", "SELECT data_source, string_agg(instance_id, ',' ORDER BY instance_id) AS ids, string_agg(num_chunks, ',' ORDER BY instance_id) AS sizes FROM instances WHERE num_chunks IS NOT NULL GROUP BY data_source")
def map2(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "instances").filter("num_chunks IS NOT NULL").groupBy("data_source").agg(F.array_sort(F.collect_list(F.struct("instance_id", "num_chunks"))).alias("x"))
    joined = lambda c: F.array_join(F.transform("x", lambda x: x[c].cast("string")), ",")
    return g.select("data_source", joined("instance_id").alias("ids"), joined("num_chunks").alias("sizes"))


@query("ARR1_array_functions", r"SELECT result_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(question, '')), '[\p{L}\p{N}_]+'))), ' ') AS sorted_words FROM eval_results WHERE NOT regexp_matches(coalesce(question, ''), '[^\x00-\x7F]')")
def arr1(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_results").filter(~F.coalesce("question", F.lit("")).rlike(r"[^\x00-\x7F]"))
    return e.select("result_id", F.array_join(F.array_sort(F.array_distinct(words("question"))), " ").alias("sorted_words"))


@query("ARR1_all_questions", r"SELECT result_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(question, '')), '[\p{L}\p{N}_]+')), 'ASC', 'NULLS FIRST'), ' ') AS sorted_words FROM eval_results")
def arr1_all(spark: SparkSession, sf: str) -> DataFrame:
    """ARR1 over questions in any letters; words are in the order of their bytes."""
    return table(spark, sf, "eval_results").select("result_id", F.array_join(F.array_sort(F.array_distinct(words("question"))), " ").alias("sorted_words"))


@query("MTH9_adaptive_coefficient")
def mth9(spark: SparkSession, sf: str) -> DataFrame:
    """The coefficient after each step of an agent, multiplied by 1 + clip(divergence / target - 1, ±.2) · .1."""
    steps = scored(spark, sf).groupBy("agent_name").agg(F.array_sort(F.collect_list(F.struct("scored_at", "result_id", "score"))).alias("x"))
    error = lambda x: F.greatest(F.least(x["score"] / 0.5 - 1, F.lit(0.2)), F.lit(-0.2))
    return steps.select("agent_name", r6(F.aggregate("x", F.lit(0.1), lambda c, x: c * (1 + error(x) * 0.1))).alias("coefficient"))


@query("MTH12_entropy")
def mth12(spark: SparkSession, sf: str) -> DataFrame:
    logits = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(X.entropy(logits), 6).alias("entropy"))


@query("RWD6_resampled_by_weight")
def rwd6(spark: SparkSession, sf: str) -> DataFrame:
    """Four results of each instance drawn with probability proportional to the square of the score: the smallest exponential keys."""
    u = (F.pmod(F.xxhash64("result_id", F.lit(7)), F.lit(1_000_003)) + 0.5) / 1_000_003
    keyed = scored(spark, sf).filter("score > 0").select("instance_id", "result_id", (-F.log(u) / (F.col("score") * F.col("score"))).alias("key"))
    return keyed.withColumn("k", F.row_number().over(Window.partitionBy("instance_id").orderBy("key", "result_id"))).filter("k <= 4").select("instance_id", "result_id")


@query(
    "JOIN20_nearest_concept",
    """WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), t AS (SELECT DISTINCT source AS target FROM mix_targets)
    SELECT s.source, arg_min(t.target, levenshtein(s.source, t.target) * 1000 + ascii(t.target)) AS nearest FROM s, t GROUP BY s.source""",
)
def join20(spark: SparkSession, sf: str) -> DataFrame:
    """The listed source nearest to each source by edit distance: the list is one array, exploded beside each source."""
    t = table(spark, sf, "mix_targets").agg(F.collect_set("source").alias("targets")).first()[0]  # a fixed short list
    s = table(spark, sf, "documents").filter("source IS NOT NULL").select("source").distinct()
    pairs = s.select("source", F.explode(F.array(*[F.lit(x) for x in sorted(t)])).alias("target"))
    return pairs.groupBy("source").agg(F.min_by("target", F.levenshtein("source", "target") * 1000 + F.ascii("target")).alias("nearest"))


@query("SRC5_speaker_lines", r"SELECT doc_id, pos, split_part(line, ': ', 1) AS speaker, substr(line, instr(line, ': ') + 2) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, '^[A-D]: ')")
def src5(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).filter(F.col("line").rlike("^[A-D]: "))
    return lines.select("doc_id", (F.col("p") + 1).alias("pos"), F.substring_index("line", ": ", 1).alias("speaker"), F.expr("substring(line, instr(line, ': ') + 2)").alias("text"))


@query("SRC8_dimension_lookup", "SELECT d.doc_id, t.max_repeats FROM documents d LEFT JOIN mix_targets t USING (source)")
def src8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "mix_targets").select("source", "max_repeats"), "source", "left").select("doc_id", "max_repeats")


@query("SRC12_concatenated_scan", "SELECT 'd' AS origin, doc_id AS id FROM documents WHERE length(text) // 4 <= 500 UNION ALL SELECT 'c', chunk_id FROM chunks WHERE length(chunk) // 4 <= 500")
def src12(spark: SparkSession, sf: str) -> DataFrame:
    """Several tables as one, without rows over a token limit."""
    fits = lambda c: F.floor(F.length(c) / 4) <= 500
    d = table(spark, sf, "documents").filter(fits("text")).select(F.lit("d").alias("origin"), F.col("doc_id").alias("id"))
    return d.unionByName(table(spark, sf, "chunks").filter(fits("chunk")).select(F.lit("c").alias("origin"), F.col("chunk_id").alias("id")))


@query("SRC14_loss_masks", "SELECT result_id, len(string_split(question, ' ')) + len(string_split(gold_answer, ' ')) + 1 AS n_tokens, len(string_split(gold_answer, ' ')) + 1 AS n_trained FROM eval_results WHERE question IS NOT NULL AND gold_answer IS NOT NULL")
def src14(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_results").filter("question IS NOT NULL AND gold_answer IS NOT NULL")
    m = S.prompt_and_loss_mask(e, "question", "gold_answer")
    return m.select("result_id", F.size("tokens").alias("n_tokens"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_trained"))


@query("SRC15_valid_conversations", "SELECT conv_id, bool_and(coalesce(turn_type, 'NORMAL') IN ('NORMAL', 'OVERLAP')) AS valid FROM transcript_lines GROUP BY conv_id")
def src15(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(F.coalesce("turn_type", F.lit("NORMAL")).isin("NORMAL", "OVERLAP"), "user").otherwise("other")
    return S.valid_message_order(table(spark, sf, "transcript_lines").withColumn("role", role), "conv_id", "line_id", "role")


@query("SRC16_preference_rows", "SELECT question, gold_answer AS response, true AS preferred FROM eval_results WHERE score < 0.2 UNION ALL SELECT question, predicted_answer, false FROM eval_results WHERE score < 0.2")
def src16(spark: SparkSession, sf: str) -> DataFrame:
    return S.preference_rows(table(spark, sf, "eval_results").filter("score < 0.2"), "question", G, P)


@query("SNK5_valid_checkpoint_rows", "SELECT agent_name, count(*) AS n FROM eval_results WHERE agent_name = 'long-32b' AND question IS NOT NULL AND score BETWEEN 0 AND 1 GROUP BY agent_name")
def snk5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_results").filter("agent_name = 'long-32b' AND question IS NOT NULL AND score BETWEEN 0 AND 1").groupBy("agent_name").agg(F.count(F.lit(1)).alias("n"))


@query("CHK12_balanced_halves", "WITH t AS (SELECT instance_id, chunk_id, chunk_idx, length(coalesce(chunk, '')) // 4 AS n FROM chunks), r AS (SELECT *, sum(n) OVER (PARTITION BY instance_id ORDER BY chunk_idx, chunk_id ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY instance_id) AS total FROM t) SELECT chunk_id, CASE WHEN upto - n < total / 2.0 THEN 1 ELSE 2 END AS half FROM r")
def chk12(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("instance_id")
    t = table(spark, sf, "chunks").select("instance_id", "chunk_id", "chunk_idx", token_estimate("chunk").alias("n"))
    upto = F.sum("n").over(w.orderBy("chunk_idx", "chunk_id").rowsBetween(Window.unboundedPreceding, 0))
    return t.select("chunk_id", F.when(upto - F.col("n") < F.sum("n").over(w) / 2.0, 1).otherwise(2).alias("half"))


@query("CHK5_labelled_samples")
def chk5(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled samples in hashed order, packed into chunks of at most 2,000 characters."""
    from lodestone.operators import chunking

    return chunking.labelled_packs(table(spark, sf, "documents").filter("source = 'abstract_labels'"), "doc_id", "text", buckets=16)


@query("SPK2_names_of_clusters", "SELECT label, min(vec_id) AS first_vec, count(*) AS n FROM embeddings GROUP BY label")
def spk2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy("label").agg(F.min("vec_id").alias("first_vec"), F.count(F.lit(1)).alias("n"))


@query("AGG14b_operations_by_kind", "SELECT CASE WHEN result_id % 7 = 0 THEN 'delete' WHEN result_id % 3 = 0 THEN 'update' ELSE 'insert' END AS op, count(*) AS n FROM eval_results GROUP BY 1")
def agg14b(spark: SparkSession, sf: str) -> DataFrame:
    return operation_log(spark, sf).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("STM4_watermarked_stream")
def stm4(spark: SparkSession, sf: str) -> DataFrame:
    """The stream of events by hour with a watermark, run over all that is there."""
    return _streamed(spark, sf, "stm4", lambda e, ev: ev.windowed_counts(e), "append")


@query("STM5_stream_without_repeats")
def stm5(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, "stm5", lambda e, ev: ev.without_repeats(e).select("event_id", "event_type"), "append")


@query("STM7_stream_with_dimension")
def stm7(spark: SparkSession, sf: str) -> DataFrame:
    """Events joined with the customers of the same number."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    return _streamed(spark, sf, "stm7", lambda e, ev: ev.with_dimension(e.select("event_id", "user_id"), c, "user_id"), "append")


def _streamed(spark: SparkSession, sf: str, name: str, plan, mode: str) -> DataFrame:  # noqa: ANN001
    """Runs a plan over the events as a stream into a Parquet folder beside the checkpoints and reads that."""
    import uuid

    from lodestone.streaming import events as ev

    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    still = table(spark, sf, "events")
    still.write.parquet(f"{root}/in")
    stream = plan(ev.read_events(spark, f"{root}/in", still), ev)
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
