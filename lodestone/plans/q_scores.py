"""Queries of answer scores, string functions and rewards over the evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scores as S
from lodestone.functions import text as X
from lodestone.plans.registry import query
from lodestone.session import table



def P() -> Column:  # noqa: N802
    return F.col("predicted_answer")


def G() -> Column:  # noqa: N802
    return F.col("gold_answer")


_EDGE = r"(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])"


def norm_sql(x: str) -> str:
    """normalize_answer in SQL; articles side by side share a blank, hence twice."""
    bare = f"regexp_replace(lower({x}), '[[:punct:]]', '', 'g')"
    once = rf"regexp_replace({bare}, '{_EDGE}', '\1 \3', 'g')"
    return rf"trim(regexp_replace(regexp_replace({once}, '{_EDGE}', '\1 \3', 'g'), '\s+', ' ', 'g'))"


NP, NG = norm_sql("predicted_answer"), norm_sql("gold_answer")


def _scored(name: str, score, sql: str) -> None:  # noqa: ANN001
    """A query (result_id, score) of one score over all results, with its SQL expression."""

    @query(name, f"SELECT result_id, round(CAST({sql} AS DOUBLE), 6) AS score FROM eval_results")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, "eval_results").select("result_id", F.round(score(P(), G()).cast("double"), 6).alias("score"))


def _text(name: str, tab: str, key: str, c: str, f, sql: str, where: str | None = None) -> None:  # noqa: ANN001
    """A query (key, value) of one text function over a table."""

    @query(name, f"SELECT {key}, {sql.replace('{c}', c)} AS value FROM {tab}" + (f" WHERE {where}" if where else ""))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, tab)
        return (rows.filter(where) if where else rows).select(key, f(c).alias("value"))


_F1_SQL = f"""(SELECT CASE WHEN closed OR same = 0 THEN 0 ELSE 2.0 * same / (np + ng) END FROM (
    SELECT ({NP} IN ('yes','no','noanswer') OR {NG} IN ('yes','no','noanswer')) AND {NP} <> {NG} AS closed,
        len(a) AS np, len(b) AS ng,
        coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))), 0) AS same
    FROM (SELECT list_filter(string_split({NP}, ' '), lambda t: t <> '') AS a, list_filter(string_split({NG}, ' '), lambda t: t <> '') AS b)))"""
_KW = "list_filter(list_transform(string_split(lower(gold_answer), ','), lambda k: trim(k)), lambda k: k <> '')"
_BOX = r"CASE WHEN regexp_matches({c}, '\\boxed\{[^}]*\}') THEN trim(regexp_extract({c}, '\\boxed\{([^}]*)\}', 1)) ELSE trim({c}) END"

_scored("SCO1_exact_match", S.exact_match, f"{NP} = {NG}")
_scored("SCO2_token_f1", lambda p, g: S.token_f1(p, g)["f1"], f"CASE WHEN predicted_answer IS NULL OR gold_answer IS NULL THEN (CASE WHEN coalesce({NP} IN ('yes','no','noanswer'), false) THEN NULL END) ELSE {_F1_SQL} END")
_scored("SCO3_substring_match", S.substring_match, f"contains({NP}, {NG})")
_scored("SCO9_keyword_recall", S.keyword_recall, f"CASE WHEN gold_answer IS NULL OR predicted_answer IS NULL THEN 0 WHEN len({_KW}) = 0 THEN 0 ELSE len(list_filter({_KW}, lambda k: contains(lower(predicted_answer), k))) / len({_KW}) END")
_LABEL = "regexp_replace(" + _BOX.replace("{c}", "predicted_answer") + ", '^[''\"]+|[''\"]+$', '', 'g')"
_scored("SCO10_digit_label", S.digit_label, f"(CASE WHEN regexp_matches({_LABEL}, '^[0-9]+$') THEN {_LABEL} ELSE '0' END) = trim(gold_answer)")
_scored("SCO11_containment", S.containment, "CASE WHEN coalesce(gold_answer, '') = '' THEN 1 ELSE CAST(contains(lower(predicted_answer), lower(gold_answer)) AS INTEGER) END")
_scored("SCO12_parts_containment", lambda p, g: S.any_containment(p, g, ","), f"CASE WHEN gold_answer IS NULL OR predicted_answer IS NULL OR len({_KW}) = 0 THEN 0 ELSE len(list_filter({_KW}, lambda k: contains(lower(predicted_answer), k))) / len({_KW}) END")
_scored("SCO15_all_elements", S.all_elements, f"len(list_filter({_KW}, lambda k: NOT coalesce(contains(lower(predicted_answer), k), false))) = 0")
_scored("SCO16_element_share", lambda p, g: F.try_divide(F.size(F.filter(X.keywords(F.lower(g)), lambda k: F.contains(F.lower(p), k))).cast("double"), F.size(X.keywords(F.lower(g))).cast("double")), f"CASE WHEN len({_KW}) = 0 OR predicted_answer IS NULL THEN CASE WHEN len({_KW}) = 0 THEN NULL ELSE 0 END ELSE len(list_filter({_KW}, lambda k: contains(lower(predicted_answer), k))) / len({_KW}) END")
_scored("SCO19_best_of_raw_and_parsed", lambda p, g: F.greatest(S.exact_match(p, g), S.exact_match(X.boxed(p), g)), f"greatest(CAST({NP} = {NG} AS INTEGER), CAST({norm_sql(_BOX.replace('{c}', 'predicted_answer'))} = {NG} AS INTEGER))")
_scored("SCO22_tagged_exact_match", S.tagged_exact, f"coalesce(CAST({norm_sql('regexp_extract_all(predicted_answer, ' + chr(39) + '(?s)<answer>(.*?)</answer>' + chr(39) + ', 1)[-1]')} = {NG} AS INTEGER), 0)")
_scored("SCO27_judge_label", lambda p, g: S.judge_label(p), "contains(lower(predicted_answer), 'yes') AND NOT contains(lower(predicted_answer), 'no')")
_scored("FLT10_keep_short_unanswered", lambda p, g: F.when((F.coalesce(g, F.lit("")) == "") | (F.coalesce(p, F.lit("")) == ""), 0).when((X.token_estimate(g) < 5) & ~F.contains(F.lower(p), F.lower(g)), 0).otherwise(1), "CASE WHEN coalesce(gold_answer, '') = '' OR coalesce(predicted_answer, '') = '' THEN 0 WHEN length(gold_answer) // 4 < 5 AND NOT contains(lower(predicted_answer), lower(gold_answer)) THEN 0 ELSE 1 END")
_scored("FLT11_answerable_without_context", lambda p, g: F.coalesce((F.trim(p) != "") & (F.trim(g) != "") & F.contains(F.lower(F.trim(p)), F.lower(F.trim(g))), F.lit(False)), "coalesce(trim(predicted_answer) <> '' AND trim(gold_answer) <> '' AND contains(lower(trim(predicted_answer)), lower(trim(gold_answer))), false)")

_text("STR2_normalize_answer", "eval_results", "result_id", "predicted_answer", X.normalize_answer, norm_sql("{c}"))
_text("STR3_spaced_normal", "eval_results", "result_id", "predicted_answer", X.spaced_normal, r"trim(regexp_replace(regexp_replace(lower({c}), '[[:punct:]]', ' ', 'g'), '\s+', ' ', 'g'))")
_text("STR4_strip_punctuation", "transcript_lines", "line_id", "word", X.strip_punctuation, "regexp_replace({c}, '[[:punct:]]', '', 'g')")
_text("STR1_count_words", "documents", "doc_id", "text", lambda c: F.size(X.words(c)), r"len(regexp_extract_all(lower(coalesce({c}, '')), '[\p{L}\p{N}_]+'))")
_text("STR5_backchannel_words", "transcript_lines", "line_id", "word", X.backchannel_words, "(SELECT CASE WHEN len(w) BETWEEN 1 AND 4 AND len(list_filter(w, lambda x: x NOT IN (" + ", ".join("'" + b.replace("'", "''") + "'" for b in X.BACKCHANNELS) + r"))) = 0 THEN len(w) ELSE 0 END FROM (SELECT list_filter(regexp_split_to_array(trim(regexp_replace(lower({c}), '[.,!?]', '', 'g')), '\s+'), lambda x: x <> '') AS w))")
_text("STR6_simple_token_count", "eval_results", "result_id", "predicted_answer", lambda c: F.size(X.simple_tokens(F.coalesce(F.col(c), F.lit("")))), r"len(list_filter(regexp_split_to_array(translate(lower(coalesce({c}, '')), '.,!?', '    '), '\s+'), lambda w: w <> ''))")
_text("STR7_after_answer_prefix", "eval_results", "result_id", "predicted_answer", X.after_answer_prefix, r"trim(regexp_replace(trim(CASE WHEN regexp_matches({c}, '(?i)answer:') THEN regexp_extract({c}, '(?i)answer:\s*([^\n]*)', 1) ELSE split_part({c}, chr(10), 1) END), '(?i)^(answer:\s*)+', ''))")
_text("STR8_boxed", "eval_results", "result_id", "predicted_answer", X.boxed, _BOX)
_text("STR10_after_thinking", "chunks", "chunk_id", "chunk", X.after_thinking, "(SELECT CASE WHEN contains(r, '<think>') THEN 'Empty' ELSE trim(r) END FROM (SELECT CASE WHEN contains({c}, '</think>') THEN split_part({c}, '</think>', 2) ELSE {c} END AS r))")
_text("STR21_first_tag", "chunks", "chunk_id", "chunk", lambda c: X.first_tag(c, "search"), "trim(regexp_extract({c}, '(?s)<search>(.*?)</search>', 1))")
_text("STR22_last_tag", "chunks", "chunk_id", "chunk", lambda c: X.last_tag(c, "think"), "trim(regexp_extract_all({c}, '(?s)<think>(.*?)</think>', 1)[-1])")
_text("STR23_tags_balanced", "chunks", "chunk_id", "chunk", lambda c: X.tags_balanced(c, "think"), "(length({c}) - length(replace({c}, '<think>', ''))) / 7.0 = (length({c}) - length(replace({c}, '</think>', ''))) / 8.0 AND instr({c}, '<think>') <= instr({c}, '</think>')")
_text("STR24_lines_after_facts", "chunks", "chunk_id", "chunk", X.lines_after_facts, r"regexp_replace({c}, '(\.) (\d+\. )', '\1' || chr(10) || '\2', 'g')")
_text("STR27_capitalized", "speaker_roster", "conv_id", "display_name", X.capitalized, "upper(substr({c}, 1, 1)) || lower(substr({c}, 2))")
_text("STR32_final_answer", "eval_results", "result_id", "predicted_answer", lambda c: X.final_answer(c), r"trim(regexp_replace(regexp_replace(regexp_replace(string_split({c}, '=')[-1], '\\text\{([^}]*)\}|\\textbf\{([^}]*)\}|\\boxed\{([^}]*)\}|\\overline\{([^}]*)\}', '\1\2\3\4', 'g'), '(^| )(?:an|a) | percent| dollars| units| degrees|\\\$|\$|%|\\ ', '\1', 'g'), '(\d),(\d{3})\b', '\1\2', 'g'))")
_text("STR34_last_number", "eval_results", "result_id", "predicted_answer", X.last_number, r"regexp_replace(CASE WHEN regexp_extract({c}, '####\s*(-?[0-9.,]+)', 1) <> '' THEN regexp_extract({c}, '####\s*(-?[0-9.,]+)', 1) ELSE regexp_extract_all({c}, '(-?[0-9][0-9.,]*)', 1)[-1] END, '[,.]+$|,', '', 'g')")
_text("STR35_content_hash", "documents", "doc_id", "text", lambda c: F.sha2(c, 256), "sha256({c})")
_text("STR36_safe_name", "eval_results", "result_id", "agent_name", X.safe_name, "translate({c}, '.-', '__')")
_text("MTH3_token_estimate", "chunks", "chunk_id", "chunk", X.token_estimate, "length(coalesce({c}, '')) // 4")
_text("JSN1_question_count", "instances", "instance_id", "questions_and_answers", lambda c: F.size(F.from_json(c, "array<struct<question:string,answer:string>>")), "json_array_length({c})")
_text("TOP7_tail_words", "documents", "doc_id", "text", lambda c: F.array_join(X.take_last(X.words(c), 20), " "), r"array_to_string(regexp_extract_all(lower(coalesce({c}, '')), '[\p{L}\p{N}_]+')[-20:], ' ')")
_text("TOP8_middle_words", "documents", "doc_id", "text", lambda c: F.array_join(X.take_middle(X.words(c), 10), " "), r"(SELECT CASE WHEN len(w) <= 10 THEN array_to_string(w, ' ') ELSE array_to_string(list_concat(w[:5], w[-5:]), ' ') END FROM (SELECT regexp_extract_all(lower(coalesce({c}, '')), '[\p{L}\p{N}_]+') AS w))")


@query(
    "SCO4_best_over_golds",
    f"""WITH g AS (SELECT instance_id, item_index, question, {NG} AS n FROM eval_results WHERE gold_answer IS NOT NULL),
    d AS (SELECT DISTINCT instance_id, item_index, question, n FROM g)
    SELECT e.result_id, max(CAST({norm_sql('e.predicted_answer')} = d.n AS INTEGER)) AS best FROM eval_results e
    LEFT JOIN d USING (instance_id, item_index, question) GROUP BY e.result_id""",
)
def sco4(spark: SparkSession, sf: str) -> DataFrame:
    """The best exact match over all gold answers that a question has."""
    e = table(spark, sf, "eval_results")
    golds = e.filter(G().isNotNull()).groupBy("instance_id", "item_index", "question").agg(F.collect_set(X.normalize_answer(G())).alias("golds"))
    return e.join(golds, ["instance_id", "item_index", "question"], "left").select("result_id", F.array_max(F.transform("golds", lambda g: (X.normalize_answer(P()) == g).cast("int"))).alias("best"))


@query(
    "SCO7_set_f1",
    r"""SELECT result_id, round(CASE WHEN predicted_answer IS NULL OR gold_answer IS NULL THEN NULL WHEN same = 0 THEN 0 ELSE 2.0 * same / (len(a) + len(b)) END, 6) AS score FROM (
        SELECT *, len(list_intersect(a, b)) AS same FROM (
        SELECT result_id, predicted_answer, gold_answer, list_distinct(list_filter(regexp_split_to_array(translate(lower(predicted_answer), '.,!?', '    '), '\s+'), lambda w: w <> '')) AS a,
        list_distinct(list_filter(regexp_split_to_array(translate(lower(gold_answer), '.,!?', '    '), '\s+'), lambda w: w <> '')) AS b FROM eval_results))""",
)
def sco7(spark: SparkSession, sf: str) -> DataFrame:
    both = P().isNotNull() & G().isNotNull()
    return table(spark, sf, "eval_results").select("result_id", F.when(both, F.round(S.set_f1(P(), G()), 6)).alias("score"))


@query(
    "SCO13_hierarchical_label",
    """WITH l AS (SELECT doc_id, coalesce(domain, '') || ' > ' || coalesce(source, '') || ' > ' || coalesce(lang, '') AS gold,
        coalesce(domain, '') || ' > ' || coalesce(lead(source) OVER w, '') || ' > ' || coalesce(lang, '') AS pred FROM documents WINDOW w AS (ORDER BY doc_id)),
    s AS (SELECT doc_id, [trim(x) FOR x IN string_split(lower(gold), '>')] AS g, [trim(x) FOR x IN string_split(lower(pred), '>')] AS p FROM l)
    SELECT doc_id, CAST(CASE WHEN p[1] <> g[1] THEN 0 WHEN p[2] <> g[2] THEN 0.5 WHEN p[3] <> g[3] THEN 0.8 ELSE 1 END AS DOUBLE) AS score FROM s""",
)
def sco13(spark: SparkSession, sf: str) -> DataFrame:
    """Labels domain > source > lang, the prediction having the source of the next document by number."""
    d = table(spark, sf, "documents").select("doc_id", "domain", "source", "lang")
    following = d.select((F.col("doc_id")).alias("next_id"), F.col("source").alias("next_source"))
    ranked = d.withColumn("next_id", F.col("doc_id") + 1).join(following, "next_id", "left")
    label = lambda s: F.concat(F.coalesce("domain", F.lit("")), F.lit(" > "), F.coalesce(s, F.lit("")), F.lit(" > "), F.coalesce("lang", F.lit("")))
    return ranked.select("doc_id", S.hierarchical_label(label(F.col("next_source")), label(F.col("source"))).cast("double").alias("score"))


@query(
    "SCO20_dispatch_by_source",
    f"""SELECT result_id, round(CASE
        WHEN contains(data_source, 'keyword') THEN (CASE WHEN gold_answer IS NULL OR predicted_answer IS NULL OR len({_KW}) = 0 THEN 0 ELSE len(list_filter({_KW}, lambda k: contains(lower(predicted_answer), k))) / len({_KW}) END)
        WHEN contains(data_source, 'label') THEN CAST((CASE WHEN regexp_matches(regexp_replace({_BOX.replace('{c}', 'predicted_answer')}, '^[''"]+|[''"]+$', '', 'g'), '^[0-9]+$') THEN regexp_replace({_BOX.replace('{c}', 'predicted_answer')}, '^[''"]+|[''"]+$', '', 'g') ELSE '0' END) = trim(gold_answer) AS INTEGER)
        WHEN contains(data_source, 'detective') THEN (CASE WHEN coalesce(gold_answer, '') = '' THEN 1 ELSE CAST(contains(lower(predicted_answer), lower(gold_answer)) AS INTEGER) END)
        WHEN contains(data_source, 'niah') THEN CAST(len(list_filter({_KW}, lambda k: NOT coalesce(contains(lower(predicted_answer), k), false))) = 0 AS INTEGER)
        WHEN contains(data_source, 'multihop') THEN (CASE WHEN predicted_answer IS NULL OR gold_answer IS NULL THEN NULL ELSE {_F1_SQL} END)
        ELSE CAST(contains({NP}, {NG}) AS INTEGER) END, 6) AS score FROM eval_results WHERE gold_answer IS NOT NULL AND predicted_answer IS NOT NULL""",
)
def sco20(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_results").filter(P().isNotNull() & G().isNotNull())
    return e.select("result_id", F.round(S.by_source(F.col("data_source"), P(), G()), 6).alias("score"))


@query(
    "SCO21_running_metrics",
    f"""SELECT data_source, count(*) AS n, round(avg(CAST({NP} = {NG} AS INTEGER)), 6) AS exact_match, round(avg(CAST(contains({NP}, {NG}) AS INTEGER)), 6) AS substring_match
    FROM eval_results WHERE predicted_answer IS NOT NULL AND gold_answer IS NOT NULL GROUP BY data_source""",
)
def sco21(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "eval_results").filter(P().isNotNull() & G().isNotNull())
    return e.groupBy("data_source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(S.exact_match(P(), G())), 6).alias("exact_match"), F.round(F.avg(S.substring_match(P(), G())), 6).alias("substring_match"))


@query(
    "SCO18_recall_at_k",
    """WITH q AS (SELECT DISTINCT conv_id, speaker, display_name FROM speaker_roster),
    r AS (SELECT a.conv_id, a.speaker, b.speaker AS other, row_number() OVER (PARTITION BY a.conv_id, a.speaker ORDER BY levenshtein(lower(a.display_name), lower(b.display_name)), b.speaker) AS k
          FROM q a JOIN q b ON a.conv_id = b.conv_id)
    SELECT conv_id, round(avg(CAST(k <= 1 AS INTEGER)), 6) AS recall_1, round(avg(CAST(k <= 5 AS INTEGER)), 6) AS recall_5 FROM r WHERE speaker = other GROUP BY conv_id""",
)
def sco18(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of each speaker among the names of the conversation nearest to its own by edit distance."""
    q = table(spark, sf, "speaker_roster").select("conv_id", "speaker", "display_name").distinct()
    b = q.select("conv_id", F.col("speaker").alias("other"), F.col("display_name").alias("other_name"))
    w = Window.partitionBy("conv_id", "speaker").orderBy(F.levenshtein(F.lower("display_name"), F.lower("other_name")), "other")
    hit = q.join(b, "conv_id").withColumn("k", F.row_number().over(w)).filter(F.col("speaker") == F.col("other"))
    share = lambda n: F.round(F.avg((F.col("k") <= n).cast("int")), 6)
    return hit.groupBy("conv_id").agg(share(1).alias("recall_1"), share(5).alias("recall_5"))


_MEMORY = "SELECT e.result_id, e.instance_id, e.memory_tokens, e.score, c.chunk_tokens FROM eval_results e LEFT JOIN (SELECT instance_id, sum(length(coalesce(chunk, '')) // 4) AS chunk_tokens FROM chunks GROUP BY instance_id) c USING (instance_id)"


def _with_chunk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "chunks").groupBy("instance_id").agg(F.sum(X.token_estimate("chunk")).alias("chunk_tokens"))
    return table(spark, sf, "eval_results").join(tokens, "instance_id", "left")


def compression(memory: Column, chunks: Column) -> Column:
    """1 - memory tokens / chunk tokens; null without chunk tokens."""
    return 1 - F.try_divide(memory.cast("double"), chunks.cast("double"))


@query("RWD1_compression_reward", f"SELECT result_id, round(1 - memory_tokens / nullif(chunk_tokens, 0), 6) AS reward FROM ({_MEMORY})")
def rwd1(spark: SparkSession, sf: str) -> DataFrame:
    return _with_chunk_tokens(spark, sf).select("result_id", F.round(compression(F.col("memory_tokens"), F.col("chunk_tokens")), 6).alias("reward"))


@query(
    "RWD2_total_reward",
    f"SELECT result_id, round(CAST(coalesce(score, 0) >= 0.5 AS INTEGER) + 0.05 * coalesce(1 - memory_tokens / nullif(chunk_tokens, 0), 0), 6) AS reward FROM ({_MEMORY})",
)
def rwd2(spark: SparkSession, sf: str) -> DataFrame:
    r = F.coalesce(compression(F.col("memory_tokens"), F.col("chunk_tokens")), F.lit(0.0))
    score = F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0))
    return _with_chunk_tokens(spark, sf).select("result_id", F.round((score >= 0.5).cast("int") + 0.05 * r, 6).alias("reward"))


@query(
    "RWD3_call_success_rate",
    """SELECT instance_id, round(coalesce(avg(CAST(contains(chunk, '"success": true') AS INTEGER)) FILTER (WHERE contains(chunk, '"success"')), 0), 6) AS rate FROM chunks GROUP BY instance_id""",
)
def rwd3(spark: SparkSession, sf: str) -> DataFrame:
    """Share of an instance's logged tool calls that succeeded; 0 without calls."""
    call = F.contains("chunk", F.lit('"success"'))
    ok = F.avg(F.when(call, F.contains("chunk", F.lit('"success": true')).cast("int")))
    return table(spark, sf, "chunks").groupBy("instance_id").agg(F.round(F.coalesce(ok, F.lit(0.0)), 6).alias("rate"))


@query(
    "RWD4_content_validity",
    """SELECT instance_id, round(avg(CASE WHEN chunk IS NULL OR trim(chunk) = '' THEN 0.0 WHEN length(chunk) < 20 THEN 0.0 WHEN contains(chunk, '"success": false') THEN 0.0 WHEN regexp_matches(chunk, '[.!?。]') THEN 1.0 ELSE 0.5 END), 6) AS reward FROM chunks GROUP BY instance_id""",
)
def rwd4(spark: SparkSession, sf: str) -> DataFrame:
    """A ladder of validity tests, averaged by instance."""
    c = F.col("chunk")
    verdict = F.when(c.isNull() | (F.trim(c) == ""), 0.0).when(F.length(c) < 20, 0.0).when(F.contains(c, F.lit('"success": false')), 0.0).when(c.rlike("[.!?。]"), 1.0).otherwise(0.5)
    return table(spark, sf, "chunks").groupBy("instance_id").agg(F.round(F.avg(verdict), 6).alias("reward"))


@query("RWD5_overlong_penalty", "SELECT result_id, round(least(-(length(predicted_answer) - 100) / 50.0 * 0.5, 0), 6) AS penalty FROM eval_results WHERE predicted_answer IS NOT NULL")
def rwd5(spark: SparkSession, sf: str) -> DataFrame:
    """min(-exceed / buffer * factor, 0) for lengths over 100 characters, buffer 50, factor .5."""
    return table(spark, sf, "eval_results").filter(P().isNotNull()).select("result_id", F.round(F.least(-(F.length(P()) - 100) / 50.0 * 0.5, F.lit(0.0)), 6).alias("penalty"))


@query("RWD7_last_token_position", r"SELECT result_id, len(regexp_extract_all(lower(coalesce(predicted_answer, '')), '[\p{L}\p{N}_]+')) - 1 AS position, score AS reward FROM eval_results")
def rwd7(spark: SparkSession, sf: str) -> DataFrame:
    """The place of the last response token, which carries the reward."""
    return table(spark, sf, "eval_results").select("result_id", (F.size(X.words(P())) - 1).alias("position"), F.col("score").alias("reward"))
