"""Queries of window, sequential and streaming operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import words
from lodestone.operators import advantages as A
from lodestone.operators import dialogue as D
from lodestone.plans.q_stats import r6, scored
from lodestone.plans.registry import query
from lodestone.session import table

_OK = "score IS NOT NULL AND NOT isnan(score)"
_G = "PARTITION BY instance_id, item_index"


def _adv(name: str, f, sql: str) -> None:  # noqa: ANN001
    @query(name, f"SELECT result_id, round({sql}, 8) AS advantage FROM eval_results WHERE {_OK}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return scored(spark, sf).select("result_id", F.round(f(F.col("score"), Window.partitionBy("instance_id", "item_index")), 8).alias("advantage"))


_N = f"count(*) OVER ({_G})"
_adv("WIN1_group_relative", A.group_relative, f"CASE WHEN {_N} = 1 THEN score / (1 + 1e-6) ELSE (score - avg(score) OVER ({_G})) / (stddev_samp(score) OVER ({_G}) + 1e-6) END")
_adv("WIN2_pass_at_k", lambda s, w: A.pass_at_k(s, w, "result_id"), f"CASE WHEN {_N} < 2 OR row_number() OVER ({_G} ORDER BY score DESC, result_id) > 1 THEN 0 ELSE (score - lead(score) OVER ({_G} ORDER BY score DESC, result_id)) / (stddev_samp(score) OVER ({_G}) + 1e-6) END")
_adv("WIN3_mean_baseline", A.mean_baseline, f"CASE WHEN {_N} = 1 THEN score ELSE score - avg(score) OVER ({_G}) END")
_adv("WIN4_leave_one_out", A.leave_one_out, f"CASE WHEN {_N} = 1 THEN score ELSE score * {_N} / ({_N} - 1) - avg(score) OVER ({_G}) * {_N} / ({_N} - 1) END")
_adv("WIN5_length_weighted", lambda s, w: A.length_weighted(s, F.length(F.coalesce("predicted_answer", F.lit(""))), w), f"CASE WHEN {_N} = 1 THEN score ELSE score - coalesce(sum(score * length(coalesce(predicted_answer, ''))) OVER ({_G}) / nullif(sum(length(coalesce(predicted_answer, ''))) OVER ({_G}), 0), 0) END")


@query(
    "WIN6_generalised_advantage",
    """WITH v AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS nxt FROM events WHERE value IS NOT NULL),
    d AS (SELECT *, 1.0 + 0.5 * nxt - value AS delta FROM v)
    SELECT a.event_id, round(sum(b.delta * pow(0.25, b.t - a.t)), 8) AS advantage FROM d a JOIN d b ON a.user_id = b.user_id AND b.t BETWEEN a.t AND a.t + 40 GROUP BY a.event_id""",
)
def win6(spark: SparkSession, sf: str) -> DataFrame:
    """The recursion A = delta + gamma lambda A' as a fold over each user's events, latest first (gamma .5, lambda .5)."""
    e = table(spark, sf, "events").filter("value IS NOT NULL").select("user_id", "event_id", "ts", "value")
    return A.generalised_advantage(e, "user_id", ["ts", "event_id"], "event_id", "value", 1.0, 0.5, 0.5).select("event_id", F.round("advantage", 8).alias("advantage"))


@query("WIN7_discounted_return")
def win7(spark: SparkSession, sf: str) -> DataFrame:
    """Reverse discounted sums that start anew at purchases."""
    e = table(spark, sf, "events").filter("value IS NOT NULL").select("user_id", "event_id", "ts", "value", (F.col("event_type") != "purchase").cast("int").alias("mask"))
    return A.discounted_return(e, "user_id", ["ts", "event_id"], "event_id", "value", "mask", 0.9)


@query("WIN8_remaining_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) - avg(value) OVER (PARTITION BY user_id), 9) AS advantage FROM events WHERE value IS NOT NULL")
def win8(spark: SparkSession, sf: str) -> DataFrame:
    u = Window.partitionBy("user_id")
    rest = F.sum("value").over(u.orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf, "events").filter("value IS NOT NULL").select("event_id", F.round(rest - F.avg("value").over(u), 9).alias("advantage"))


@query("WIN9_position_ids", "SELECT line_id, (sum(CAST(word <> '' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY line_id ROWS UNBOUNDED PRECEDING) - 1) * CAST(word <> '' AS INTEGER) AS position FROM transcript_lines")
def win9(spark: SparkSession, sf: str) -> DataFrame:
    m = (F.col("word") != "").cast("int")
    w = Window.partitionBy("conv_id").orderBy("line_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "transcript_lines").select("line_id", ((F.sum(m).over(w) - 1) * m).alias("position"))


@query("WIN10_until_first_end", "SELECT line_id FROM (SELECT line_id, coalesce(sum(CAST(contains(word, '?') AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM transcript_lines) WHERE ended = 0")
def win10(spark: SparkSession, sf: str) -> DataFrame:
    """Lines up to and including the first question of a conversation."""
    w = Window.partitionBy("conv_id").orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.contains("word", F.lit("?")).cast("int")).over(w), F.lit(0))
    return table(spark, sf, "transcript_lines").select("line_id", ended.alias("ended")).filter("ended = 0").select("line_id")


@query("WIN11_pads_to_the_left", "SELECT result_id, array_to_string(list_concat(list_filter(string_split(coalesce(question, ''), ' '), lambda x: x = ''), list_filter(string_split(coalesce(question, ''), ' '), lambda x: x <> '')), '_') AS padded FROM eval_results")
def win11(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split(F.coalesce("question", F.lit("")), " ")
    return table(spark, sf, "eval_results").select("result_id", F.array_join(F.concat(F.filter(parts, lambda x: x == ""), F.filter(parts, lambda x: x != "")), "_").alias("padded"))


@query("WIN12_latest_items", "SELECT instance_id, chunk_id FROM (SELECT instance_id, chunk_id, row_number() OVER (PARTITION BY instance_id ORDER BY chunk_idx DESC, chunk_id DESC) AS k FROM chunks) WHERE k <= 5")
def win12(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("instance_id").orderBy(F.desc("chunk_idx"), F.desc("chunk_id"))
    return table(spark, sf, "chunks").select("instance_id", "chunk_id", F.row_number().over(w).alias("k")).filter("k <= 5").drop("k")


@query("WIN13_day_offset", "SELECT chunk_id, strftime(DATE '2024-01-01' + CAST(chunk_idx AS INTEGER), '%Y-%m-%d') AS day FROM chunks")
def win13(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("chunk_id", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("chunk_idx")), "yyyy-MM-dd").alias("day"))


_GAP = "('0x' || substr(md5(CAST(chunk_id AS VARCHAR) || '|42'), 1, 6))::INTEGER % 3 + 1"


@query("WIN14_cumulative_gaps", f"SELECT chunk_id, CAST(sum({_GAP}) OVER (PARTITION BY instance_id ORDER BY chunk_idx, chunk_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS day FROM chunks")
def win14(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("chunk_id").cast("string"), F.lit("42"))), 1, 6), 16, 10).cast("long") % 3 + 1
    w = Window.partitionBy("instance_id").orderBy("chunk_idx", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "chunks").select("chunk_id", F.sum(gap).over(w).alias("day"))


@query("WIN15_threshold_split", "SELECT instance_id, CASE WHEN count(*) > 12 THEN 'test' ELSE 'train' END AS split FROM chunks GROUP BY instance_id")
def win15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").groupBy("instance_id").agg(F.when(F.count(F.lit(1)) > 12, "test").otherwise("train").alias("split"))


_SEG = "(SELECT DISTINCT conv_id, speaker, CAST(round(start_time * 1000) AS BIGINT) AS s, CAST(round(end_time * 1000) AS BIGINT) AS e FROM diar_segments WHERE isfinite(start_time) AND isfinite(end_time) AND round(end_time * 1000) > round(start_time * 1000))"


@query(
    "WIN16_speaker_sessions",
    f"""WITH l AS (SELECT *, lag(e) OVER (PARTITION BY conv_id, speaker ORDER BY s, e) AS p FROM {_SEG}),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p >= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM l)
    SELECT conv_id, speaker, min(s) AS start_ms, arg_max(e, s * 10000000000 + e) AS end_ms, count(*) AS pieces FROM g GROUP BY conv_id, speaker, g""",
)
def win16(spark: SparkSession, sf: str) -> DataFrame:
    return D.sessions(D.valid_segments(table(spark, sf, "diar_segments")), 500)


@query(
    "WIN17_sessions_in_global_order",
    f"""WITH l AS (SELECT *, lag(e) OVER w AS p, lag(speaker) OVER w AS ps FROM {_SEG} WINDOW w AS (PARTITION BY conv_id ORDER BY s, e, speaker)),
    g AS (SELECT *, sum(CASE WHEN ps IS NOT NULL AND ps = speaker AND s - p < 500 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY s, e, speaker ROWS UNBOUNDED PRECEDING) AS g FROM l)
    SELECT conv_id, min(speaker) AS speaker, min(s) AS start_ms, count(*) AS pieces FROM g GROUP BY conv_id, g""",
)
def win17(spark: SparkSession, sf: str) -> DataFrame:
    return D.global_sessions(D.valid_segments(table(spark, sf, "diar_segments")), 500)


@query(
    "WIN18_backchannels",
    """WITH t AS (SELECT line_id, conv_id, lower(trim(word)) IN ('yeah', 'yes', 'right', 'okay', 'sure', 'ja', 'oui', 'genau', 'gut') AS short, start_time, end_time, lag(end_time, 1, 0.0) OVER w AS before, lead(start_time) OVER w AS after, max(end_time) OVER (PARTITION BY conv_id) AS conv_end
    FROM transcript_lines WHERE start_time IS NOT NULL AND end_time IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY start_time, line_id))
    SELECT line_id FROM t WHERE short AND start_time - coalesce(before, 0) >= 0.2 AND coalesce(after, conv_end) - end_time >= 0.2""",
)
def win18(spark: SparkSession, sf: str) -> DataFrame:
    """Short listener responses with silence before and after."""
    w = Window.partitionBy("conv_id").orderBy("start_time", "line_id")
    t = table(spark, sf, "transcript_lines").filter("start_time IS NOT NULL AND end_time IS NOT NULL")
    short = F.lower(F.trim("word")).isin("yeah", "yes", "right", "okay", "sure", "ja", "oui", "genau", "gut")
    t = t.select("line_id", short.alias("short"), "start_time", "end_time", F.coalesce(F.lag("end_time").over(w), F.lit(0.0)).alias("before"), F.coalesce(F.lead("start_time").over(w), F.max("end_time").over(Window.partitionBy("conv_id"))).alias("after"))
    return t.filter("short AND start_time - before >= 0.2 AND after - end_time >= 0.2").select("line_id")


@query(
    "WIN19_backchannels_between_backchannels",
    """WITH t AS (SELECT line_id, turn_type = 'BACKCHANNEL' AS b, lag(turn_type) OVER w AS p, lead(turn_type) OVER w AS n, start_time, lag(end_time) OVER w AS pe FROM transcript_lines WHERE start_time IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY start_time, line_id))
    SELECT line_id FROM t WHERE b AND (p IS NULL OR n IS NULL OR p = 'BACKCHANNEL' OR n = 'BACKCHANNEL' OR start_time - pe >= 0.2)""",
)
def win19(spark: SparkSession, sf: str) -> DataFrame:
    """The silence test is waived at borders and beside other backchannels."""
    w = Window.partitionBy("conv_id").orderBy("start_time", "line_id")
    t = table(spark, sf, "transcript_lines").filter("start_time IS NOT NULL")
    t = t.select("line_id", (F.col("turn_type") == "BACKCHANNEL").alias("b"), F.lag("turn_type").over(w).alias("p"), F.lead("turn_type").over(w).alias("n"), "start_time", F.lag("end_time").over(w).alias("pe"))
    return t.filter("b AND (p IS NULL OR n IS NULL OR p = 'BACKCHANNEL' OR n = 'BACKCHANNEL' OR start_time - pe >= 0.2)").select("line_id")


@query(
    "WIN20_contained_turns_removed",
    f"SELECT conv_id, speaker, s AS start_ms, e AS end_ms FROM (SELECT *, max(e) OVER (PARTITION BY conv_id ORDER BY s, e DESC, speaker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {_SEG}) WHERE m IS NULL OR e > m",
)
def win20(spark: SparkSession, sf: str) -> DataFrame:
    return D.drop_contained(D.valid_segments(table(spark, sf, "diar_segments")))


@query("WIN21_merged_turns")
def win21(spark: SparkSession, sf: str) -> DataFrame:
    return D.merge_turns(table(spark, sf, "transcript_lines"), 5.0)


@query("WIN22_merged_turns_by_reach")
def win22(spark: SparkSession, sf: str) -> DataFrame:
    return D.merge_turns(table(spark, sf, "transcript_lines"), 5.0, by_reach=True)


@query(
    "WIN23_frame_runs",
    """WITH f AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS frame FROM events),
    g AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS g FROM f)
    SELECT user_id, min(frame) AS first_frame, max(frame) + 1 AS end_frame FROM g GROUP BY user_id, g""",
)
def win23(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of consecutive active frames (hours) of a user."""
    f = table(spark, sf, "events").select("user_id", F.expr("unix_seconds(cast(ts as timestamp)) div 3600").alias("frame")).distinct()
    g = f.withColumn("g", F.col("frame") - F.row_number().over(Window.partitionBy("user_id").orderBy("frame")))
    return g.groupBy("user_id", "g").agg(F.min("frame").alias("first_frame"), (F.max("frame") + 1).alias("end_frame")).drop("g")


@query(
    "WIN24_turn_typing",
    """SELECT line_id, CASE WHEN lead(start_time) OVER w < end_time - 0.5 THEN 'YIELD' WHEN start_time < lag(end_time) OVER w - 0.5 THEN 'INTERRUPT' ELSE 'NORMAL' END AS kind, lag(line_id) OVER w AS previous_id
    FROM transcript_lines WHERE start_time IS NOT NULL AND end_time IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY start_time, line_id)""",
)
def win24(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("start_time", "line_id")
    kind = F.when(F.lead("start_time").over(w) < F.col("end_time") - 0.5, "YIELD").when(F.col("start_time") < F.lag("end_time").over(w) - 0.5, "INTERRUPT").otherwise("NORMAL")
    return table(spark, sf, "transcript_lines").filter("start_time IS NOT NULL AND end_time IS NOT NULL").select("line_id", kind.alias("kind"), F.lag("line_id").over(w).alias("previous_id"))


@query(
    "WIN25_untimed_lines_attached",
    """WITH g AS (SELECT *, count(start_time) OVER (PARTITION BY conv_id ORDER BY line_id ROWS UNBOUNDED PRECEDING) AS g FROM transcript_lines)
    SELECT conv_id, g, min(start_time) AS start_time, string_agg(word, ' ' ORDER BY line_id) AS text FROM g WHERE g > 0 GROUP BY conv_id, g""",
)
def win25(spark: SparkSession, sf: str) -> DataFrame:
    """Lines without a time go to the last line that has one; those before the first are dropped."""
    w = Window.partitionBy("conv_id").orderBy("line_id").rowsBetween(Window.unboundedPreceding, 0)
    g = table(spark, sf, "transcript_lines").withColumn("g", F.count("start_time").over(w)).filter("g > 0")
    said = F.array_sort(F.collect_list(F.struct("line_id", "word")))
    return g.groupBy("conv_id", "g").agg(F.min("start_time").alias("start_time"), said.alias("x")).select("conv_id", "g", "start_time", F.array_join(F.transform("x", lambda x: x["word"]), " ").alias("text"))


@query("WIN26_long_word_splits")
def win26(spark: SparkSession, sf: str) -> DataFrame:
    return D.split_at_gaps(table(spark, sf, "transcript_lines"), 6.0, 0.2)


@query("WIN27_first_source_of_index", "SELECT item_index, arg_min(data_source, result_id) AS source FROM eval_results GROUP BY item_index")
def win27(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_results").groupBy("item_index").agg(F.min_by("data_source", "result_id").alias("source"))


@query("WIN28_collapsed_runs", "SELECT line_id FROM (SELECT line_id, turn_type, lag(turn_type) OVER (PARTITION BY conv_id ORDER BY line_id) AS p FROM transcript_lines) WHERE NOT coalesce(turn_type = 'BACKCHANNEL' AND p = 'BACKCHANNEL', false)")
def win28(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("line_id")
    again = (F.col("turn_type") == "BACKCHANNEL") & (F.lag("turn_type").over(w) == "BACKCHANNEL")
    return table(spark, sf, "transcript_lines").select("line_id", F.coalesce(again, F.lit(False)).alias("again")).filter("NOT again").select("line_id")


@query("SPK3_minimum_speech", f"SELECT conv_id, speaker, sum(e - s)::BIGINT AS ms FROM {_SEG} GROUP BY conv_id, speaker HAVING sum(e - s) >= 4000")
def spk3(spark: SparkSession, sf: str) -> DataFrame:
    return D.valid_segments(table(spark, sf, "diar_segments")).groupBy("conv_id", "speaker").agg(F.sum(F.col("e") - F.col("s")).alias("ms")).filter("ms >= 4000")


@query("SPK4_text_of_speaker", "SELECT conv_id, upper(speaker) AS speaker, md5(string_agg(word, ' ' ORDER BY line_id)) AS text_md5 FROM transcript_lines WHERE length(speaker) = 1 GROUP BY ALL")
def spk4(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "transcript_lines").filter("length(speaker) = 1").groupBy("conv_id", F.upper("speaker").alias("speaker")).agg(F.array_sort(F.collect_list(F.struct("line_id", "word"))).alias("x"))
    return t.select("conv_id", "speaker", F.md5(F.array_join(F.transform("x", lambda x: x["word"]), " ")).alias("text_md5"))


@query("SPK5_tracks", "SELECT line_id, CASE WHEN upper(t.speaker) = 'A' THEN 'left' ELSE 'right' END AS track, r.display_name AS name FROM transcript_lines t JOIN speaker_roster r ON r.conv_id = t.conv_id AND r.speaker = upper(t.speaker) WHERE upper(t.speaker) IN ('A', 'B')")
def spk5(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "transcript_lines").select("line_id", "conv_id", F.upper("speaker").alias("speaker")).filter("speaker IN ('A', 'B')")
    return t.join(table(spark, sf, "speaker_roster"), ["conv_id", "speaker"]).select("line_id", F.when(F.col("speaker") == "A", "left").otherwise("right").alias("track"), F.col("display_name").alias("name"))


@query("SPK1_online_speakers")
def spk1(spark: SparkSession, sf: str) -> DataFrame:
    return D.online_speakers(table(spark, sf, "embeddings"), 0.7)


@query("MTH8_packed_turn_id", "SELECT line_id, (conv_id::BIGINT << 34) | (CASE turn_type WHEN 'INTERRUPT' THEN 1 WHEN 'OVERLAP' THEN 2 WHEN 'BACKCHANNEL' THEN 3 ELSE 0 END::BIGINT << 30) | (line_id & 536870911) AS turn_id FROM transcript_lines")
def mth8(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("turn_type") == "INTERRUPT", 1).when(F.col("turn_type") == "OVERLAP", 2).when(F.col("turn_type") == "BACKCHANNEL", 3).otherwise(0).cast("long")
    packed = F.shiftleft("conv_id", 34).bitwiseOR(F.shiftleft(kind, 30)).bitwiseOR(F.col("line_id").bitwiseAND(536870911))
    return table(spark, sf, "transcript_lines").select("line_id", packed.alias("turn_id"))


@query("MTH4_divergence_estimates", "SELECT result_id, round(d, 6) AS k1, round(abs(d), 6) AS k_abs, round(0.5 * d * d, 10) AS k2, round(greatest(least(exp(greatest(least(-d, 20), -20)) + d - 1, 10), -10), 6) AS k3 FROM (SELECT result_id, score - memory_tokens / 1000.0 AS d FROM eval_results WHERE score IS NOT NULL AND NOT isnan(score) AND memory_tokens IS NOT NULL)")
def mth4(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("d")
    e = scored(spark, sf).filter("memory_tokens IS NOT NULL").select("result_id", (F.col("score") - F.col("memory_tokens") / 1000.0).alias("d"))
    k1, k_abs, k2, k3 = A.divergence(d)
    return e.select("result_id", r6(k1).alias("k1"), r6(k_abs).alias("k_abs"), F.round(k2, 10).alias("k2"), r6(k3).alias("k3"))


@query("MTH5_clipped_objective", "SELECT result_id, round(greatest(-a * ratio, -a * greatest(least(ratio, 1.2), 0.8)), 6) AS loss FROM (SELECT result_id, score - 0.5 AS a, exp(score - 0.5) AS ratio FROM eval_results WHERE score IS NOT NULL AND NOT isnan(score))")
def mth5(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("score") - 0.5
    return scored(spark, sf).select("result_id", r6(A.clipped_loss(a, F.exp(a), 0.2)).alias("loss"))


@query("MTH6_loss_aggregation", "WITH s AS (SELECT instance_id, sum(score) AS total, avg(score) AS mean, count(*) AS n FROM eval_results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY instance_id) SELECT round(sum(total) / sum(n), 6) AS token_mean, round(avg(total), 6) AS seq_mean_token_sum, round(avg(mean), 6) AS seq_mean_token_mean FROM s")
def mth6(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).groupBy("instance_id").agg(F.sum("score").alias("total"), F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    return s.agg(r6(F.sum("total") / F.sum("n")).alias("token_mean"), r6(F.avg("total")).alias("seq_mean_token_sum"), r6(F.avg("mean")).alias("seq_mean_token_mean"))


@query("MTH7_value_loss", "SELECT result_id, round(0.5 * greatest(pow(v - score, 2), pow(greatest(least(v, 0.7), 0.3) - score, 2)), 10) AS loss FROM (SELECT result_id, score, memory_tokens / 1000.0 AS v FROM eval_results WHERE score IS NOT NULL AND NOT isnan(score) AND memory_tokens IS NOT NULL)")
def mth7(spark: SparkSession, sf: str) -> DataFrame:
    v, s = F.col("memory_tokens") / 1000.0, F.col("score")
    clipped = F.greatest(F.least(v, F.lit(0.7)), F.lit(0.3))
    return scored(spark, sf).filter("memory_tokens IS NOT NULL").select("result_id", F.round(0.5 * F.greatest((v - s) * (v - s), (clipped - s) * (clipped - s)), 10).alias("loss"))


@query("MTH10_penalised_reward", "SELECT result_id, round(score - 0.1 * abs(score - 0.5), 6) AS reward FROM eval_results WHERE score IS NOT NULL AND NOT isnan(score)")
def mth10(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("result_id", r6(F.col("score") - 0.1 * F.abs(F.col("score") - 0.5)).alias("reward"))


@query("ARR2_padded_sequences", r"SELECT result_id, array_to_string(list_resize(regexp_extract_all(lower(coalesce(question, '')), '[\p{L}\p{N}_]+'), 12, '<pad>'), ' ') AS padded FROM eval_results")
def arr2(spark: SparkSession, sf: str) -> DataFrame:
    w = words("question")
    padded = F.slice(F.concat(w, F.array_repeat(F.lit("<pad>"), 12)), 1, 12)
    return table(spark, sf, "eval_results").select("result_id", F.array_join(padded, " ").alias("padded"))


@query("STM1_tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stm1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("STM2_sliding_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def stm2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query(
    "STM3_session_window",
    """WITH g AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
    SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g""",
)
def stm3(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")
