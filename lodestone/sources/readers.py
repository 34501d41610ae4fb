"""Sources and sinks with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.metrics import of_one, repaired_json

INSTANCE = T.StructType(
    [
        T.StructField("instance_id", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("questions_and_answers", T.StringType()),
        T.StructField("data_source", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of a file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; lines that aren't JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_tolerant_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """One object a line, broken lines repaired where possible; of several lines of one key the last in the file holds."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("__at"))
    parsed = F.from_json("value", schema)
    good = lines.withColumn("x", parsed)
    fixed = F.when(F.col(f"x.{key}").isNull(), F.from_json(of_one(repaired_json)("value"), schema)).otherwise(F.col("x"))
    rows = good.withColumn("x", fixed).filter(F.col(f"x.{key}").isNotNull())
    return rows.groupBy(F.col(f"x.{key}").alias("__k")).agg(F.max_by("x", "__at").alias("x")).select("x.*")


def read_speaker_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines "speaker: text" as (speaker, text); a line without a speaker is text only."""
    v = F.col("value")
    has = F.contains(v, F.lit(": "))
    return spark.read.text(path).select(F.when(has, F.substring_index(v, ": ", 1)).alias("speaker"), F.when(has, F.expr("substring(value, instr(value, ': ') + 2)")).otherwise(v).alias("text"))


def read_marked_cache(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a tick or cross before a text: (key, flag), the key being what follows the first "...". Keys with both flags are dropped."""
    v = F.regexp_replace("value", "&#39;", "'")
    rows = spark.read.text(path).select(F.trim(F.expr("substring(value, instr(value, '...') + 3)")).alias("raw"), F.startswith(v, F.lit("✓")).alias("flag"), v.alias("v")).filter(F.col("v").rlike("^[✓✗]") & F.contains("v", F.lit("...")))
    rows = rows.select(F.regexp_replace("raw", "&#39;", "'").alias("key"), "flag")
    return rows.groupBy("key").agg(F.min("flag").alias("flag"), F.max("flag").alias("other")).filter("flag = other").drop("other")


def directories_with(files: DataFrame, names: list[str]) -> DataFrame:
    """Of (path) rows, the directories that hold all of the named files."""
    parts = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), F.substring_index("path", "/", -1).alias("name"))
    return parts.filter(F.col("name").isin(*names)).groupBy("directory").agg(F.count_distinct("name").alias("n")).filter(F.col("n") == len(names)).select("directory")


def paired_files(files: DataFrame, key: str = r"(V\d+_S\d+_I\d+)_", speaker: str = r"(P\d+)\.") -> DataFrame:
    """(key, speakers) of keys with more than one file."""
    parts = files.select(F.regexp_extract("path", key, 1).alias("key"), F.regexp_extract("path", speaker, 1).alias("speaker")).filter("key <> ''")
    return parts.groupBy("key").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def prompt_and_loss_mask(rows: DataFrame, prompt: str, response: str, end: str = "<end>") -> DataFrame:
    """(tokens, mask) of prompt + response + end mark: the mask leaves out the prompt but for its last token, and the last response token."""
    p, r = F.split(prompt, " "), F.concat(F.split(response, " "), F.array(F.lit(end)))
    total = F.size(p) + F.size(r)
    mask = F.transform(F.sequence(F.lit(1), total), lambda i: ((i >= F.size(p)) & (i < total)).cast("int"))
    return rows.withColumn("tokens", F.concat(p, r)).withColumn("mask", mask)


def valid_message_order(messages: DataFrame, group: str, order: str, role: str) -> DataFrame:
    """(group, valid): roles are known and system stands first only."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(order)) == 1
    bad = ~F.col(role).isin("system", "user", "assistant", "tool") | ((F.col(role) == "system") & ~first)
    return messages.withColumn("bad", F.coalesce(bad, F.lit(True)).cast("int")).groupBy(group).agg((F.max("bad") == 0).alias("valid"))


def preference_rows(pairs: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """Two rows a pair: (prompt, response, preferred)."""
    both = F.array(F.struct(F.col(chosen).alias("response"), F.lit(True).alias("preferred")), F.struct(F.col(rejected).alias("response"), F.lit(False).alias("preferred")))
    return pairs.select(prompt, F.explode(both).alias("x")).select(prompt, "x.response", "x.preferred")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """A snapshot as Parquet by partition: Spark's commit protocol makes it appear as a whole or not at all."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
