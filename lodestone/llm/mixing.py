"""Mixing sources to target weights.

Efraimidis-Spirakis sampling without replacement: each document draws an exponential key, -ln(u) divided by its quality
weight, and the documents of the smallest keys are taken until their tokens fill the source's budget.  u comes from a hash of
the document's id and a seed, so a run can be repeated.  A source whose budget exceeds its tokens is used whole as often as
it fits before a last, partial round is drawn.

A source may own any share of the documents, so no window runs over a whole source: keys are put into bins by a monotone
function, bins are summed with partial aggregation, and a prefix sum over the at most ``BINS`` rows of a source finds the bin
in which its budget ends. Documents of the bins before it are taken, those after it are not, and only in that one are they sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.budget import token_counts
from lodestone.session import checkpointed

#: Bins per source, by key / (1 + key): whatever the weights from 0.05 to 1, no bin holds more than about a 6,000th of a source.
BINS = 65_536


def quality(text: Column) -> Column:
    """Weight of a document from 0.05 to 1: the share of letters, digits and white space in its text."""
    plain = F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""))
    return F.greatest(F.lit(0.05), plain / F.greatest(F.char_length(text), F.lit(1)))


def _keyed(documents: DataFrame, targets: DataFrame, seed: int, path: str | None) -> DataFrame:
    """(doc_id, source, n_tokens, key, bin) of the documents of listed sources that hold tokens; written once, read twice."""
    listed = targets.select("source").distinct()
    rows = documents.select("doc_id", "source", "text", F.xxhash64("doc_id", F.lit(seed)).alias("h"), quality(F.col("text")).alias("weight")).join(listed, "source", "left_semi")
    counted = token_counts(rows, "text", path=path).filter("n_tokens > 0")
    u = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = counted.withColumn("key", -F.log(u) / F.col("weight"))
    return checkpointed(keyed.select("doc_id", "source", "n_tokens", "key", F.floor(F.col("key") / (1 + F.col("key")) * BINS).cast("int").alias("bin")))


def _plan(keyed: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget, rounds, rest): a row per listed source.

    The total is the largest at which every source that has documents can give its share within its repeats, or total_tokens;
    a source that cannot fill its budget gives all it may.
    """
    have = keyed.groupBy("source").agg(F.sum(F.col("n_tokens").cast("long")).alias("available"))
    wanted = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(have, "source", "left")
    most = F.when((F.col("available") > 0) & (F.col("target_share") > 0), F.col("available") * F.col("max_repeats") / F.col("target_share"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.min(most).over(Window.partitionBy(F.lit(1)))
    # targets is a short list of sources, so one window over it is one small task
    sized = wanted.withColumn("available", F.coalesce("available", F.lit(0))).withColumn("total", total)
    budget = F.least(F.floor(F.coalesce("total", F.lit(0.0)) * F.col("target_share") + 1e-6), F.col("available") * F.col("max_repeats")).cast("long")
    sized = sized.withColumn("budget", budget)
    rounds = F.when(F.col("available") > 0, F.expr("budget div available")).otherwise(0).cast("int")
    return sized.withColumn("rounds", rounds).withColumn("rest", F.col("budget") - F.col("rounds") * F.col("available")).drop("total")


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: int | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, n_uses): how often each document enters the mixture; documents that don't are left out.

    documents: doc_id, source, text; targets: source, target_share, max_repeats. Documents with null, empty or tokenless texts
    and of unlisted (or null) sources don't take part. Repeated rows are documents of their own. Each source's tokens come
    within one document of its budget. Ties of keys go by doc_id.
    """
    keyed = _keyed(documents, targets, seed, path)
    plan = _plan(keyed, targets, total_tokens)
    return _mixture(keyed, plan)


def _mixture(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    bins = keyed.groupBy("source", "bin").agg(F.sum(F.col("n_tokens").cast("long")).alias("in_bin"))
    below = F.coalesce(F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = bins.withColumn("below", below).join(plan.select("source", "rounds", "rest"), "source").filter("below <= rest AND rest < below + in_bin")
    # one row per source: the bin in which the last, partial round ends
    drawn = keyed.join(ends.select("source", "rounds", "rest", "below", F.col("bin").alias("last")), "source")
    whole = drawn.filter("bin != last").withColumn("n_uses", F.col("rounds") + (F.col("bin") < F.col("last")).cast("int"))
    inside = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = drawn.filter("bin = last").withColumn("upto", F.col("below") + F.sum(F.col("n_tokens").cast("long")).over(inside))
    edge = edge.withColumn("n_uses", F.col("rounds") + (F.col("upto") <= F.col("rest")).cast("int"))
    columns = ["doc_id", "source", "n_tokens", "n_uses"]
    return whole.select(columns).unionByName(edge.select(columns)).filter("n_uses > 0")


def mixture_shares(documents: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: int | None = None, path: str | None = None) -> DataFrame:
    """The report of a mixture: (source, target_share, max_repeats, available_tokens, budget_tokens, used_tokens, n_docs, most_uses, actual_share).

    One row per listed source; a source without documents has 0 tokens, and the others' shares grow in proportion.
    """
    keyed = _keyed(documents, targets, seed, path)
    plan = _plan(keyed, targets, total_tokens)
    used = _mixture(keyed, plan).groupBy("source").agg(F.sum(F.col("n_tokens").cast("long") * F.col("n_uses")).alias("used"), F.count(F.lit(1)).alias("n_docs"), F.max("n_uses").alias("most_uses"))
    report = plan.join(used, "source", "left")
    tokens = F.coalesce("used", F.lit(0))
    whole = F.sum(tokens).over(Window.partitionBy(F.lit(1)))
    return report.select(
        "source",
        "target_share",
        "max_repeats",
        F.col("available").alias("available_tokens"),
        F.col("budget").alias("budget_tokens"),
        tokens.alias("used_tokens"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.round(tokens / F.when(whole > 0, whole), 6).alias("actual_share"),
    )
