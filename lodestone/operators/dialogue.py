"""Segments, turns and speakers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.intervals import milliseconds


def valid_segments(segments: DataFrame) -> DataFrame:
    """Distinct (conv_id, speaker, s, e) in milliseconds with e after s."""
    return segments.select("conv_id", "speaker", milliseconds("start_time").alias("s"), milliseconds("end_time").alias("e")).filter("e > s").distinct()


def sessions(segments: DataFrame, gap: int) -> DataFrame:
    """Segments of a speaker joined while the next starts less than gap after the previous one's end: (conv_id, speaker, start_ms, end_ms, pieces)."""
    w = Window.partitionBy("conv_id", "speaker").orderBy("s", "e")
    new = F.lag("e").over(w).isNull() | (F.col("s") - F.lag("e").over(w) >= gap)
    g = segments.withColumn("new", new.cast("int")).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = g.groupBy("conv_id", "speaker", "g").agg(F.min("s").alias("start_ms"), F.max_by("e", F.struct("s", "e")).alias("end_ms"), F.count(F.lit(1)).alias("pieces"))
    return out.drop("g")


def global_sessions(segments: DataFrame, gap: int) -> DataFrame:
    """As sessions, but only while the previous segment of the whole conversation is the same speaker's."""
    w = Window.partitionBy("conv_id").orderBy("s", "e", "speaker")
    same = (F.lag("speaker").over(w) == F.col("speaker")) & (F.col("s") - F.lag("e").over(w) < gap)
    g = segments.withColumn("new", 1 - F.coalesce(same.cast("int"), F.lit(0))).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("conv_id", "g").agg(F.min("speaker").alias("speaker"), F.min("s").alias("start_ms"), F.count(F.lit(1)).alias("pieces")).drop("g")


def drop_contained(segments: DataFrame) -> DataFrame:
    """Segments that don't lie within one that started before: kept ones have growing ends, so a running maximum decides."""
    w = Window.partitionBy("conv_id").orderBy("s", F.desc("e"), "speaker").rowsBetween(Window.unboundedPreceding, -1)
    kept = segments.withColumn("m", F.max("e").over(w)).filter("m IS NULL OR e > m")
    return kept.select("conv_id", "speaker", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


def merge_turns(lines: DataFrame, gap: float, by_reach: bool = False) -> DataFrame:
    """Consecutive lines of one label merged while the gap to the previous end (or, by_reach, the furthest end) is smaller:
    (conv_id, speaker, start_time, end_time, n_lines). A fold over a conversation."""
    rows = lines.select("conv_id", F.upper(F.trim("speaker")).alias("speaker"), "start_time", "end_time", "line_id").filter("start_time IS NOT NULL AND end_time IS NOT NULL AND speaker IS NOT NULL")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for c, sp, s, e, _ in pdf.sort_values(["start_time", "line_id"]).itertuples(index=False):
            last = out[-1] if out else None
            if last and last[1] == sp and s - last[3] < gap:
                last[3] = max(last[3], e) if by_reach else e
                last[4] += 1
            else:
                out.append([c, sp, s, e, 1])
        return pd.DataFrame(out, columns=["conv_id", "speaker", "start_time", "end_time", "n_lines"])

    return rows.groupBy("conv_id").applyInPandas(fold, "conv_id long, speaker string, start_time double, end_time double, n_lines int")


def split_at_gaps(lines: DataFrame, longest: float, clipped: float) -> DataFrame:
    """Pieces of a conversation: lines longer than ``longest`` are clipped and end a piece, and so does a gap as long:
    (conv_id, piece, start_time, end_time, n_lines)."""
    rows = lines.select("conv_id", "start_time", "end_time", "line_id").filter("start_time IS NOT NULL AND end_time IS NOT NULL")
    w = Window.partitionBy("conv_id").orderBy("start_time", "line_id")
    long = (F.col("end_time") - F.col("start_time")) > longest
    end = F.when(long, F.col("start_time") + clipped).otherwise(F.col("end_time"))
    cut = rows.withColumn("stop", end).withColumn("long", long)
    new = F.coalesce(F.lag("long").over(w) | (F.col("start_time") - F.lag("stop").over(w) > longest), F.lit(True))
    pieces = cut.withColumn("new", new.cast("int")).withColumn("piece", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return pieces.groupBy("conv_id", "piece").agg(F.min("start_time").alias("start_time"), F.max("stop").alias("end_time"), F.count(F.lit(1)).alias("n_lines"))


def online_speakers(embeddings: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, speaker): each vector in order joins the nearest running mean if its cosine reaches the threshold, else founds a
    speaker. The assignment depends on all before it, so one task folds the whole table: for sets as small as a session's."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        means: list[np.ndarray] = []
        weights: list[int] = []
        given = []
        for i, v in rows.sort_values("vec_id").itertuples(index=False):
            x = np.asarray(v, float)
            best, who = -2.0, -1
            if means:
                m = np.stack(means)
                cos = m @ x / (np.linalg.norm(m, axis=1) * np.linalg.norm(x) + 1e-8)
                who = int(cos.argmax())
                best = float(cos[who])
            if best >= threshold:
                means[who] = (means[who] * weights[who] + x) / (weights[who] + 1)
                weights[who] += 1
            else:
                who = len(means)
                means.append(x)
                weights.append(1)
            given.append((i, who))
        yield pd.DataFrame(given, columns=["vec_id", "speaker"])

    return embeddings.select("vec_id", "embedding").coalesce(1).mapInPandas(fold, "vec_id long, speaker int")
