"""Corpus construction: joins, filters, set operations and sampling as DataFrame functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of texts that meet all parts at once, and that are hashed at once; without effect on results.
BLOCK, SLICE = 16_000_000, 2_000_000

QA = T.ArrayType(T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())]))


def questions(instances: DataFrame) -> DataFrame:
    """(instance_id, qa_idx, question, answer, data_source) of the JSON lists; answers that are lists stay JSON text."""
    parsed = F.from_json("questions_and_answers", QA)
    return instances.select("instance_id", "data_source", F.posexplode(parsed).alias("qa_idx", "qa")).select("instance_id", F.col("qa_idx"), "qa.question", "qa.answer", "data_source")


def hashed_order(*columns: str, seed: int = 42) -> Column:
    """A shuffle that every engine repeats: the MD5 of the columns and a seed."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def sample_per_group(rows: DataFrame, groups: list[str], ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows of each group in hashed order, __rank being their place.

    Rows rank within one of 256 parts of a group first, and only the n first of each part meet in the group's window."""
    keyed = rows.withColumn("__h", hashed_order(*ids, seed=seed))
    part = Window.partitionBy(*groups, F.substring("__h", -2, 2)).orderBy("__h", *ids)
    few = keyed.withColumn("__rank", F.row_number().over(part)).filter(F.col("__rank") <= n)
    ranked = few.withColumn("__rank", F.row_number().over(Window.partitionBy(*groups).orderBy("__h", *ids)))
    return ranked.filter(F.col("__rank") <= n).drop("__h")


def contains_join(texts: DataFrame, parts: DataFrame, id_col: str, text: str, part: str) -> DataFrame:
    """(id, part): the texts that contain each part.

    Texts fall into blocks of about BLOCK bytes, each of which meets all parts in memory (``_holding``), so that neither words nor
    candidates are shuffled: what moves is the texts once and the parts once for each block.
    """
    texts = texts.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    blocks = F.greatest(F.ceil(texts.agg((F.sum(F.octet_length("text")) / BLOCK).alias("n")).scalar()).cast("int"), F.lit(1))
    placed = texts.withColumn("blocks", blocks).select(F.pmod(F.hash("id"), F.col("blocks")).alias("b"), "id", "text")
    parts = parts.filter(F.col(part).isNotNull()).select(F.col(part).alias("part")).withColumn("blocks", blocks).select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "part")
    schema = T.StructType([placed.schema["id"], parts.schema["part"]])
    return placed.groupBy("b").cogroup(parts.groupBy("b")).applyInArrow(_holding, schema).select(F.col("id").alias(id_col), F.col("part").alias(part))


def _bytes(strings: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds and the bytes of strings."""
    if not len(strings):
        return np.zeros(1, "int64"), np.zeros(0, "uint8")
    a = pa.concat_arrays(strings.cast(pa.large_string()).chunks)
    bounds = np.frombuffer(a.buffers()[1], "int64")[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], "uint8") if a.buffers()[2] else np.zeros(0, "uint8")
    return bounds - bounds[0], data[bounds[0] : bounds[-1]]


def _hashes(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, hashes of all runs of k bytes) for k = 1, 2, 4 ...; a hash of 2k bytes is made of two of k."""
    h, k = (data.astype("uint64") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while len(h):
        yield k, h
        h = h[:-k] * np.uint64(0xD6E8FEB86659FD93) + h[k:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        k *= 2


def _holding(texts: pa.Table, parts: pa.Table) -> pa.Table:
    """The pairs of texts and parts that they contain.

    A part of n bytes is two runs of k bytes, k being the largest power of two up to n: where a text has the first one's hash, and
    the second one's at its distance, it has the part, which a comparison of the bytes confirms."""
    ends, data = _bytes(texts.column("text"))
    bounds, signs = _bytes(parts.column("part"))
    length = np.diff(bounds)
    pairs = [(np.repeat(np.arange(len(texts)), (length == 0).sum()), np.tile(np.flatnonzero(length == 0), len(texts)))]
    keys = {}
    for k, h in _hashes(signs):
        own = np.flatnonzero((length >= k) & (length < 2 * k))
        own = own[np.argsort(h[bounds[own]])] if len(own) else own
        seen = np.zeros(1 << 20, bool)
        seen[h[bounds[own]] >> np.uint64(44)] = True
        keys[k] = own, h[bounds[own]], h[bounds[own + 1] - k] if len(own) else h[:0], seen
        if not (length >= 2 * k).any():
            break
    at = 0
    while at < len(texts) and keys:  # some texts at a time, for the sake of memory
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        here, edge = data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        for k, h in _hashes(here):
            if k not in keys:
                break
            own, first, last, seen = keys[k]
            if not len(own):
                continue
            place = np.flatnonzero(seen[h >> np.uint64(44)])
            low, high = np.searchsorted(first, h[place], "left"), np.searchsorted(first, h[place], "right")
            times = high - low
            place, of = np.repeat(place, times), np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
            row = np.searchsorted(edge, place, "right") - 1
            fits = place + length[own[of]] <= edge[row + 1]
            place, of, row = place[fits], of[fits], row[fits]
            same = h[place + length[own[of]] - k] == last[of]
            place, piece, row = place[same], own[of[same]], row[same]
            key, one = np.unique(row * len(parts) + piece, return_index=True)
            row, piece, place = key // len(parts), key % len(parts), place[one]
            kept = np.fromiter((_same(here, edge, signs, bounds, *x) for x in zip(row.tolist(), piece.tolist(), place.tolist())), bool, len(row))
            pairs.append((row[kept] + at, piece[kept]))
        at = to
    row, piece = (pa.array(np.concatenate(x)) for x in zip(*pairs))
    return pa.table({"id": texts.column("id").take(row), "part": parts.column("part").take(piece)})


def _same(here: np.ndarray, edge: np.ndarray, signs: np.ndarray, bounds: np.ndarray, row: int, piece: int, place: int) -> bool:
    """Whether the bytes agree too; if not at this place, the whole text is looked through."""
    want = signs[bounds[piece] : bounds[piece + 1]].tobytes()
    return here[place : place + len(want)].tobytes() == want or want in here[edge[row] : edge[row + 1]].tobytes()


def last_wins(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One value a key: that of the highest order."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def ordered_distinct(items: Column) -> Column:
    """Entries without repetition regardless of case, in the first spelling and order, without blanks."""
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, 1, i), lambda y: F.lower(y) == F.lower(x)))


def interleave(rows: DataFrame, times: int | Column) -> DataFrame:
    """Each row n times, copies beside each other, numbered from 0."""
    n = F.lit(times) if isinstance(times, int) else times
    return rows.select("*", F.explode(F.when(n >= 1, F.sequence(F.lit(0), n - 1))).alias("copy"))
