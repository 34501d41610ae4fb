"""Oversized texts into pieces under a size limit, cut where the text itself breaks.

Recursive bisection: a part that is too long is cut at the strongest boundary near its midpoint (paragraph, line, sentence,
word, other place outside a word), and its halves likewise, until each part leaves room for the overlap. Then each piece but
the first is extended to the left by up to the overlap, at a boundary too. A cut inside a run of letters and digits (a forced
cut) is made only where such a run alone is longer than the limit: a part that consists of such a run stays whole up to the
limit, and gets as much overlap as still fits.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strengths of boundaries. After and before a mark that belongs to a letter is cut only where nothing else is left; a cut at 0 is forced.
PARAGRAPH, LINE, SENTENCE, WORD, SIGN, AFTER_MARK, BEFORE_MARK = 7, 6, 5, 4, 3, 2, 1
#: A boundary counts as near if it lies within this part of the length on either side of the midpoint.
NEAR = 0.25

_BOUNDARY = (
    (PARAGRAPH, regex.compile(r"\n[^\S\n]*\n\s*|[ ]\s*")),
    (LINE, regex.compile(r"\r\n|[\n\r\v\f\x85 ]")),
    (SENTENCE, regex.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』”）]*\s*")),
    (WORD, regex.compile(r"\s+")),
)
#: Signs that belong to the character before them: joiners, variation selectors, skin tones.
_JOINED = frozenset("\u200d\ufe0e\ufe0f") | frozenset(map(chr, range(0x1F3FB, 0x1F400)))
_RUN = regex.compile(r"[\p{L}\p{N}]+")


@lru_cache(maxsize=65536)
def _kind(code: int) -> int:
    """1 for letters and digits, 2 for marks and joined signs, 3 for the joiner itself, 0 for the rest."""
    c = chr(code)
    if c == "\u200d":
        return 3
    category = unicodedata.category(c)
    return 2 if category[0] == "M" or c in _JOINED else int(category[0] in "LN")


def boundaries(text: str) -> dict[int, list[int]]:
    """Sorted cut places by strength; a place is the index of the first character after the cut."""
    n = len(text)
    codes, at = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    kind = np.fromiter((_kind(int(c)) for c in codes), np.int8, len(codes))[at]
    before, after = kind[:-1], kind[1:]
    strength = np.full(n + 1, SIGN, np.int8)
    inner = strength[1:n]
    inner[(before == 2) & (after == 1)] = AFTER_MARK
    inner[(after >= 2) | (before == 3)] = BEFORE_MARK
    inner[(before == 1) & (after == 1)] = 0
    for s, pattern in reversed(_BOUNDARY):
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        strength[ends] = s
    strength[0] = strength[n] = 0
    return {s: np.flatnonzero(strength == s).tolist() for s in range(PARAGRAPH, 0, -1)}


def _closest(places: list[int], low: int, high: int, middle: int) -> int | None:
    """The place in [low, high] closest to the middle; the earlier one of two."""
    a, b = bisect_left(places, low), bisect_right(places, high)
    if a >= b:
        return None
    k = min(max(bisect_left(places, middle), a), b - 1)
    return min((places[j] for j in (k - 1, k) if a <= j < b), key=lambda p: (abs(p - middle), p))


def split_text(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int, int, int]]:
    """Pieces (start of the part, start with overlap, end, forced): text[start with overlap:end] has at most limit characters,
    the parts follow one another and cover the text; forced is 1 where the cut before the part goes through a run of letters
    and digits. A limit under 1 counts as 1, and an overlap of the limit or more as one less than it."""
    n, limit = len(text), max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if n <= limit:
        return [(0, 0, n, 0)]
    places = boundaries(text)
    order = [s for s in places if s >= SIGN]
    room = limit - overlap
    parts: list[tuple[int, int]] = []
    forced: set[int] = set()
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        size = b - a
        if size <= room:
            parts.append((a, b))
            continue
        middle, reach = (a + b) // 2, max(1, int(size * NEAR))
        cut = None
        for low, high in ((max(a + 1, middle - reach), min(b - 1, middle + reach)), (a + 1, b - 1)):
            for s in order:
                cut = _closest(places[s], low, high, middle)
                if cut is not None:
                    break
            if cut is not None:
                break
        if cut is None:
            if size <= limit:
                parts.append((a, b))
                continue
            cut = next((c for s in (AFTER_MARK, BEFORE_MARK) if (c := _closest(places[s], a + 1, b - 1, middle)) is not None), None)
            if cut is None:
                cut = middle
                forced.add(cut)
        todo += [(cut, b), (a, cut)]
    every = sorted(p for s in order for p in places[s])
    pieces = []
    for i, (a, b) in enumerate(parts):
        start = a
        if i and overlap:
            low = max(a - min(overlap, limit - (b - a)), parts[i - 1][0])
            k = bisect_left(every, low)
            start = every[k] if k < len(every) and every[k] < a else (low if a in forced else a)
        pieces.append((a, start, b, int(a in forced)))
    return pieces


def longest_run(text: str) -> int:
    """Length of the longest run of letters and digits."""
    return max((m.end() - m.start() for m in _RUN.finditer(text)), default=0)


def normal_source(source: str | Column) -> Column:
    """A source's name without case and outer white space; blank names count as null."""
    c = F.col(source) if isinstance(source, str) else source
    return F.nullif(F.lower(F.regexp_replace(c, r"^[\s  -​　]+|[\s  -​　]+$", "")), F.lit(""))


def with_limits(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows with max_chars and overlap_chars of their source; null and unlisted sources get those of ``default``.

    limits has one row per source (of a source listed twice the smallest limit holds) and is joined by value: Spark broadcasts
    it where its measured size is under spark.sql.autoBroadcastJoinThreshold.
    """
    own = limits.groupBy(normal_source("data_source").alias("__source")).agg(F.min(F.struct("max_chars", "overlap_chars")).alias("__own"))
    joined = chunks.withColumn("__source", normal_source("data_source")).join(own, "__source", "left")
    joined = joined.withColumn("__rest", own.filter(F.col("__source") == "default").select("__own").scalar())
    chosen = F.coalesce("__own", "__rest")
    return joined.withColumn("max_chars", chosen["max_chars"]).withColumn("overlap_chars", chosen["overlap_chars"]).drop("__source", "__own", "__rest")


def split_chunks(chunks: DataFrame, limits: DataFrame, id_col: str = "chunk_id", text_col: str = "chunk") -> DataFrame:
    """Pieces of the texts that are longer than their source's limit: (id_col, piece, start_char, n_new, forced, any_forced, text).

    text has at most max_chars characters; it begins at start_char of the whole text, and its last n_new characters are those
    that the piece before it doesn't have. forced is 1 where the cut before the piece goes through a run of letters and digits
    longer than the limit, any_forced where some cut of the text is. Texts within the limit, null and empty texts give no rows; repeated rows count each. One pass and no
    shuffle: short texts never leave the JVM. Where there is neither an own limit nor a default, nothing is split.
    """
    sized = with_limits(chunks.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), "data_source"), limits)
    large = sized.filter(F.char_length("__text") > F.col("max_chars")).select("__id", "__text", F.col("max_chars").cast("int"), F.coalesce(F.col("overlap_chars"), F.lit(0)).cast("int"))
    kind = chunks.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start_char int, n_new int, forced int, any_forced int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = split_text(text, limit, overlap)
                some = max(p[3] for p in pieces)
                for k, (a, start, end, forced) in enumerate(pieces):
                    rows.append((i, k, start, end - a, forced, some, text[start:end]))
            columns = list(zip(*rows)) or [[]] * 7
            types = [batch.schema.field(0).type, *[pa.int32()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], [id_col, "piece", "start_char", "n_new", "forced", "any_forced", "text"])

    return large.mapInArrow(run, schema)


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(chunk_id, forced_cut) of the texts that are split, one row per row of chunks: forced_cut is 1 if some cut is forced."""
    return split_chunks(chunks, limits).filter("piece = 0").select("chunk_id", F.col("any_forced").alias("forced_cut"))
