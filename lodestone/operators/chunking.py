"""Chunkers: a text or a list of texts into chunks under a token budget (greedy packing)."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")


def estimate(text: str) -> int:
    return len(text) // 4


def pack(parts: list[str], most: int, separator: str = " ") -> list[str]:
    """Parts in order, joined while the estimate of the joined text stays within most; a part over it stands alone."""
    chunks: list[list[str]] = []
    size = 0
    for part in parts:
        if chunks and (size + len(separator) + len(part)) // 4 <= most:
            chunks[-1].append(part)
            size += len(separator) + len(part)
        else:
            chunks.append([part])
            size = len(part)
    return [separator.join(c) for c in chunks]


def pack_sentences(text: str | None, most: int) -> list[str]:
    """Sentences packed under a budget; special end marks become line breaks."""
    return pack([s for s in _SENTENCE.split((text or "").replace("<|endoftext|>", "\n")) if s], most)


def pack_paragraphs(text: str | None, most: int) -> list[str]:
    return pack([p for p in re.split(r"\n\s*\n", text or "") if p.strip()], most, "\n\n")


def split_turn(text: str | None, most: int) -> list[str]:
    """Sentences packed under a budget, sentences over it cut between words."""
    parts: list[str] = []
    for s in _SENTENCE.split(text or ""):
        parts += pack(s.split(), most) if estimate(s) > most else [s] if s else []
    return pack(parts, most)


def explode_chunks(rows: DataFrame, id_col: str, text_col: str, chunker, most: int) -> DataFrame:  # noqa: ANN001
    """(id, chunk_no, chunk) by a function of (text, budget); texts travel as Arrow batches, nothing is shuffled."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(i, k, c) for i, t in zip(pdf[id_col], pdf[text_col]) for k, c in enumerate(chunker(t, most))]
            yield pd.DataFrame(made, columns=[id_col, "chunk_no", "chunk"])

    return rows.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, chunk_no int, chunk string")


#: Rows of a block: folds over a group run within blocks of its order, so that no task holds a whole group.
BLOCK = 4096


def fold_blocks(rows: DataFrame, group: str, place: str, fold, made: str, block: int = BLOCK) -> DataFrame:  # noqa: ANN001
    """(group, block, made...) of a fold over the rows of each (group, block of ``block`` places), which it gets in a frame.

    Groups of any size are spread over their blocks; what the fold makes never crosses two of them. place is a whole number.
    """
    kind = rows.schema[group].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fold(pdf)
        out.insert(0, "block", key[1])
        out.insert(0, group, key[0])
        return out

    return rows.withColumn("block", F.floor(F.col(place) / F.lit(block)).cast("long")).groupBy(group, "block").applyInPandas(run, f"`{group}` {kind}, block long, {made}")


def joined_packs(texts: list[str], most: int, keep_with_next: list[bool] | None = None) -> list[list[int]]:
    """Places of texts in order, packed while the estimate of the texts joined by line breaks stays within most.

    Where a full pack ends with texts that are to stay with their next one (a question with its answer), these begin the next
    pack, unless nothing else would be left. A text over most stands alone.
    """
    packs: list[list[int]] = []
    now: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if now and (size + 1 + len(t)) // 4 > most:
            moved: list[int] = []
            while keep_with_next and len(now) > 1 and keep_with_next[now[-1]]:
                moved.insert(0, now.pop())
            if moved and (sum(len(texts[k]) + 1 for k in moved) + len(t)) // 4 > most:
                now, moved = now + moved, []  # they would not fit there
            packs.append(now)
            now, size = moved, sum(len(texts[k]) + 1 for k in moved) - 1 if moved else 0
        size += len(t) + (1 if now else 0)
        now = [*now, i]
    return [*packs, now] if now else packs


def pack_sessions(lines: DataFrame, most: int = 256, asks: str | None = None) -> DataFrame:
    """Lines of a conversation in order, packed into segments under a budget: (conv_id, block, segment, n_lines, tokens, text).

    asks: a condition of lines that stay with the next one. Null words are empty lines; conversations with null ids are one.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_id", kind="stable")
        words, asking = list(pdf["word"]), list(pdf["asks"])
        rows = [(k, len(x), estimate(text), text) for k, x in enumerate(joined_packs(words, most, asking)) for text in ["\n".join(words[i] for i in x)]]
        return pd.DataFrame(rows, columns=["segment", "n_lines", "tokens", "text"])

    kept = lines.select("conv_id", "line_id", F.coalesce("word", F.lit("")).alias("word"), F.coalesce(F.expr(asks), F.lit(False)).alias("asks") if asks else F.lit(False).alias("asks"))
    return fold_blocks(kept, "conv_id", "line_id", fold, "segment int, n_lines int, tokens int, text string")


def gather_segments(segments: DataFrame, most: int = 2048, enough: int = 1800) -> DataFrame:
    """Segments of pack_sessions gathered into chunks: (conv_id, block, chunk_no, n_segments, tokens, text).

    A chunk ends before the segment that would bring it over most, and after one that brings it to enough.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        now: list[str] = []

        def flush() -> None:
            if now:
                text = "\n".join(now)
                rows.append((len(rows), len(now), estimate(text), text))
                now.clear()

        for text in pdf.sort_values("segment")["text"]:
            if now and estimate("\n".join([*now, text])) > most:
                flush()
            now.append(text)
            if estimate("\n".join(now)) >= enough:
                flush()
        flush()
        return pd.DataFrame(rows, columns=["chunk_no", "n_segments", "tokens", "text"])

    return fold_blocks(segments.select("conv_id", F.col("block").alias("of"), "segment", "text"), "conv_id", "of", fold, "chunk_no int, n_segments int, tokens int, text string", 1)


def titled_packs(rows: DataFrame, group: str, place: str, title: str, text: str, target: int = 1024) -> DataFrame:
    """Titled texts of a group in order, packed under a budget: (group, block, chunk_no, titles, text).

    Each text gets the line "Title: ..." above it; a titled text is cut to the room that a chunk has for texts (target less 100
    tokens), as a chunk must hold it whole; texts without words are left out, and null titles are empty.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "tie"], kind="stable")
        titles, texts = list(pdf["title"]), [f"Title: {t}\n{x}"[: max(1, target - 100) * 4] for t, x in zip(pdf["title"], pdf["text"])]
        packs = joined_packs(texts, target)
        return pd.DataFrame([(k, [titles[i] for i in p], "\n".join(texts[i] for i in p)) for k, p in enumerate(packs)], columns=["chunk_no", "titles", "text"])

    kept = rows.select(group, F.col(place).cast("long").alias("place"), F.xxhash64(title, text).alias("tie"), F.coalesce(title, F.lit("")).alias("title"), F.col(text).alias("text")).filter(F.trim("text") != "")
    return fold_blocks(kept, group, "place", fold, "chunk_no int, titles array<string>, text string")


def labelled_packs(rows: DataFrame, key: str, text: str, limit: int = 2000, cut: int = 1000, buckets: int = 256) -> DataFrame:
    """Samples in hashed order, packed into chunks of at most ``limit`` characters: (bucket, chunk_no, key, n_chars).

    A chunk ends at the first sample that would overflow it; a sample over the limit is used with its first ``cut`` characters,
    as n_chars tells. Only lengths are moved, and each of the buckets is packed by itself. Null texts are left out.
    """
    order = F.xxhash64(F.col(key), F.lit(29))
    sized = rows.filter(F.col(text).isNotNull()).select(F.pmod(order, F.lit(buckets)).alias("bucket"), order.alias("place"), F.col(key), F.when(F.char_length(text) > limit, cut).otherwise(F.char_length(text)).alias("n_chars"))
    kind = rows.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", key], kind="stable")
        numbers, size, k = [], 0, 0
        for n in pdf["n_chars"]:
            if size and size + n > limit:
                size, k = 0, k + 1
            size += n
            numbers.append(k)
        return pdf.assign(chunk_no=numbers)[["bucket", "chunk_no", key, "n_chars"]]

    return sized.groupBy("bucket").applyInPandas(run, f"bucket long, chunk_no int, `{key}` {kind}, n_chars int")


def greedy_batches(items: DataFrame, group: str, place: str, size: str, most: str) -> DataFrame:
    """Items of a group in order, in batches: (group, block, place, batch). A batch ends before the item that would bring its
    size over ``most`` (a column, one value a group); an item over it stands alone."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(place, kind="stable")
        numbers, held, k = [], 0, 0
        for n, m in zip(pdf[size], pdf[most]):
            if held and held + n > m:
                held, k = 0, k + 1
            held += n
            numbers.append(k)
        return pd.DataFrame({place: pdf[place].to_numpy(), "batch": numbers})

    return fold_blocks(items.select(group, F.col(place).cast("long").alias(place), F.coalesce(size, F.lit(0)).cast("long").alias(size), F.col(most).cast("long").alias(most)), group, place, fold, f"`{place}` long, batch int")


def even_groups(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n parts of each group in order, the first ones one row larger where it doesn't divide."""
    return rows.withColumn("part", F.ntile(n).over(Window.partitionBy(group).orderBy(order)))


def greedy_partitions(sizes: dict, k: int) -> dict:
    """Key to partition by greedy largest-first assignment to the emptiest partition."""
    load = [0] * k
    given = {}
    for key, size in sorted(sizes.items(), key=lambda x: (-x[1], str(x[0]))):
        p = min(range(k), key=lambda i: (load[i], i))
        given[key] = p
        load[p] += size
    return given


def differencing_partitions(sizes: dict, k: int) -> dict:
    """Key to partition by the largest differencing method of Karmarkar and Karp for k parts.

    Each state is k bins; the two states of the widest spread are merged, the fullest bin of one with the emptiest of the other.
    """
    heap = []
    for n, (key, size) in enumerate(sorted(sizes.items(), key=lambda x: (-x[1], str(x[0])))):
        heap.append((-size, n, [(size, [key])] + [(0, [])] * (k - 1)))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        merged = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda bin_: -bin_[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], n, merged))
        n += 1
    return {key: part for part, (_, keys) in enumerate(heap[0][2] if heap else []) for key in keys}


def partitioned(sizes: DataFrame, key: str, size: str, k: int, method) -> DataFrame:  # noqa: ANN001
    """(key, size, part) for a table of one size per key, which is short: one task assigns its parts. Null keys are left out."""
    kind = sizes.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        given = method(dict(zip(pdf[key], (int(x) for x in pdf[size]))), k)
        return pdf[[key, size]].assign(part=[given[x] for x in pdf[key]])

    kept = sizes.filter(F.col(key).isNotNull()).select(key, F.coalesce(size, F.lit(0)).cast("long").alias(size))
    return kept.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, f"`{key}` {kind}, `{size}` long, part int")
