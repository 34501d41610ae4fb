"""How many tokens each text has under a public tokenizer, and totals by source, language and domain.

The vocabulary lies in a double-array trie.  A text is split into normalised segments (the tokenizer's pieces) and one pass
per segment counts the tokens of its best path without building it: at each end of a token the count and the last token of
the best path to there are kept, nothing else.

Which path is best depends on the vocabulary.  With scores (unigram vocabularies) it is the path of the highest sum.  With
merges (byte-level BPE) it is the one path all of whose neighbours are compatible; each prefix of a segment has exactly one,
so the same pass finds it (see bpe.py for compatibility).  The public vocabularies at hand are all of the second kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.llm.splitting import normal_source


class DoubleArrayTrie:
    """Byte strings to numbers. State s goes to base[s] + byte + 1 by a byte if check of that place is s; value is -1 inside a path."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys.items():
            node = 0
            for b in key:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    values.append(-1)
                node = nxt
            values[node] = value
        size = 2 * len(children) + 600
        base, check, value = [0] * size, [-1] * size, [-1] * size
        place = [0] * len(children)
        check[0], free, todo = 0, 1, [0]
        for node in todo:  # grows while it runs: breadth first
            kids = children[node]
            s = place[node]
            value[s] = values[node]
            if not kids:
                continue
            codes = sorted(kids)
            while check[free] >= 0:
                free += 1
            at = free
            while True:
                b = at - codes[0] - 1
                if b >= 0 and at + 260 < len(check) and all(check[b + c + 1] < 0 for c in codes):
                    break
                at += 1
                if at + 260 >= len(check):
                    grow = len(check)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                while check[at] >= 0:
                    at += 1
            base[s] = b
            for c in codes:
                check[b + c + 1] = s
                place[kids[c]] = b + c + 1
                todo.append(kids[c])
        self.base, self.check, self.value = base, check, value

    def prefixes(self, data: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, value) of the keys that begin at start, shortest first."""
        s, base, check, value = 0, self.base, self.check, self.value
        for i in range(start, len(data)):
            t = base[s] + data[i] + 1
            if check[t] != s or t == 0:
                return
            s = t
            if value[s] >= 0:
                yield i + 1, value[s]


class MergesCounter:
    """Counts the tokens of a byte-level BPE vocabulary."""

    def __init__(self, path: str):
        self.encoder = bpe.encoder(path)
        self.trie = DoubleArrayTrie(self.encoder.ranks)
        self.cache: dict[str, int] = {}

    def segment(self, data: bytes) -> int:
        n, fits, prefixes = len(data), self.encoder._fits, self.trie.prefixes
        count, last = [-1] * (n + 1), [-1] * (n + 1)
        count[0] = 0
        for i in range(n):
            if count[i] < 0:
                continue
            left, c = last[i], count[i] + 1
            for end, token in prefixes(data, i):
                if count[end] < 0 and (left < 0 or fits(left, token)):
                    count[end], last[end] = c, token
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        cache, total = self.cache, 0
        for piece in self.encoder.pattern.findall(text):
            n = cache.get(piece)
            if n is None:
                data = piece.encode("utf-8", "surrogatepass")
                n = 1 if data in self.encoder.ranks else self.segment(data)
                if len(data) <= bpe.CACHE_BYTES:
                    if len(cache) >= bpe.CACHE:
                        cache.clear()
                    cache[piece] = n
            total += n
        return total


class UnigramCounter:
    """Counts the tokens of a unigram vocabulary: (piece, score) with white space as U+2581 before a segment. Bytes that no
    piece covers cost unknown and count as one token for each run of unknown characters."""

    def __init__(self, scores: dict[str, float], unknown: float | None = None):
        pieces = list(scores)
        self.score = [scores[p] for p in pieces]
        self.unknown = unknown if unknown is not None else min(self.score, default=0.0) - 10.0
        self.trie = DoubleArrayTrie({p.encode(): i for i, p in enumerate(pieces)})
        self.split = regex.compile(r"\s*\S+")

    def segment(self, data: bytes) -> int:
        n = len(data)
        best, count, strange = [-1e300] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -1e300 or data[i] & 0xC0 == 0x80:
                continue
            for end, token in self.trie.prefixes(data, i):
                if (s := best[i] + self.score[token]) > best[end]:
                    best[end], count[end], strange[end] = s, count[i] + 1, False
            end = i + 1
            while end < n and data[end] & 0xC0 == 0x80:
                end += 1
            if (s := best[i] + self.unknown) > best[end]:
                best[end], count[end], strange[end] = s, count[i] + (not strange[i]), True
        return count[n]

    def count(self, text: str | None) -> int:
        return sum(self.segment(("▁" + s.strip()).encode()) for s in self.split.findall(text or ""))


@lru_cache(maxsize=4)
def counter(path: str) -> MergesCounter:
    """One counter per Python worker and file."""
    return MergesCounter(path)


def token_counts(rows: DataFrame, text_col: str, out_col: str = "n_tokens", path: str | None = None) -> DataFrame:
    """The other columns with out_col, the number of tokens of text_col (0 for empty and null texts), in its place.

    One pass and no shuffle. Texts travel to Python as Arrow batches, and only counts come back.
    """
    path = path or bpe.vocabulary()
    fields = [f for f in rows.schema.fields if f.name != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out_col}` int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            numbers = np.fromiter(map(count, batch.column(len(fields)).to_pylist()), np.int32, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(numbers)], [*(f.name for f in fields), out_col])

    return rows.select(*[F.col(f"`{f.name}`") for f in fields], F.col(text_col)).mapInArrow(run, schema)


def token_budget(chunks: DataFrame, text_col: str = "chunk", slices: tuple[str | Column, ...] = ("data_source", "lang", "domain"), path: str | None = None) -> DataFrame:
    """(data_source, lang, domain, n_rows, n_tokens): rows and tokens of each slice.

    Sources are compared without case and outer white space and given in lower case. A null (or a blank source) is a slice of
    its own. Rows with null or empty texts count as rows of 0 tokens. An empty table has no slices. Sums are made before the
    shuffle, so a slice of any size sends one row per task.
    """
    keyed = chunks.select(*[normal_source(c).alias(c) if c in ("data_source", "source") else F.col(c) for c in slices], F.col(text_col))
    return token_counts(keyed, text_col, path=path).groupBy(*slices).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("n_tokens").cast("long")).alias("n_tokens"))
