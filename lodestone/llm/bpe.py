"""Byte-level BPE, exactly, by backtracking over longest matches.

A greedy longest match is not what the merges of a BPE vocabulary give. But an encoding is right if and only if each pair
of neighbours in it is *compatible*, that is, if encoding the two tokens' bytes gives these two tokens again. So the
encoder takes the longest token that matches (an Aho-Corasick automaton finds the candidates), checks it against its left
neighbour in a table of compatible pairs, falls back to the next shorter token that is a prefix, and steps back where none
fits. Each place is given up at most once, so the work is linear in the length.

The texts are split into pieces by the tokenizer's pattern first; the pieces of a language repeat, so each worker keeps a
bounded cache of pieces. Decoding uses one byte string and a table of offsets into it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits a text into pieces (contractions, words, numbers, other signs, white space).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Where the vocabulary files of the public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"

#: Entries of a worker's cache of pieces, and the longest piece that is kept, in bytes.
CACHE, CACHE_BYTES = 400_000, 64


class BytePairEncoder:
    """The encoder of one vocabulary file of ranks (lines of base64 token, rank). Ids are the ranks."""

    def __init__(self, path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.ranks = ranks
        self.count = max(ranks.values()) + 1
        #: decoding: token i is data[offsets[i]:offsets[i + 1]]
        by_id = [b""] * self.count
        for token, i in ranks.items():
            by_id[i] = token
        self.data = b"".join(by_id)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in by_id])]).astype(np.int64)
        self.length = [len(x) for x in by_id]
        self.bytes_of = by_id
        self._build_automaton()
        self._build_splits()
        self.compatible: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.pattern = regex.compile(PIECES)

    def _build_automaton(self) -> None:
        """The automaton over all tokens (a byte is one latin-1 character), and each token's longest proper prefix that is a token."""
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ranks))
        self.shorter = [-1] * self.count
        for token, i in self.ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if (j := self.ranks.get(token[:n])) is not None:
                    self.shorter[i] = j
                    break

    def _build_splits(self) -> None:
        """The two tokens whose merge made a token; a token of one byte, or one that no merge makes, stands for itself."""
        self.split: list[tuple[int, int]] = [(i, i) for i in range(self.count)]
        self.merged: dict[tuple[int, int], int] = {}
        for token, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) < 2:
                continue
            # the pair is what the earlier merges leave of the token's bytes
            parts = [token[k : k + 1] for k in range(len(token))]
            while len(parts) > 2:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    r = self.ranks.get(parts[k] + parts[k + 1])
                    if r is not None and r < i and (best is None or r < best):
                        best, at = r, k
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                pair = (self.ranks[parts[0]], self.ranks[parts[1]])
                self.split[i] = pair
                self.merged.setdefault(pair, i)

    def _fits(self, left: int, right: int) -> bool:
        """Whether two tokens may stand beside each other: no merge across their border comes before those inside them."""
        key = left * self.count + right
        known = self.compatible.get(key)
        if known is not None:
            return known
        a, b, ok = left, right, True
        limit = self.count + 1  # a merge across the border of this id or more would come too late
        while True:
            made = self.merged.get((a, b))
            if made is not None and made < limit:
                ok = False
                break
            # undo the later one of the last merges beside the border; equal merges run from the left, so one across the
            # border precedes an equal one on its right
            inner_a, inner_b = self.split[a][1], self.split[b][0]
            if inner_a != a and (a > b or inner_b == b):
                limit, a = a, inner_a
            elif inner_b != b:
                limit, b = b + 1, inner_b
            else:
                break
        if len(self.compatible) > 4_000_000:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def _longest_matches(self, text: str) -> list[int]:
        """For each place the longest token that starts there (one pass of the automaton)."""
        found = [-1] * len(text)
        length = self.length
        for end, i in self.automaton.iter(text):
            start = end - length[i] + 1
            if found[start] < 0 or length[i] > length[found[start]]:
                found[start] = i
        return found

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        matches = self._longest_matches(data.decode("latin-1"))
        n, length, shorter, fits = len(data), self.length, self.shorter, self._fits
        open_at = bytearray(b"\x01") * (n + 1)
        ids: list[int] = []
        pos, token = 0, matches[0]
        while pos < n:
            end = pos + length[token]
            if open_at[end] and (not ids or fits(ids[-1], token)):
                ids.append(token)
                pos = end
                token = matches[pos] if pos < n else -1
                continue
            token = shorter[token]
            if token < 0:
                open_at[pos] = 0
                token = ids.pop()
                pos -= length[token]
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; an empty list for empty and null texts."""
        ids: list[int] = []
        if not text:
            return ids
        cache, extend = self.cache, ids.extend
        get = cache.get
        for piece in self.pattern.findall(text):
            known = get(piece)
            if known is None:
                data = piece.encode("utf-8", "surrogatepass")
                known = self.encode_piece(data)
                if len(data) <= CACHE_BYTES:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[piece] = known
            extend(known)
        return ids

    def count_tokens(self, text: str | None) -> int:
        return len(self.encode(text))

    def decode(self, ids: list[int]) -> str:
        o = self.offsets
        return b"".join(self.data[o[i] : o[i + 1]] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    """One encoder per Python worker and file."""
    return BytePairEncoder(path)


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return str(Path(folder) / f"{name}.tiktoken")


def encode_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids array<int>): each text by the vocabulary, without special tokens; an empty list for empty and null texts.

    Every row comes out, repeated ids and texts as often as they come in. One pass, no shuffle: the vocabulary is read from
    its file once in each Python worker and nothing is broadcast. Arrow batches carry the ids as offsets and one flat array.
    """
    path = path or vocabulary()
    schema = documents.select(F.col(id_col)).schema.simpleString()[7:-1] + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            lists = [encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [id_col, "ids"])

    return documents.select(id_col, text_col).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id_col, text): the texts of ids; an empty text for an empty list, null for null."""
    path = path or vocabulary()
    schema = encoded.select(F.col(id_col)).schema.simpleString()[7:-1] + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else decode(x) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)


def token_count(text: str | Column, path: str | None = None) -> Column:
    """A column of token counts (0 for empty and null texts)."""
    path = path or vocabulary()

    @F.pandas_udf("int")
    def count(texts):  # noqa: ANN001, ANN202
        tokens = encoder(path).count_tokens
        return texts.map(tokens, na_action=None).astype("int32")

    return count(text)
