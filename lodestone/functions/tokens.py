"""Token counts of a public tokenizer through its own library."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern of the vocabulary's pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("lodestone", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text, 0 for null."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        e = _encoding(path)
        return pd.Series([len(e.encode_ordinary(t)) if isinstance(t, str) else 0 for t in texts], dtype="int32")

    return count(text)
