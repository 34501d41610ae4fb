"""Embedding backends: functions of texts that give vectors, as column functions on Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


class Backend:
    """What an embedding model must offer. A failure on a text gives the zero vector."""

    size = 0

    def embed(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def column(self) -> Callable:
        backend = self

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            def one(t: str) -> list[float]:
                try:
                    return backend.embed(t if isinstance(t, str) else "").astype("float32").tolist()
                except Exception:  # noqa: BLE001 - a model may fail in any way
                    return [0.0] * backend.size

            return texts.map(one, na_action=None)

        return run


class HashedWords(Backend):
    """Counts of words at hashed places with hashed signs: deterministic and offline."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, text: str) -> np.ndarray:
        v = np.zeros(self.size)
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            v[h % self.size] += 1 if h & 0x10000 else -1
        return v
