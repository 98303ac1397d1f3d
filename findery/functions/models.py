"""Encoders and scorers are plug-ins: a function from a batch of texts to numbers, run on Arrow batches.

No weights come with the library.  ``hashing_encoder`` is a stand-in for tests and
trials: a bag of hashed words, not a language model.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Encode = Callable[[list[str]], np.ndarray]


def encode(model: Callable[[], Encode], text: Column) -> Column:
    """Vectors of texts; ``model`` is called once in each task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = model()
        for part in parts:
            yield pd.Series(list(np.asarray(ready(part.fillna("").tolist()), dtype=np.float32)))

    return run(text)


def classify(model: Callable[[], Encode], text: Column, label: int = 1) -> Column:
    """Softmax of a classifier's logits at one label."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = model()
        for part in parts:
            x = np.asarray(ready(part.fillna("").tolist()), dtype=np.float64)
            e = np.exp(x - x.max(axis=1, keepdims=True))
            yield pd.Series(e[:, label] / e.sum(axis=1))

    return run(text)


def hashing_encoder(dim: int = 64, most_words: int = 512) -> Callable[[], Encode]:
    """Words beyond ``most_words`` are not seen, as by encoders with a fixed number of places."""

    def load() -> Encode:
        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, text in enumerate(texts):
                for word in text.lower().split()[:most_words]:
                    h = zlib.crc32(word.encode())
                    out[i, h % dim] += 1 if h >> 31 else -1
            return out

        return run

    return load
