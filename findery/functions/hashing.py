"""SimHash, Hamming distance and Jaccard distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS, CHUNK, MOST_KNOWN = 64, 3, 200_000


class _ChunkHashes(dict):
    """The first eight bytes of md5 of each chunk seen, as a number, high byte first."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = h = int.from_bytes(hashlib.md5(chunk.encode("utf-8", "surrogatepass")).digest()[:8], "big")
        return h


def simhash(tokens: Column) -> Column:
    """Bit i of the chunks (each token's windows of three characters; a shorter token is one) votes on bit 63 - i of the result; a tie is 0.  No tokens: 0.

    Chunks are few and come again and again, so a worker remembers the hashes of so many;
    the votes of a document are one sum over a matrix of bits.  Nothing is shuffled.
    """

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _ChunkHashes()
        for part in parts:
            out = np.zeros(len(part), dtype=np.uint64)
            for i, words in enumerate(part):
                if words is None or not len(words):
                    continue
                found = [known[c] for t in words for c in ([t] if len(t) <= CHUNK else [t[k : k + CHUNK] for k in range(len(t) - CHUNK + 1)])]
                bits = np.unpackbits(np.array(found, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
                votes = 2 * bits.sum(axis=0, dtype=np.int64) > len(found)
                out[i] = np.packbits(votes, bitorder="little").view("<u8")[0]
            if len(known) > MOST_KNOWN:
                known.clear()
            yield pd.Series(out.view(np.int64))

    return run(tokens)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def word_set(text: Column) -> Column:
    """A text's distinct words between white space, case kept, as 64-bit hashes; a NULL text has none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def jaccard_distance(a: Column, b: Column) -> Column:
    """Of two texts as sets of words between white space, case kept; two empty texts are equal."""
    x, y = (F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != "")) for t in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(x, y)) / union)
