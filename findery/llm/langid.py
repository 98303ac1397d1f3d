"""Operator 5: language identification by multinomial naive Bayes over hashed character n-grams.

A text's features are the n-grams (1 to 3 code points) of a space and its lower-cased
letters, every run of other characters counting as one space, hashed to ``2**bits``
buckets.  The model is the matrix of log-probabilities (buckets x languages),
which is broadcast: its size is fixed by the number of buckets and the bound on languages.

Scoring takes a batch of texts at once: their n-grams are one sparse matrix of texts x
buckets, in rows one after another, and its product with the log-probabilities is
summed up row by row, in blocks, so that memory does not grow with a text but for
its code points.  A text's score for each language is the sum of its n-grams' rows; ``score`` is the
posterior of the best one.  NULL texts and texts without a letter are ``und`` with
score 0, as is everything if there is nothing to learn from.  Ties go to the
language that comes first in the alphabet.

If ``lang`` has more than ``most_languages`` values among the training rows, those that
most rows have are learned (ties: the first in the alphabet); the others' rows are not.
Each row is a row of its own, so NULL or repeated ids, repeated rows and other columns,
whatever their names, change nothing; an empty table gives an empty result.

The posterior says which of the learned languages fits best, not whether any does:
over hundreds of n-grams it is 1 for whatever text.  That is what ``evidence`` is for,
the mean log-likelihood of the text's n-grams in the best language.  It is compared
with what is usual for training texts of that language (``usual``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.llm import codepoints as cp
from findery.llm.common import bounded_batches, id_crc, sample_fraction, share, slices, table

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BLOCK = 1 << 17  # n-grams looked up at once


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    table: np.ndarray  # buckets x languages
    bits: int
    total: np.ndarray  # by language, n-grams counted and those that smoothing adds
    least: np.ndarray  # by bucket, those that smoothing adds


def grams(texts: list[str], bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The n-grams of texts, one after another: (for each order, buckets by place; each place's text; each text's number of places).

    An n-gram that would reach into the next text has bucket ``2**bits``; a text without a letter has no places.
    """
    lowered = [f" {x.lower()}" for x in texts]
    sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    points = cp.codes("".join(lowered))
    starts = np.cumsum(sizes) - sizes
    letter = cp.is_letter(points)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of others stands for a space
    keep[starts] = True
    keep &= np.repeat(np.add.reduceat(letter, starts, dtype=np.int64) > 0, sizes)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[keep]
    x = np.where(letter, points, np.uint32(32))[keep].astype(np.uint64)
    del points, letter, keep
    places = np.bincount(owner, minlength=len(texts))
    h, out = np.zeros(len(x), dtype=np.uint64), []
    for n in range(1, ORDERS[-1] + 1):
        h[: len(x) - n + 1] = h[: len(x) - n + 1] * cp.CHAR + x[n - 1 :]
        bucket = (((h + np.uint64(n)) * cp.MULT) >> np.uint64(64 - bits)).astype(np.int32)
        if n > 1:
            bucket[max(0, len(x) - n + 1) :] = 1 << bits
            bucket[: len(x) - n + 1][owner[n - 1 :] != owner[: len(x) - n + 1]] = 1 << bits
        out.append(bucket)
    return out, owner, places


def n_grams(places: np.ndarray) -> np.ndarray:
    """How many n-grams texts with so many places have."""
    return sum(np.maximum(places - n + 1, 0) for n in ORDERS)


def _sample(docs: DataFrame, train_docs: int) -> DataFrame:
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return sample_fraction(usable, "doc_id", usable.count(), train_docs).select("lang", "text")


def fit(docs: DataFrame, bits: int = 16, train_docs: int = 20_000, smoothing: float = 0.1, most_languages: int = 512) -> Model:
    """Learn from rows with a text and a language: all, or about ``train_docs`` of them, chosen by a hash of the id.

    Each task adds up its counts, so that what is shuffled and collected is
    bounded by buckets x languages for each task and in all.
    """
    sample = _sample(docs, train_docs)
    common = sample.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    langs = sorted(r["lang"] for r in common.collect())
    kind = pa.schema([("lang", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: k for k, x in enumerate(langs)}
        held: dict[int, np.ndarray] = {}  # the last place counts documents

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), lang, dtype=np.int32)), pa.array(k.astype(np.int32)), pa.array(n[k])], schema=kind)
            held.clear()

        for batch in slices(batches, size=1 << 20):
            known = [(place[a], b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if a in place]
            for lang in sorted({a for a, _ in known}):
                orders, _, places = grams([b for a, b in known if a == lang], bits)
                if lang not in held and len(held) >= 64:
                    yield from out()
                n = held.setdefault(lang, np.zeros((1 << bits) + 1, dtype=np.int64))
                for bucket in orders:
                    n[: 1 << bits] += np.bincount(bucket, minlength=(1 << bits) + 1)[: 1 << bits]
                n[-1] += np.count_nonzero(places)
        yield from out()

    totals = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(((1 << bits) + 1, len(langs)))
    counts[totals["bucket"].to_numpy(dtype=np.int64), totals["lang"].to_numpy(dtype=np.int64)] = totals["n"].to_numpy(dtype=np.float64)
    prior = counts[-1]
    langs, counts, prior = [x for x, n in zip(langs, prior) if n], counts[:-1, prior > 0], prior[prior > 0]
    # a bucket's smoothing follows how common it is in all languages: rare ones say little
    share = (counts.sum(axis=1, keepdims=True) + 1) / (counts.sum() + (1 << bits))
    weight = smoothing * (1 << bits)
    probability = (counts + weight * share) / (counts.sum(axis=0, keepdims=True) + weight)
    logs = np.concatenate([np.log(probability), np.zeros((1, len(langs)))]).astype(np.float32)  # the last row: no n-gram
    return Model(langs, np.log(prior / max(prior.sum(), 1)), logs, bits, counts.sum(axis=0) + weight, weight * share[:, 0])


def without(model: Model, lang: str, text: str) -> float | None:
    """The evidence for ``lang`` of a training text, had it not been learned; None without a letter."""
    orders, _, places = grams([text], model.bits)
    found, k = np.concatenate(orders), model.langs.index(lang)
    found = found[found < 1 << model.bits]
    if not places[0]:
        return None
    bucket, n = np.unique(found, return_counts=True)
    others = np.maximum(np.exp(model.table[bucket, k].astype(np.float64)) * model.total[k] - n, model.least[bucket])
    return float(n @ np.log(others / max(model.total[k] - len(found), 1)) / len(found))


def usual(docs: DataFrame, model: Model, train_docs: int = 20_000) -> dict[str, float]:
    """By language, the median evidence of the texts that ``fit`` learned from, each without itself.  At most about ``train_docs`` numbers are collected."""
    shared = share(docs.sparkSession, model)
    kind = pa.schema([("lang", pa.string()), ("evidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known = [(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if a in shared.value.langs]
            rows = [(a, x) for a, b in known if (x := without(shared.value, a, b)) is not None]
            yield pa.RecordBatch.from_pydict({"lang": [x for x, _ in rows], "evidence": [x for _, x in rows]}, schema=kind)

    found = _sample(docs, train_docs).mapInArrow(run, "lang string, evidence double").toPandas()
    return {str(k): float(v) for k, v in found.groupby("lang")["evidence"].median().items()}


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """For each text the predicted language, its posterior and the evidence for it, -inf for ``und``."""
    langs, score, evidence = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), -np.inf)
    rows = [k for k, x in enumerate(texts) if x]
    if not rows or not model.langs:
        return langs, score, evidence
    orders, owner, places = grams([texts[k] for k in rows], model.bits)
    sums = np.zeros((len(rows), len(model.langs)))
    block = max(1024, 4 * BLOCK // (4 + len(model.langs)))
    for at in range(0, len(owner), block):
        own = owner[at : at + block]
        edges = np.flatnonzero(np.diff(own, prepend=-1))
        for bucket in orders:
            sums[own[edges]] += np.add.reduceat(np.take(model.table, bucket[at : at + block], axis=0), edges, axis=0, dtype=np.float64)
    y = sums + model.prior
    best = y.argmax(axis=1)
    posterior = 1 / np.exp(y - y.max(axis=1, keepdims=True)).sum(axis=1)
    each = sums[np.arange(len(rows)), best] / np.maximum(n_grams(places), 1)
    for r in np.flatnonzero(places):
        langs[rows[r]] = model.langs[best[r]]
        score[rows[r]], evidence[rows[r]] = posterior[r], each[r]
    return langs, score, evidence


def predict(model: Model, text: str | None) -> tuple[str, float]:
    langs, score, _ = judge(model, [text])
    return langs[0], float(score[0])


def identify(spark: SparkSession, model: Model, text: Column) -> Column:
    """A column with the predicted language, its score and the evidence for it, struct(lang_pred, score, evidence)."""
    shared = share(spark, model)

    @F.pandas_udf("lang_pred string, score double, evidence double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["text"])
            found = [judge(shared.value, x.column(0).to_pylist()) for x in slices(iter([texts]), size=1 << 20)]
            yield pd.DataFrame({"lang_pred": [x for f in found for x in f[0]], "score": np.concatenate([np.empty(0), *(f[1] for f in found)]), "evidence": np.concatenate([np.empty(0), *(f[2] for f in found)])})

    return score.asNondeterministic()(text)  # never evaluated twice


def held_out() -> Column:
    return F.coalesce(id_crc() % 4 == 2, F.lit(False))


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out() & F.col("doc_id").isNotNull())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(train_rows(docs))
    found = docs.select("doc_id", held_out().alias("held_out"), identify(spark, model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
