"""From queries to ranked pages: lexical candidates, vectors, authority."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findery.config import DEFAULTS, Settings
from findery.functions.vectors import cosine
from findery.operators.index import ranked_bm25, top
from findery.operators.store import add_first


MOST_BYTES = 64 << 20  # of query vectors that are sent to all tasks at once


def nearest(queries: DataFrame, vectors: DataFrame, k: int, decimals: int | None = None) -> DataFrame:
    """(query_id, doc_id, cosine): each query's k nearest of all vectors, by exact search; ties go to the smaller doc_id.

    The queries are a matrix that each task multiplies with its vectors, batch by batch, keeping the k
    best of each, so that only these are shuffled.  The matrix is sent to the tasks, up to MOST_BYTES
    at once; if there are more queries, the vectors are read once for each such part.  NULL and
    zero vectors, and those of another dimension than a query, are not found.
    """
    spark, kind = queries.sparkSession, "query_id long, doc_id long, cosine double"
    held = vectors.filter(F.col("embedding").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = queries.filter(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    size = asked.agg(F.sum(8 * (F.size("q") + 1)).alias("n")).first()["n"] or 0
    parts = -(-size // MOST_BYTES)
    found = []
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect()  # at most about MOST_BYTES
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(len(r["q"]), []).append(r)
        shared = spark.sparkContext.broadcast({d: (np.array([r["query_id"] for r in x]), np.array([r["q"] for r in x], dtype=np.float64)) for d, x in by_dim.items() if d})
        found.append(held.mapInArrow(_best_of_task(shared, k, decimals), kind))
    if not found:
        return spark.createDataFrame([], kind)
    return top(functools.reduce(DataFrame.unionByName, found), k, "cosine").drop("rank")


def _best_of_task(shared, k: int, decimals: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: (np.empty((len(ids), 0)), np.empty((len(ids), 0), dtype=np.int64)) for d, (ids, _) in shared.value.items()}
        with np.errstate(divide="ignore", invalid="ignore"):
            units = {d: q / np.sqrt((q * q).sum(axis=1, keepdims=True)) for d, (_, q) in shared.value.items()}
            for batch in batches:
                lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                for d, unit in units.items():
                    rows = np.flatnonzero(lengths == d)
                    if not len(rows):
                        continue
                    part = batch.take(pa.array(rows))
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                    score = unit @ (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).T
                    score = np.where(np.isfinite(score), score if decimals is None else np.round(score, decimals), -np.inf)
                    ids = np.broadcast_to(part.column(0).to_numpy(), score.shape)
                    score, ids = np.concatenate([best[d][0], score], axis=1), np.concatenate([best[d][1], ids], axis=1)
                    order = np.lexsort((ids, -score), axis=1)[:, :k]
                    best[d] = np.take_along_axis(score, order, axis=1), np.take_along_axis(ids, order, axis=1)
        for d, (score, ids) in best.items():
            some = score > -np.inf
            asked = np.broadcast_to(shared.value[d][0][:, None], score.shape)
            yield pa.RecordBatch.from_arrays([pa.array(asked[some]), pa.array(ids[some]), pa.array(score[some])], ["query_id", "doc_id", "cosine"])

    return run


def cosine_rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, decimals: int | None = None) -> DataFrame:
    """Each query's k nearest among its candidates (query_id, doc_id); queries have query_id and vector."""
    found = candidates.select("query_id", "doc_id").join(vectors.select("doc_id", F.col("embedding").alias("v")), "doc_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    score = cosine(F.col("v"), F.col("q"))
    scored = found.select("query_id", "doc_id", (score if decimals is None else F.round(score, decimals)).alias("cosine"))
    return top(scored.filter("cosine is not null"), k, "cosine").drop("rank")


def authority(rank: Column, most: Column) -> Column:
    """0 to 1 by the logarithm of a page's rank against the query's highest; 0 where all ranks are 0."""
    return F.coalesce(F.try_divide(F.log1p(rank), F.log1p(most)), F.lit(0.0))


def blend(results: DataFrame, ranks: DataFrame, skew: float = DEFAULTS.skew, decimals: int | None = None) -> DataFrame:
    """(query_id, doc_id, cosine, score, rank): cosine and authority in the shares 1 - skew and skew."""
    known = results.join(ranks.select("doc_id", F.col("rank").alias("page_rank")), "doc_id", "left").withColumn("page_rank", F.coalesce("page_rank", F.lit(0.0)))
    most = known.withColumn("most", F.max("page_rank").over(W.partitionBy("query_id")))
    score = F.lit(1 - skew) * F.col("cosine") + F.lit(skew) * authority(F.col("page_rank"), F.col("most"))
    scored = most.select("query_id", "doc_id", "cosine", (score if decimals is None else F.round(score, decimals)).alias("score"))
    return top(scored, 1 << 30)


def fill_embeddings(wanted: DataFrame, vectors: DataFrame, text: Column, encode: Callable[[Column], Column]) -> DataFrame:
    """The vectors with those of ``wanted`` documents that had none, encoded from ``text``."""
    missing = wanted.join(vectors.select("doc_id"), "doc_id", "left_anti")
    return add_first(vectors.select("doc_id", "embedding"), missing.select("doc_id", encode(text).alias("embedding")), "doc_id")


def funnel(queries: DataFrame, query_vectors: DataFrame, postings: DataFrame, documents: DataFrame, vectors: DataFrame, ranks: DataFrame, settings: Settings = DEFAULTS, decimals: int | None = None) -> DataFrame:
    """All queries through prefilter (10 x limit), BM25 (5 x limit), cosine (limit) and the blend, in one plan."""
    lexical = ranked_bm25(queries, postings, documents, 5 * settings.limit, decimals)
    near = cosine_rerank(lexical, query_vectors, vectors, settings.limit, decimals)
    return blend(near, ranks, settings.skew, decimals)
